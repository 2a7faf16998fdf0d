"""Structured Streaming jobs over record, claim, revocation and request streams.

Sinks that append each key once write to a key store, which reads only the buckets of
its keys that a batch touches and outlives any checkpoint. Jobs with an order in event
time hold rows back until the watermark has passed them, so results do not depend on the order
in which files arrive.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as fixed
from ..operators.checks.run import CheckInput, run_checks
from ..operators.row_series import in_parts, running_sum, with_previous
from .key_store import KeyStore, run_of


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint folder."""
    from ..session import checkpoint_folder

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _put(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


# ---------------------------------------------------------- append, revoke


def append_once(stream: DataFrame, key: Sequence[str], time: str, delay: str, store: KeyStore, checkpoint: str) -> StreamingQuery:
    """Append rows whose key was not appended before; repeats in flight are dropped early."""
    fresh = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))
    return start(fresh, lambda batch, batch_id: store.append(batch, run_of(batch, checkpoint), batch_id), checkpoint)


def first_write_wins(stream: DataFrame, order: Sequence[str], store: KeyStore, checkpoint: str) -> StreamingQuery:
    """Keep the earliest row of each key; a later row never replaces a written one."""
    return start(stream, lambda batch, batch_id: store.append(batch, run_of(batch, checkpoint), batch_id, order), checkpoint)


def revocation_status(records: DataFrame, store: KeyStore) -> DataFrame:
    """Live or revoked per record from the revocations written so far (column key)."""
    revoked = store.rows().select("key", F.lit("revoked").alias("_s"))
    return records.join(revoked, "key", "left").select(*records.columns, F.coalesce("_s", F.lit("live")).alias("status"))


def verify_queue(episodes: DataFrame, check: Callable[[DataFrame], DataFrame], store: KeyStore, checkpoint: str) -> StreamingQuery:
    """Run `check` on each micro-batch of complete episodes and keep claims not issued before."""
    return start(episodes, lambda batch, batch_id: store.append(check(batch), run_of(batch, checkpoint), batch_id), checkpoint)


def live_checks(
    frames: DataFrame,
    frames_so_far: Callable[[], DataFrame],
    prepare: Callable[[DataFrame], CheckInput],
    config: dict,
    time: str,
    gap: str,
    delay: str,
    store: KeyStore,
    checkpoint: str,
) -> StreamingQuery:
    """All enabled checks on live frames, episode by episode, as soon as an episode is complete.

    An episode is complete when the watermark passes its last frame by `gap`; until then only
    its bounds are kept as state. Complete ones are looked up among the frames landed so far,
    with their first and last time as limits, and go through the same checks as a
    batch; outcomes are appended once per (episode, check).
    """

    def check(closed: DataFrame) -> DataFrame:
        landed = frames_so_far().alias("f")
        spans = closed.alias("c")
        inside = (F.col("f.episode") == F.col("c.episode")) & F.col(f"f.{time}").between(F.col("c.first"), F.col("c.last"))
        return run_checks(prepare(landed.join(spans, inside, "left_semi")), config).select(*store.schema.names)

    return verify_queue(live_sessions(frames, time, "episode", gap, delay), check, store, checkpoint)


# -------------------------------------------------------------- keyed state


def _in_time(
    stream: DataFrame, key: str, delay: str, fold: Callable, start_state: tuple, state_schema: str, carried: str, out: str
) -> DataFrame:
    """Fold the rows of each key in the order of (time, id), whatever the order of their arrival.

    Rows wait in the state until the watermark has passed their time; no earlier row can
    come after that (later ones are dropped as late). `fold(state, row) -> state, value` sees
    rows of columns at (epoch seconds), id and `carried`.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *own, at, ids, more = state.get if state.exists else (*start_state, [], [], [])
        own, waiting = tuple(own), list(zip(at, ids, more))
        for batch in batches:
            waiting += zip(batch["at"].tolist(), batch["id"].tolist(), batch[carried].astype(str).tolist() if carried else [""] * len(batch))
        passed = state.getCurrentWatermarkMs()
        waiting.sort()
        ready = next((i for i, w in enumerate(waiting) if w[0] * 1000 > passed), len(waiting))
        made = []
        for row in waiting[:ready]:
            own, value = fold(own, row)
            made.append((row[1], value))
        waiting = waiting[ready:]
        state.update((*own, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(int(waiting[0][0] * 1000) + 1, passed + 1))
        yield pd.DataFrame({key: [group[0]] * len(made), "id": [m[0] for m in made], "value": [m[1] for m in made]})

    held = stream.withWatermark("time", delay)
    return held.groupBy(key).applyInPandasWithState(
        run, out, f"{state_schema}, _at array<double>, _id array<bigint>, _more array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def classify_requests(stream: DataFrame, delay: str, ttl_s: int = fixed.IDEMPOTENCY_TTL_S) -> DataFrame:
    """key, time (timestamp), at (the same in epoch seconds), id, body -> key, id, outcome, in event time."""

    def fold(state: tuple, row: tuple) -> tuple[tuple, str]:
        opened, body = state
        if opened < 0 or row[0] >= opened + ttl_s:
            return (float(row[0]), row[2]), "new"
        return state, "replay" if row[2] == body else "conflict"

    out = "key string, id bigint, value string"
    made = _in_time(stream, "key", delay, fold, (-1.0, ""), "opened double, body string", "body", out)
    return made.withColumnRenamed("value", "outcome")


def flag_bursts(
    stream: DataFrame, key: str, delay: str, capacity: int = fixed.BURST_CAPACITY, refill_s: float = fixed.BURST_REFILL_S
) -> DataFrame:
    """key, time (timestamp), at (the same in epoch seconds), id -> key, id, allowed. A bucket refills evenly over `refill_s`."""

    def fold(state: tuple, row: tuple) -> tuple[tuple, bool]:
        tokens, seen = state
        if seen >= 0 and row[0] > seen:
            tokens = min(float(capacity), tokens + (row[0] - seen) / refill_s * capacity)
        return (tokens - (1.0 if tokens >= 1 else 0.0), float(row[0])), tokens >= 1

    out = f"{key} bigint, id bigint, value boolean"
    made = _in_time(stream, key, delay, fold, (float(capacity), -1.0), "tokens double, seen double", "", out)
    return made.withColumnRenamed("value", "allowed")


def burst_flags_of(rows: DataFrame, key: str, capacity: int = fixed.BURST_CAPACITY, refill_s: float = fixed.BURST_REFILL_S) -> DataFrame:
    """The same flags over a whole table of (key, at, event_id), in event time whatever the order of files.

    A pause of `refill_s` always fills the bucket, so requests between two such pauses are a run of
    their own; runs of one key go to many tasks. Rows of a run stream through in order, so a
    task holds one batch and one bucket.
    """
    schema = f"{key} bigint, event_id bigint, allowed boolean"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, seen = None, 0.0, 0.0
        for batch in batches:
            allowed = []
            for own, at in zip(zip(batch[key], batch["_run"], strict=True), batch["at"], strict=True):
                if own != current:
                    current, tokens = own, float(capacity)
                else:
                    tokens = min(float(capacity), tokens + (at - seen) / refill_s * capacity)
                seen = at
                allowed.append(tokens >= 1)
                tokens -= 1.0 if tokens >= 1 else 0.0
            yield pd.DataFrame({key: batch[key], "event_id": batch["event_id"], "allowed": allowed})

    parts = in_parts(rows.select(key, "at", "event_id"), [key], ["at", "event_id"])
    paused = with_previous(parts, [key], ["at"]).withColumn("_opens", (F.col("pos") > 0) & (F.col("at") - F.col("prev_at") >= refill_s))
    runs = running_sum(paused, [key], F.col("_opens").cast("bigint"), "_run")
    ordered = runs.select(key, "_run", "at", "event_id").repartition(key, "_run").sortWithinPartitions(key, "_run", "at", "event_id")
    return ordered.mapInPandas(walk, schema)


def lag_alarms(stream: DataFrame, check_every_ms: int = 60_000) -> DataFrame:
    """ledger, role, at (epoch seconds) -> ledger, lag_s, alarm on every batch and on silence.

    A timeout in processing time raises the alarm when no head arrives at all.
    """
    schema = "ledger bigint, last_at double, lag_s double, alarm boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() / 1000.0
        last, limit = state.get if state.exists else (float("-inf"), 0.0)
        if not state.hasTimedOut:
            for batch in batches:
                last = max(last, float(batch["at"].max()))
                limit = 2.0 * fixed.ANCHOR_INTERVAL_S[batch["role"].iloc[0]]
        state.update((last, limit))
        state.setTimeoutDuration(check_every_ms)
        yield pd.DataFrame({"ledger": [key[0]], "last_at": [last], "lag_s": [now - last], "alarm": [now - last > limit]})

    return stream.groupBy("ledger").applyInPandasWithState(run, schema, "last_at double, limit double", "append", GroupStateTimeout.ProcessingTimeTimeout)


# --------------------------------------------------------- windows in time


def live_sessions(stream: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Episodes of live frames: an episode closes when the watermark passes its gap."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("events"), F.min(time).alias("first"), F.max(time).alias("last"))
        .select(key, "first", "last", "events")
    )


def split_late(stream: DataFrame, time: str, closed: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Frames that arrive for an episode already closed go to a side table for a batch re-check."""
    ends = closed.groupBy(key).agg(F.max("last").alias("_closed"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        _put(batch.join(ends, key).filter(F.col(time) <= F.col("_closed")).drop("_closed"), path, batch_id)

    return start(stream, handle, checkpoint)
