"""Validation rules as columns: each returns the list of issues of a row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .hashing import hex_text
from .text import path_problem

HASH_PATTERN = "^0x[0-9a-f]{64}$"


def issues(rules: Iterable[tuple[Column, str]]) -> Column:
    """Messages of every rule that is broken; an undecidable rule counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(~bad, F.lit(False)), F.lit(text)) for bad, text in rules)))


def _sorted_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values)) == values


def manifest_issues(m: Column, payload_root: Column) -> Column:
    """Issues of a capture manifest struct.

    `payload_root` is the digest recomputed from the manifest's own files. The
    closed shape is given by reading with a fixed schema.
    """
    f = m.getField
    hashed = lambda name: ~f(name).rlike(HASH_PATTERN)
    return issues(
        [
            (f("v") != 1, "v must be 1"),
            (f("kind") != "capture_manifest", "kind must be capture_manifest"),
            (F.length(f("org_id")) < 1, "org_id is required"),
            (f("dataset_id").isNotNull() & (f("dataset_id") == ""), "dataset_id must not be empty"),
            (~f("source").isin(*fixed.SOURCES), "source is not known"),
            (~f("layout").isin(*fixed.LAYOUTS), "layout is not known"),
            (F.length(f("embodiment")) < 1, "embodiment is required"),
            (~(f("rate_hz") > 0) | F.isnan(f("rate_hz")), "rate_hz must be positive"),
            (f("duration_ms") < 0, "duration_ms must not be negative"),
            (f("captured_at") < 0, "captured_at must not be negative"),
            (f("scope_bits") < 0, "scope_bits must not be negative"),
            (
                F.exists(f("channels"), lambda c: (c.getField("name") == "") | (c.getField("dtype") == "")),
                "channel name and dtype are required",
            ),
            (
                F.exists(f("channels"), lambda c: F.coalesce(c.getField("hz") <= 0, F.lit(False))),
                "channel hz must be positive",
            ),
            (
                ~_sorted_unique(F.transform(f("channels"), lambda c: c.getField("name"))),
                "channels must be sorted by name and unique",
            ),
            (F.size(f("files")) == 0, "at least one file is required"),
            (
                F.exists(f("files"), lambda x: path_problem(x.getField("path")).isNotNull()),
                "invalid file path",
            ),
            (F.exists(f("files"), lambda x: ~x.getField("hash").rlike(HASH_PATTERN)), "invalid file hash"),
            (F.exists(f("files"), lambda x: x.getField("bytes") < 0), "file bytes must not be negative"),
            (
                ~_sorted_unique(F.transform(f("files"), lambda x: x.getField("path"))),
                "files must be sorted by path and unique",
            ),
            ((f("layout") == "chunked") & f("range").isNull(), "range is required when layout is chunked"),
            (hashed("payload_hash"), "invalid payload_hash"),
            (hashed("consent_commitment"), "invalid consent_commitment"),
            (hashed("terms_hash"), "invalid terms_hash"),
            (
                f("sim").isNotNull()
                & ~F.coalesce(uint64_text(f("sim").getField("world_seed")), F.lit(False)),
                "world_seed must be a decimal string fitting 64 bits",
            ),
            (
                f("payload_hash") != F.concat(F.lit("0x"), hex_text(payload_root)),
                "payload_hash does not match its files",
            ),
        ]
    )


def unknown_keys(text: Column, shape: dict, path: str | Column = "") -> Column:
    """Paths of keys that a closed shape does not name, at any depth of a JSON object's text.

    `shape` names every key: None for a value, a dict for an object, a list of one dict for an
    array of objects, "free" for an object whose keys are data. Paths read `range.x`,
    `files[2].y`. What is no object where one belongs has no unknown keys.
    """
    at = F.lit(path) if isinstance(path, str) else path
    empty = F.array().cast("array<string>")
    names = F.coalesce(F.json_object_keys(text), empty)
    found = [F.transform(F.array_except(names, F.array(*map(F.lit, shape))), lambda k: F.concat(at, k))]
    for key, inner in shape.items():
        part = F.get_json_object(text, f"$.{key}")
        if isinstance(inner, dict):
            found.append(unknown_keys(part, inner, F.concat(at, F.lit(f"{key}."))))
        elif isinstance(inner, list):
            found.append(_unknown_in_elements(part, inner[0], F.concat(at, F.lit(f"{key}["))))
    return found[0] if len(found) == 1 else F.concat(*found)


def _unknown_in_elements(text: Column, shape: dict, path: Column) -> Column:
    elements = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return F.flatten(F.transform(elements, lambda e, i: unknown_keys(e, shape, F.concat(path, i.cast("string"), F.lit("].")))))


def corpus_manifest_issues(m: Column, listed: Column, distinct: Column) -> Column:
    """Issues of a corpus manifest struct; `listed` and `distinct` count its episodes, which are never gathered in a row."""
    f = m.getField
    hashed = lambda name: ~f(name).rlike(HASH_PATTERN)
    sources = f("sources")
    return issues(
        [
            (f("v") != 1, "v must be 1"),
            (f("kind") != "corpus_manifest", "kind must be corpus_manifest"),
            (F.length(f("org_id")) < 1, "org_id is required"),
            (F.length(f("title")) < 1, "title is required"),
            (distinct < listed, "episodes must be unique"),
            (f("episode_count").isNotNull() & (f("episode_count") != listed), "episode_count is not the number of episodes"),
            (hashed("terms_hash"), "invalid terms_hash"),
            (f("task_id").isNotNull() & hashed("task_id"), "invalid task_id"),
            (f("corpus_root").isNotNull() & hashed("corpus_root"), "invalid corpus_root"),
            (sources.isNotNull() & F.exists(sources, lambda s: ~s.isin(*fixed.SOURCES)), "source is not known"),
            (sources.isNotNull() & ~_sorted_unique(sources), "sources must be sorted and unique"),
            (f("sealed_at").isNotNull() & (f("sealed_at") < 0), "sealed_at must not be negative"),
        ]
    )


def uint64_text(text: Column) -> Column:
    """Decimal digits only, and not above 2^64 - 1."""
    digits = F.regexp_replace(text, "^0+(?=.)", "")
    limit = str(2**64 - 1)
    return text.rlike("^[0-9]+$") & (
        (F.length(digits) < len(limit)) | ((F.length(digits) == len(limit)) & (digits <= limit))
    )


def claim_detail_issues(detail_json: Column) -> Column:
    """A claim's detail must be an object naming its version and thresholds."""
    version = F.get_json_object(detail_json, "$.check_version")
    thresholds = F.get_json_object(detail_json, "$.thresholds")
    return issues(
        [
            (~detail_json.rlike(r"^\s*\{"), "detail must be an object"),
            (version.isNull() | (version == ""), "check_version is required"),
            (thresholds.isNull() | ~thresholds.rlike(r"^\s*\{"), "thresholds is required"),
        ]
    )


def _bad_range(r: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return r.isNull() | (F.size(r) != 2) | ~F.forall(r, finite)


def _spread(r: Column) -> Column:
    return F.when(_bad_range(r), 0.0).otherwise(F.abs(F.get(r, 1) - F.get(r, 0)))


def _per_object(objects: Column, rule, text: str) -> Column:
    """Messages `world.objects[i]<text>` for every object that breaks `rule`."""
    flagged = F.transform(
        objects,
        lambda o, i: F.when(
            F.coalesce(rule(o), F.lit(True)), F.concat(F.lit("world.objects["), i.cast("string"), F.lit("]" + text))
        ),
    )
    return F.array_compact(F.coalesce(flagged, F.array().cast("array<string>")))


def task_spec_issues(s: Column) -> Column:
    """(severity, message) of every rule a task specification struct breaks."""
    f = s.getField
    world, success, acceptance = f("world"), f("success"), f("acceptance")
    objects = world.getField("objects")
    g = lambda name: (lambda o: o.getField(name))
    used = F.regexp_extract_all(F.coalesce(success.getField("predicate"), F.lit("")), F.lit(r"([a-z_]+)\s*\("), 1)
    blank = F.trim(F.coalesce(success.getField("predicate"), F.lit(""))) == ""
    varies = (
        (_spread(world.getField("lightingIntensity")) > 0)
        | (_spread(world.getField("lightingTemperatureK")) > 0)
        | F.exists(
            F.coalesce(objects, F.array()),
            lambda o: (F.coalesce(F.size(o.getField("instances")), F.lit(0)) > 1)
            | (_spread(o.getField("x")) > 0)
            | (_spread(o.getField("y")) > 0)
            | (_spread(o.getField("yaw")) > 0)
            | (_spread(o.getField("count")) > 0),
        )
    )
    general = issues(
        [
            (f("version") != 1, "unsupported version"),
            (F.length(f("embodiment")) < 1, "embodiment is required"),
            (~f("actionSpace").isin(*fixed.ACTION_SPACES), "actionSpace is not known"),
            (F.length(F.trim(f("instruction"))) < 8, "instruction must be a sentence"),
            (F.length(world.getField("base")) < 1, "world.base is required"),
            (F.size(objects) == 0, "at least one object is required"),
        ]
    )
    ordered = lambda name: (lambda o: ~_bad_range(g(name)(o)) & (F.get(g(name)(o), 0) > F.get(g(name)(o), 1)))
    given = lambda name: (lambda o: g(name)(o).isNotNull() & _bad_range(g(name)(o)))
    placed = F.concat(
        _per_object(objects, lambda o: F.length(o.getField("category")) < 1, ".category is required"),
        _per_object(objects, lambda o: F.size(o.getField("instances")) == 0, ".instances must list an asset"),
        _per_object(objects, lambda o: _bad_range(o.getField("x")), ".x must be a range"),
        _per_object(objects, lambda o: _bad_range(o.getField("y")), ".y must be a range"),
        _per_object(objects, ordered("x"), ".x has min above max"),
        _per_object(objects, ordered("y"), ".y has min above max"),
        _per_object(objects, given("z"), ".z must be a range"),
        _per_object(objects, given("yaw"), ".yaw must be a range"),
        _per_object(
            objects,
            lambda o: o.getField("count").isNotNull()
            & (
                _bad_range(o.getField("count"))
                | (F.get(o.getField("count"), 0) < 0)
                | (F.get(o.getField("count"), 0) > F.get(o.getField("count"), 1))
            ),
            ".count must be a non-negative range",
        ),
    )
    scored = issues(
        [
            (~varies, "the task has no variation"),
            (blank, "success.predicate is required"),
            (~blank & (F.size(used) == 0), "success.predicate must call a predicate"),
            (~(success.getField("toleranceMm") > 0), "success.toleranceMm must be positive"),
            (~(success.getField("settleS") >= 0), "success.settleS must be zero or more"),
            (~acceptance.getField("minScoreBps").between(0, 10000), "acceptance.minScoreBps must be 0 to 10000"),
            (~(acceptance.getField("maxDurationS") > 0), "acceptance.maxDurationS must be positive"),
            (~(acceptance.getField("targetEpisodes") > 0), "acceptance.targetEpisodes must be positive"),
            (
                (f("actionSpace") == "joint_position") & f("embodiment").isin(*fixed.HIGH_DOF_EMBODIMENTS),
                "joint_position cannot drive this embodiment",
            ),
        ]
    )
    unknown = F.transform(
        F.array_except(used, F.array(*(F.lit(p) for p in fixed.PREDICATES))),
        lambda p: F.concat(F.lit("success.predicate uses "), p),
    )
    errors = F.transform(F.concat(general, placed, scored, unknown), lambda m: F.struct(F.lit("error").alias("severity"), m.alias("message")))
    warnings = F.when(
        acceptance.getField("targetEpisodes") < fixed.PILOT_EPISODES,
        F.array(F.struct(F.lit("warning").alias("severity"), F.lit("targetEpisodes reads as a pilot").alias("message"))),
    ).otherwise(F.array().cast("array<struct<severity:string,message:string>>"))
    return F.concat(errors, warnings)
