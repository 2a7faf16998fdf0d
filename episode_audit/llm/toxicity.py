"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 6 characters,
word ends marked) and of the whole word, all hashed into `BUCKETS` rows, so a
misspelling or an unseen ending shares vectors with the words it resembles. A
passage of `PASSAGE` words is the mean of its words, and a softmax over two
classes reads it. Vectors and softmax are trained together in numpy.

A document's score is the class-1 probability of its worst passage, so one
insult in a long text is not averaged away. Passages overlap by half; together
they cover the whole text.

Training takes a bounded sample: at most `POSITIVES` and `NEGATIVES` labelled
rows, those with the lowest hash of their id, texts above `LONGEST` characters
left out. In every epoch after the first, the worst passages stand for a toxic
document; clean documents give passages from all of the text, a part an epoch.
Whole epochs follow each other until `STEPS` gradient steps are done, whatever the
size of the sample. One task of an executor trains; the driver gets the effects alone.
Scoring reads every word of every document. As the softmax is linear, a word's
whole effect is one number, so scoring adds numbers and sends 1 MB to tasks.

Null and empty texts have one empty passage and score what the bias alone gives
(capped below 0.5: nothing toxic was read). Null ids and repeated rows are
scored like any other. Without labels of both classes every score is 0. Columns
beside id and text are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted

BUCKETS, WIDTH = 1 << 18, 8
SHORTEST_GRAM, LONGEST_GRAM = 3, 6
PASSAGE = 6
POSITIVES, NEGATIVES, LONGEST = 1500, 2500, 30_000
STEPS, BATCH = 1600, 512  # gradient steps at least, whatever the size of the sample: whole rounds through it
VECTOR_RATE, WEIGHT_RATE = 0.5, 0.05
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts in one array, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), np.bincount(row, minlength=len(lists))


def grams(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word's n-grams, and how many each word has (one at least)."""
    parts = [grams_of(words[k : k + step]) for k in range(0, len(words), step)] or [grams_of([])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w.strip(EDGES) or w}>" for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, dtype=np.int64)
    word_of = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters from here to the word's end
    mix = np.uint64(0x9E3779B97F4A7C15)
    found, owner = [], []
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, LONGEST_GRAM + 1):
            ahead = np.zeros(len(codes), dtype=np.uint64)
            ahead[: len(codes) - n + 1] = codes[n - 1 :]
            rolling = (rolling ^ ahead) * mix
            rolling ^= rolling >> np.uint64(29)
            if n >= SHORTEST_GRAM:
                there = left >= n
                found.append(rolling[there] ^ np.uint64(n))
                owner.append(word_of[there])
        # the whole word: a sum over its characters, weighed by place
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        weighed = (codes + np.uint64(1)) * (mix * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        weighed ^= weighed >> np.uint64(31)
        if len(sizes):
            found.append(np.add.reduceat(weighed, starts))
            owner.append(np.arange(len(marked)))
        all_found, all_owner = np.concatenate(found or [rolling]), np.concatenate(owner or [word_of])
        buckets = ((all_found * mix) >> np.uint64(64 - 18)).astype(np.int64) % BUCKETS
    order = np.argsort(all_owner, kind="stable")
    return buckets[order].astype(np.int32), np.bincount(all_owner, minlength=len(marked))


def word_effects(effect: np.ndarray, gram_of: np.ndarray, gram_count: np.ndarray, step: int = 20_000) -> np.ndarray:
    """The mean effect of each word's n-grams."""
    starts, out = np.cumsum(gram_count) - gram_count, np.empty(len(gram_count))
    for k in range(0, len(gram_count), step):
        counts = gram_count[k : k + step]
        part = gram_of[starts[k] : starts[k] + counts.sum()]
        out[k : k + step] = np.add.reduceat(effect[part], starts[k : k + step] - starts[k]) / counts
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, size)."""
    ends = np.cumsum(sizes)
    total, back = int(ends[-1]) if len(ends) else 0, ends - sizes - starts
    small = total < 2**31 and (not len(back) or (back.max() < 2**31 and back.min() > -(2**31)))
    kind = np.int32 if small else np.int64
    out = np.arange(total, dtype=kind)
    out -= np.repeat(back.astype(kind), sizes)
    return out


def passages(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of each passage, over all words; a text without words has none."""
    per = np.where(counts > PASSAGE, 1 + -(-(counts - PASSAGE) // step), counts > 0)
    row = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    base = np.cumsum(counts) - counts
    inside = np.minimum(nth * step, np.maximum(counts[row] - PASSAGE, 0))
    return row.astype(np.int32), base[row] + inside, np.minimum(counts[row], PASSAGE)


class Model:
    """Vectors of the buckets and the softmax over them."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = (rng.uniform(-1, 1, (BUCKETS, WIDTH)) / BUCKETS).astype(np.float32)
        self.weights = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        # sums of squared gradients, which set the size of the next step
        self.seen = np.full(BUCKETS, 1e-8, dtype=np.float32)
        self.seen_weights, self.seen_bias = np.full((WIDTH, 2), 1e-8), np.full(2, 1e-8)

    def effect(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of class 1, and the bias."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])

    def step(self, ids, sizes, labels, importance, gram_of, gram_start, gram_count) -> None:
        """One gradient step on passages given as runs of word ids."""
        uniq, inverse = np.unique(ids, return_inverse=True)
        picked = gram_of[ragged(gram_start[uniq], gram_count[uniq])]
        counts = gram_count[uniq]
        heads = np.cumsum(counts) - counts
        word = np.add.reduceat(self.vectors[picked], heads, axis=0) / counts[:, None]
        first = np.cumsum(sizes) - sizes
        hidden = np.add.reduceat(word[inverse], first, axis=0) / sizes[:, None]
        logits = hidden @ self.weights + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p *= (importance / importance.sum())[:, None]
        back = p @ self.weights.T
        for value, gradient, seen in ((self.weights, hidden.T @ p, self.seen_weights), (self.bias, p.sum(axis=0), self.seen_bias)):
            seen += gradient**2
            value -= (WEIGHT_RATE * gradient / np.sqrt(seen)).astype(np.float32)
        at_word = np.repeat(back / sizes[:, None], sizes, axis=0)
        word_back = np.stack([np.bincount(inverse, at_word[:, k], len(uniq)) for k in range(WIDTH)], axis=1) / counts[:, None]
        touched, where = np.unique(picked, return_inverse=True)
        spread = np.repeat(word_back, counts, axis=0)
        gradient = np.stack([np.bincount(where, spread[:, k], len(touched)) for k in range(WIDTH)], axis=1)
        self.seen[touched] += (gradient**2).mean(axis=1)
        self.vectors[touched] -= (VECTOR_RATE * gradient / np.sqrt(self.seen[touched])[:, None]).astype(np.float32)


def train(texts: pa.Array, labels: list[int], seed: int = 7) -> Model:
    """Fit vectors and softmax together."""
    model, rng = Model(seed), np.random.default_rng(seed)
    coded, counts = split_words(texts)
    coded = coded.dictionary_encode()
    ids = coded.indices.to_numpy()
    gram_of, gram_count = grams(coded.dictionary.to_pylist())
    gram_start = np.cumsum(gram_count) - gram_count
    row, start, size = passages(counts, PASSAGE // 2)
    label = np.asarray(labels, dtype=np.int64)[row]
    epoch = steps = 0
    while steps < STEPS:
        bad = np.flatnonzero(label == 1)
        if epoch:
            effect, _ = model.effect()
            total = np.concatenate([[0.0], np.cumsum(word_effects(effect, gram_of, gram_count)[ids])])
            logit = (total[start + size] - total[start]) / size
            best = np.full(len(counts), -np.inf)
            np.maximum.at(best, row[bad], logit[bad])
            bad = bad[logit[bad] >= best[row[bad]] - 1e-9]
            good = np.flatnonzero(label == 0)
            # passages of clean texts that look worst, and a part of the others
            hard = good[np.argsort(-logit[good], kind="stable")[: 4 * len(bad)]]
            good = np.concatenate([hard, good[epoch % 4 :: 4]])
        else:
            good = np.flatnonzero(label == 0)[::4]
        chosen = rng.permutation(np.concatenate([bad, good]))
        weigh = np.where(label == 1, len(good) / max(len(bad), 1) * 0.3, 1.0)
        for k in range(0, len(chosen), BATCH):
            c = chosen[k : k + BATCH]
            model.step(ids[ragged(start[c], size[c])], size[c], label[c], weigh[c], gram_of, gram_start, gram_count)
        epoch, steps = epoch + 1, steps + max(1, -(-len(chosen) // BATCH))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text, label of the bounded sample; rows whose crc32(id) mod 5 is 0 are held out."""
    known = labels.where("toxic in (0, 1)").select(quoted(id_col).alias("id"), "toxic")
    known = known.where("pmod(crc32(cast(id as string)), 5) <> 0").groupBy("id").agg(F.max("toxic").alias("label"))
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = None
    for value, most in ((1, POSITIVES), (0, NEGATIVES)):
        part = known.where(F.col("label") == value).orderBy(order, "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    joined = texts.where(F.char_length("text") <= LONGEST).join(F.broadcast(chosen), "id")
    return joined.groupBy("id", "label").agg(F.max("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float] | None:
    """Effects of the buckets and the bias; None without labels of both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by("order")
        known = rows.column("label").to_pylist()
        if set(known) == {0, 1}:
            effect, bias = train(rows.column("text").combine_chunks(), known).effect()
            yield pa.RecordBatch.from_arrays([pa.array([effect.astype(np.float32).tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["effect", "bias"])

    sample = training_rows(docs, labels, id_col, text_col)
    order = F.row_number().over(Window.orderBy("id")).cast("long")  # of a few thousand rows
    rows = sample.select(order.alias("order"), F.col("label").cast("int").alias("label"), F.col("text").cast("string").alias("text"))
    # one task of an executor trains on the bounded sample; the driver sees the effects alone
    found = rows.coalesce(1).mapInArrow(run, "effect binary, bias double").first()
    return found and (np.frombuffer(found.effect, dtype=np.float32), found.bias)


def scores_of(texts: pa.Array, effect: np.ndarray, bias: float) -> np.ndarray:
    """The worst passage's probability for every text."""
    flat, counts = split_words(texts)
    nothing = min(1 / (1 + np.exp(-bias)), 0.25)
    out = np.full(len(counts), nothing)
    if len(flat) == 0:
        return out
    coded = flat.dictionary_encode()
    gram_of, gram_count = grams(coded.dictionary.to_pylist())
    word = word_effects(effect, gram_of, gram_count)
    total = np.concatenate([[0.0], np.cumsum(word[coded.indices.to_numpy()], dtype=np.float64)])
    row, start, size = passages(counts, PASSAGE // 2)
    logit = (total[start + size] - total[start]) / size + bias
    worst = np.full(len(counts), -np.inf)
    np.maximum.at(worst, row, logit)
    there = counts > 0
    out[there] = 1 / (1 + np.exp(-np.clip(worst[there], -500, 500)))
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default) of docs and `score`."""
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*map(quoted, keep)), "score")
    (text,) = fresh(docs, "text_")
    if model is None:
        return docs.select(*map(quoted, keep), F.lit(0.0).alias(name))
    effect = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32))
    bias = model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores_of(batch.column(batch.num_columns - 1).cast(pa.string()), effect.value, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=out_names)

    out_names = [*keep, name]
    source = docs.select(*map(quoted, keep), quoted(text_col).cast("string").alias(text))
    schema = source.drop(text).schema.add(name, "double")
    return source.mapInArrow(run, schema)


def reject(docs: DataFrame, model: tuple[np.ndarray, float] | None, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below `limit`, with their columns."""
    scored = score(docs, model, text_col)
    return scored.where(quoted(scored.columns[-1]) < limit).select(*map(quoted, docs.columns))
