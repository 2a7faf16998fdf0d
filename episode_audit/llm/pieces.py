"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary is a public byte-fallback BPE model, read by path and sent to
the tasks as its file's bytes; nothing is trained here.

Encoding. A text gets one space in front and spaces become the word mark, as
the model's own encoder does. No piece has a word mark after another sign, so
merges never cross from a sign to a following mark; texts are cut there into
chunks. All chunks of a batch are merged together: each keeps an agenda of candidate merges (pairs of
neighbours whose join is a piece); in every step each chunk takes its best
candidate, the piece with the best score, the leftmost of equals. Dropout
decides when a candidate enters the agenda: a hash keyed by (chunk, document,
copy, place of the chunk, seed, span of the candidate) below `dropout` skips it for
good. Other merges over the same span may still come to stand, as in any agenda.
So a rate of 0 is the model's own segmentation, a rate of 1 gives single
characters, and one seed always gives the same ids. Every occurrence of a word has
draws of its own, whatever the size of the corpus.

Work is shared without sharing draws: a candidate's span spells a piece, so the
spans of a chunk that spell pieces are all that a draw can decide. Occurrences of
a chunk in an Arrow batch that skip the same ones of those spans have the same
segmentation and are merged once. Chunks with more than `MASK_BITS` such spans, or
of more than `LONGEST_SHARED` signs, are merged by themselves.

Characters without a piece fall back to their UTF-8 bytes. A word mark that
stands in the text itself is taken as bytes too, which keeps decoding exact.

Decoding joins the pieces' bytes and takes the leading space away: the source
text exactly, whatever the seed.

Null and empty texts have no ids and decode to an empty text. A null id hashes
like an empty one. Rows that repeat an id are encoded alike unless `copy_col` tells
them apart. Very long texts travel in an
Arrow batch of their own. Other columns of the table are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import fresh, quoted
from .toxicity import ragged

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 1
MASK_BITS, LONGEST_SHARED = 64, 256
MARK = "▁"
AGENDA_CELLS = 200_000  # places of chunks that are merged at once, which bounds a task's memory
NEVER = np.int32(2**31 - 1)
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(a: np.ndarray, b) -> np.ndarray:
    """A keyed 64-bit mix of two arrays."""
    with np.errstate(over="ignore"):
        x = (a ^ (np.asarray(b).astype(np.uint64) * K1)) * K2
        x ^= x >> np.uint64(32)
        x *= K3
        return x ^ (x >> np.uint64(29))


class Vocabulary:
    """Lookup tables made from a model file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_id = np.zeros(256, dtype=np.int32)
        texts = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][3:5], 16)] = i
                texts[i] = bytes([int(pieces[i][3:5], 16)])
        by_text = {}
        for i in plain:
            texts[i] = pieces[i].replace(MARK, " ").encode()
            by_text[pieces[i]] = i
        # best score first; equal scores by place in the agenda
        scores = np.array([sp.get_score(i) for i in range(size)])
        self.rank = np.full(size + 1, NEVER, dtype=np.int32)
        levels = np.unique(-scores[plain])
        self.rank[plain] = np.searchsorted(levels, -scores[plain]).astype(np.int32)
        self.char_id = np.full(0x110000, size, dtype=np.int32)  # size: no piece
        for text, i in by_text.items():
            if len(text) == 1 and text != MARK:
                self.char_id[ord(text)] = i
        self.char_id[0x20] = by_text[MARK]
        self.spelled = sorted(text.replace(MARK, " ") for text in by_text if len(text) > 1)
        self.longest = max(map(len, self.spelled), default=0)
        self.may_spell = np.zeros(1 << 22, dtype=bool)  # by hash, so a few spans more than spell pieces
        codes = np.frombuffer("".join(self.spelled).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        signs = np.array([len(t) for t in self.spelled], dtype=np.int64)
        for at, many, place in self.stretches(codes, np.cumsum(signs) - signs, signs):
            self.may_spell[place[signs[at] == many]] = True
        pairs, joined = [], []
        for text, i in by_text.items():
            for cut in range(1, len(text)):
                a, b = by_text.get(text[:cut]), by_text.get(text[cut:])
                if a is not None and b is not None:
                    pairs.append(a * (size + 1) + b)
                    joined.append(i)
        self.size = size
        # open addressing: two tries in a table kept sparse, then a search
        pairs, joined = np.array(pairs, dtype=np.int64), np.array(joined, dtype=np.int32)
        order = np.argsort(pairs)
        self.pairs, self.joined = pairs[order], joined[order]
        self.bits = 22
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        place = self.hashed(self.pairs)
        uniq, first = np.unique(place, return_index=True)
        self.slot[uniq] = first
        rest = np.setdiff1d(np.arange(len(self.pairs)), first)
        self.clash = set(place[rest].tolist())
        self.clashing = np.zeros(1 << self.bits, dtype=bool)
        self.clashing[list(self.clash)] = True
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.piece_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.piece_size = lengths
        self.piece_start = np.cumsum(lengths) - lengths

    def hashed(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pairs.astype(np.uint64) * K1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece a pair makes; `size` for none."""
        key = left.astype(np.int64) * (self.size + 1) + right
        place = self.hashed(key)
        at = self.slot[place]
        found = (at >= 0) & (self.pairs[at] == key)
        out = np.where(found, self.joined[at], self.size)
        odd = np.flatnonzero(~found & self.clashing[place])
        if len(odd):
            where = np.minimum(np.searchsorted(self.pairs, key[odd]), len(self.pairs) - 1)
            out[odd] = np.where(self.pairs[where] == key[odd], self.joined[where], self.size)
        return out

    def segment(self, chunks: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in one array, and how many each chunk has."""
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32)
        starts = np.cumsum(sizes) - sizes
        symbols = self.char_id[codes]
        alive = np.ones(len(codes), dtype=bool)
        order = np.argsort(sizes, kind="stable")
        # chunks of like length together, so rows of the agenda are hardly padded
        edges = np.unique(np.concatenate([[0], np.searchsorted(sizes[order], [3, 5, 7, 9, 12, 16, 24, 48, 128, 1024, 1 << 40])]))
        for a, b in zip(edges, edges[1:], strict=False):
            rows = order[a:b]
            widest = int(sizes[rows[-1]])
            step = max(1, AGENDA_CELLS // max(widest, 1))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                if widest > 1024:  # chunks without a break, of any length
                    for r in part:
                        self.merge_long(symbols, alive, int(starts[r]), int(sizes[r]), keys[r], dropout)
                elif widest > 1:
                    self.merge(symbols, alive, starts[part], sizes[part], widest, keys[part], dropout)
        ids = symbols[alive]
        owner = np.repeat(np.arange(len(chunks)), sizes)[alive]
        unknown = ids == self.size
        if not unknown.any():
            return ids, np.bincount(owner, minlength=len(chunks))
        lost = codes[alive][unknown]
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in lost]
        many = np.ones(len(ids), dtype=np.int64)
        many[unknown] = [len(r) for r in raw]
        out = np.repeat(ids, many)
        out[np.repeat(unknown, many)] = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return out, np.bincount(np.repeat(owner, many), minlength=len(chunks))

    def allowed(self, piece, keys, start, end, dropout: float) -> np.ndarray:
        """Agenda rank of candidate merges: NEVER where there is no piece or the keyed hash skips it."""
        rank = self.rank[piece]
        if dropout <= 0:
            return rank
        return np.where(self.skipped(keys, start, end, dropout), NEVER, rank)

    @staticmethod
    def skipped(keys, start, end, dropout: float) -> np.ndarray:
        """Whether the keyed hash skips a candidate over a span."""
        draw = mixed(mixed(keys, start), end)
        return (draw >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53

    def stretches(self, codes: np.ndarray, starts: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """For each length from 2: which of `starts` have as many signs left, the length, and the hash of these signs."""
        at = np.arange(len(starts))
        value = codes[starts]
        with np.errstate(over="ignore"):
            for size in range(2, self.longest + 1):
                more = left[at] >= size
                at, value = at[more], value[more]
                if not len(at):
                    return
                value = (value ^ (value >> np.uint64(31))) * K1 + codes[starts[at] + size - 1]
                yield at, size, ((value * K2) >> np.uint64(42)).astype(np.int64)

    def spans(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all spans that may spell pieces, by chunk, and how many each chunk has; -1 for more than a mask holds."""
        counts = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        usual = np.flatnonzero(counts <= LONGEST_SHARED)
        sizes = counts[usual]
        codes = np.frombuffer("".join([chunks[k] for k in usual.tolist()]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(usual, sizes)
        place = np.arange(len(codes)) - np.repeat(first, sizes)
        owners, begins, ends = [], [], []
        for at, size, where in self.stretches(codes, np.arange(len(codes)), np.repeat(sizes, sizes) - place):
            at = at[self.may_spell[where]]
            owners.append(owner[at])
            begins.append(place[at])
            ends.append(place[at] + size)
        if not owners:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.where(counts > LONGEST_SHARED, -1, 0)
        owner, begin, end = np.concatenate(owners), np.concatenate(begins), np.concatenate(ends)
        held = np.bincount(owner, minlength=len(chunks))
        keep = held[owner] <= MASK_BITS
        owner, begin, end = owner[keep], begin[keep], end[keep]
        order = np.argsort(owner, kind="stable")
        return begin[order], end[order], np.where((counts > LONGEST_SHARED) | (held > MASK_BITS), -1, held)

    def masks(self, chunks: list[str], index: np.ndarray, keys: np.ndarray, dropout: float) -> np.ndarray:
        """For each occurrence of a chunk the spans that its key skips, a bit each; a number of its own without a mask."""
        begins, ends, counts = self.spans(chunks)
        held = np.maximum(counts, 0)
        heads = np.cumsum(held) - held
        bits = np.uint64(1) << (np.arange(len(begins)) - np.repeat(heads, held)).astype(np.uint64)
        out = np.zeros(len(index), dtype=np.uint64)
        some = np.flatnonzero(held[index])
        drawn = np.cumsum(held[index[some]])
        edges = np.searchsorted(drawn, np.arange(0, drawn[-1], AGENDA_CELLS)).tolist() if len(some) else []
        for a, b in zip(edges, [*edges[1:], len(some)], strict=True):
            part = some[a:b]
            if not len(part):
                continue
            many = held[index[part]]
            at = ragged(heads[index[part]], many)
            skip = self.skipped(np.repeat(keys[part], many), begins[at], ends[at], dropout)
            out[part] = np.bitwise_or.reduceat(np.where(skip, bits[at], np.uint64(0)), np.cumsum(many) - many)
        alone = np.flatnonzero(counts[index] < 0)
        out[alone] = alone.astype(np.uint64)
        return out

    def merge(self, symbols, alive, starts, sizes, width: int, keys, dropout: float) -> None:
        n = len(starts)
        columns = np.arange(width)
        inside = columns < sizes[:, None]
        at = np.where(inside, starts[:, None] + columns, 0)
        table = np.where(inside, symbols[at], self.size)
        table = np.concatenate([table, np.full((n, 1), self.size, dtype=table.dtype)], axis=1)
        piece = self.join(table[:, :-1].ravel(), table[:, 1:].ravel()).reshape(n, width)
        piece[columns + 1 >= sizes[:, None]] = self.size
        after = np.broadcast_to(columns + 1, (n, width)).copy()
        before = np.broadcast_to(columns - 1, (n, width)).copy()
        # a candidate is known by its span, so the hash is the same in whatever order it comes up
        rank = self.allowed(piece, keys[:, None], columns[None, :], columns[None, :] + 2, dropout)
        rank = np.where(piece == self.size, NEVER, rank)
        live = inside.copy()
        rows = np.arange(n)
        while len(rows):
            best = np.argmin(rank[rows], axis=1)
            go = rank[rows, best] != NEVER
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            gone = after[rows, best]
            table[rows, best] = piece[rows, best]
            live[rows, gone] = False
            rank[rows, gone] = NEVER
            nxt = after[rows, gone]
            after[rows, best] = nxt
            has = nxt < sizes[rows]
            r, p, q = rows[has], best[has], nxt[has]
            before[r, q] = p
            for r, p, q in ((rows, best, nxt), self._left(rows, best, before)):
                end = np.where(q < sizes[r], after[r, np.minimum(q, width - 1)], 0)
                new = self.join(table[r, p], table[r, np.minimum(q, width)])
                new = np.where(q < sizes[r], new, self.size)
                piece[r, p] = new
                score = self.allowed(new, keys[r], p, end, dropout)
                rank[r, p] = np.where(new == self.size, NEVER, score)
        symbols[at[inside]] = table[:, :-1][inside]
        alive[at[inside]] = live[inside]

    @staticmethod
    def _left(rows, best, before):
        p = before[rows, best]
        there = p >= 0
        return rows[there], p[there], best[there]

    def merge_long(self, symbols, alive, start: int, size: int, key, dropout: float) -> None:
        """One chunk of any length, by an agenda kept in a heap."""
        import heapq

        ids = symbols[start : start + size].tolist()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        dead = [False] * size
        left = np.arange(size - 1)
        piece = self.join(np.array(ids[:-1]), np.array(ids[1:]))
        rank = self.allowed(piece, np.full(size - 1, key, dtype=np.uint64), left, left + 2, dropout)
        good = (piece != self.size) & (rank != NEVER)
        agenda = [(int(rank[i]), int(i), int(i) + 1, int(i) + 2, int(piece[i])) for i in np.flatnonzero(good)]
        heapq.heapify(agenda)
        one = np.full(1, key, dtype=np.uint64)

        def offer(p: int, q: int) -> None:
            end = after[q]
            new = self.join(np.array([ids[p]]), np.array([ids[q]]))
            if new[0] != self.size:
                r = self.allowed(new, one, np.array([p]), np.array([end]), dropout)[0]
                if r != NEVER:
                    heapq.heappush(agenda, (int(r), p, q, end, int(new[0])))

        while agenda:
            _, p, q, end, new = heapq.heappop(agenda)
            if dead[p] or dead[q] or after[p] != q or after[q] != end:
                continue
            ids[p], dead[q], after[p] = new, True, end
            if end < size:
                before[end] = p
                offer(p, end)
            if before[p] >= 0:
                offer(before[p], p)
        symbols[start : start + size] = ids
        alive[start : start + size] = ~np.array(dead)

    def encode(self, texts: pa.Array, doc_keys: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        texts = pc.fill_null(texts, "")
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        spaced = pc.binary_join_element_wise(" ", texts, "").combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.binary_join_element_wise(" ", texts, "")
        offsets = np.frombuffer(spaced.buffers()[1], dtype=np.int32)[spaced.offset : spaced.offset + len(spaced) + 1].astype(np.int64)
        data = np.frombuffer(spaced.buffers()[2], dtype=np.uint8)[: offsets[-1]] if spaced.buffers()[2] else np.zeros(0, np.uint8)
        cut = np.zeros(len(data) + 1, dtype=bool)
        space, line = data == 0x20, data == 0x0A
        cut[:-1] = (space & ~np.concatenate([[False], space[:-1]])) | line if len(data) else False
        cut[1:] |= line  # no piece holds a line break: a chunk of its own
        cut[offsets] = True
        begins = np.flatnonzero(cut[:-1])
        ends = np.concatenate([begins[1:], [len(data)]]).astype(np.int64) if len(begins) else begins
        doc = np.searchsorted(offsets, begins, side="right") - 1
        keep = full[doc] if len(doc) else np.zeros(0, bool)
        bounds = np.concatenate([begins, ends[-1:]]).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds.tobytes()), spaced.buffers()[2]) if len(begins) else pa.array([], pa.string())
        coded = chunks.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        names = coded.dictionary.to_pylist()
        keys = chunk_keys(coded.dictionary)[index]
        if dropout > 0:
            place = np.arange(len(begins)) - np.repeat(np.searchsorted(doc, np.arange(len(spaced))), np.bincount(doc, minlength=len(spaced)))
            keys = mixed(mixed(mixed(keys, doc_keys[doc]), place), seed)
            mask = self.masks(names, index, keys, dropout)
            order = np.lexsort((mask, index))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (index[order][1:] != index[order][:-1]) | (mask[order][1:] != mask[order][:-1])
            first = order[new]
            inverse = np.empty(len(order), dtype=np.int64)
            inverse[order] = np.cumsum(new) - 1
        else:
            _, first, inverse = np.unique(index, return_index=True, return_inverse=True)
        ids, counts = self.segment([names[i] for i in index[first].tolist()], keys[first], dropout)
        heads = np.cumsum(counts) - counts
        inverse, doc = inverse[keep], doc[keep]
        out = ids[ragged(heads[inverse], counts[inverse])]
        return out, np.bincount(doc, counts[inverse], minlength=len(spaced)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts whose ids are given one after another."""
        size = self.piece_size[ids]
        data = self.piece_bytes[ragged(self.piece_start[ids], size)]
        owner = np.repeat(np.arange(len(counts)), counts)
        lengths = np.bincount(owner, size, minlength=len(counts)).astype(np.int64)
        ends = np.cumsum(lengths)
        lead = np.zeros(len(data), dtype=bool)
        lead[(ends - lengths)[lengths > 0]] = True  # the space put in front
        offsets = np.concatenate([[0], np.cumsum(lengths - (lengths > 0))]).astype(np.int32)
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[~lead].tobytes()))


def chunk_keys(words: pa.Array) -> np.ndarray:
    """A 64-bit key of each string, by its bytes."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if words.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(data.astype(np.uint64) + np.uint64(1), place + 1), dtype=np.uint64)])
    with np.errstate(over="ignore"):
        return mixed(total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]], size)


_LOADED: dict[int, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """One set of tables for each Python worker and model."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(model)
    return _LOADED[key]


def read_model(path: str) -> bytes:
    """The model file, read on the driver; a vocabulary is bounded in size."""
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dropout: float = DROPOUT,
    seed: int = SEED,
    model: str = MODEL,
    keep: list[str] | None = None,
    copy_col: str | None = None,
) -> DataFrame:
    """Columns `keep` (all by default), `token_ids` and `lossless` (decoding gave the text back).

    `copy_col` numbers the rows of a document that is there several times, so that each has draws of its own.
    """
    keep = docs.columns if keep is None else keep
    ids_name, lossless = fresh(docs, "token_ids", "lossless")
    key, text = fresh(docs, "key_", "text_")
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    source = docs.select(
        *map(quoted, keep),
        F.xxhash64(F.coalesce(quoted(id_col).cast("string"), F.lit("")), *([] if copy_col is None else [quoted(copy_col)])).alias(key),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias(text),
    )
    names = [*keep, ids_name, lossless]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.string())
            keys = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).view(np.uint64)
            ids, counts = words.encode(texts, keys, dropout, seed)
            same = pc.equal(words.decode(ids, counts), texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists, same], names=names)

    schema = source.drop(key, text).schema.add(ids_name, ArrayType(IntegerType())).add(lossless, "boolean")
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """All columns and the decoded text; null ids decode to an empty text."""
    (name,) = fresh(encoded, out_col)
    (last,) = fresh(encoded, "ids_")
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model))
    source = encoded.withColumn(last, F.coalesce(quoted(ids_col), F.array().cast("array<int>")))
    names = [*encoded.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            texts = words.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=names)

    return source.mapInArrow(run, encoded.schema.add(name, "string"))
