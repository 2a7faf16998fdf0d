"""N-gram Jaccard join by parity sketches: documents linked where their shingle sets nearly agree.

A document's set holds its distinct shingles of `SHINGLE` words (lower-cased
A-Z); with fewer words, the whole sequence as one; without words it is empty and
linked with nothing. Two documents link when 100 * |A and B| >= 75 * |A or B|.

Sketch. Every shingle hash falls into one of K parts and is XORed into that
part's 64-bit word: a linear sketch in which an element that two sets share
cancels out. Each element of the symmetric difference can change one part only,
so the number of differing parts, like the Hamming distance of the one-bit
sketches used below, is at most |A xor B|, and linked sets of size a have at
most D = a // 3 of them (size a against its largest possible partner, 4a/3).

Pigeonhole. Of any D + k parts of a set that hold something, k must be equal in
a linked partner, and when both take their rarest, k are among both. Each
document therefore emits its D + k rarest part words, k = D // 4 + 1 (by a table of counts over all documents, hashed into 2^`TABLE_BITS` cells: a
broadcast of that many bytes whatever the input's size), so words of passages
that many documents share stay out wherever a text has others. K depends on a
size band (powers of four); a set whose partners may lie in the next band emits
for both. A set whose parts collide so much that fewer than D + k hold anything
adds one word for its band; only two such sets can miss each other otherwise.
A smaller partner emits fewer words, so a pair only has the k of its smaller set
in common: a node that does not share the k of its smallest possible partner (3a/4)
with any others at all drops out, as in large corpora most documents share a few
shingles with some other by chance.

Join. Equal sets share a fingerprint and are one node from the start. One
shuffle by part word finds words with two nodes or more; words that the table
shows as frequent are dealt out by node as well, so none of them meets in one
task. Nodes are packed into tiles of about `TILE` that share words, and only
tiles that share a word meet, each tile pair a bounded group. First the one-bit
sketches meet (two to eight bits an element, against 64 of the hashes) and nodes
without a partner within the Hamming bound drop out; then the sets of the rest
meet, links are verified exactly, and a spanning forest of them is returned,
never the pairs. Components come from the forests by alternating star
contraction.

Nodes are 64-bit fingerprints, checked by a second one on grouping.

Null and empty texts have n_shingles 0 and their own id as component. Rows that
repeat an id have a row each; a component's id is its smallest document id, a
null id counting only where there is no other. An empty table gives an empty
result. Columns beside id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, quoted
from .pieces import chunk_keys, mixed
from .toxicity import ragged

SHINGLE = 5
SHARE = (3, 4)  # Jaccard at least 3/4
TABLE_BITS, SLICES = 21, 64
TILE = 256
FREQUENT = 20_000  # rows of a part word above which it is dealt out by node as well
BROADCAST_ROWS = 1_000_000  # ids sent to every task at most; beyond it a shuffled join


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after another, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    words = chunk_keys(coded.dictionary)[coded.indices.to_numpy()]
    counts = np.bincount(row, minlength=len(lists))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the text's end
    hashes = words.copy()
    for k in range(1, SHINGLE):
        ahead = left > k
        hashes[ahead] = mixed(hashes[ahead], words[np.flatnonzero(ahead) + k])
    at = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (left >= SHINGLE) | (at == 0)  # a short text is one shingle from its first word
    hashes, row = hashes[starts], row[starts]
    order = np.argsort(hashes)
    order = order[np.argsort(row[order], kind="stable")]
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(lists))


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    out = []
    for key in (11, 23):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes, key), dtype=np.uint64)])
        ends = np.cumsum(counts)
        with np.errstate(over="ignore"):
            out.append(mixed(total[ends] - total[ends - counts], counts))
    return out[0], out[1]


def most_differing(size: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of a linked pair with a set of this size."""
    return size // 3


def asked(size: np.ndarray) -> np.ndarray:
    """How many part words a linked pair has to share among those it emits."""
    return most_differing(size) // 4 + 1


def smallest_partner(size: np.ndarray) -> np.ndarray:
    """Size of the smallest set that a set of this size may link with."""
    return -(-3 * size // 4)


def band_of(size: np.ndarray) -> np.ndarray:
    """Size band: 4^3 and below is 2, then one for each power of four."""
    out = np.full(len(size), 2)
    for k in range(3, 24):
        out[size >= 4**k] = k
    return out


def part_words(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, band and word of every part that holds something, for each band a row belongs to."""
    band = band_of(counts)
    above = band_of(counts * 4 // 3)
    rows_out, bands_out, words_out = [], [], []
    for bands in (band, np.where(above > band, above, -1)):
        use = (bands >= 0) & (counts > 0)
        if not use.any():
            continue
        element = np.repeat(use, counts)
        row = np.repeat(np.arange(len(counts)), counts)[element]
        parts = np.int64(4) ** (bands[row] + 1)
        part = (hashes[element] >> np.uint64(20)).astype(np.int64) % parts
        key = row * (np.int64(1) << 40) + part
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        word = np.bitwise_xor.reduceat(mixed(hashes[element][order], 5), first)
        row, part = key[first] >> 40, key[first] & ((np.int64(1) << 40) - 1)
        rows_out.append(row)
        bands_out.append(bands[row])
        words_out.append(mixed(mixed(word, part), bands[row]))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(bands_out), np.concatenate(words_out)


def rarest_words(hashes, counts, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and level of each row's D + asked rarest part words in each of its bands; level 255 marks an odd word."""
    row, band, word = part_words(hashes, counts)
    rarity = level[(word >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    order = np.lexsort((word, rarity, band, row))
    row, band, word, rarity = row[order], band[order], word[order], rarity[order]
    group = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (band[1:] != band[:-1])])) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([group, [len(row)]]))
    nth = np.arange(len(row)) - np.repeat(group, size)
    wanted = most_differing(counts) + asked(counts)
    keep = nth < wanted[row]
    short = size < wanted[row[group]]
    odd = mixed(np.full(short.sum(), 77, dtype=np.uint64), band[group[short]])
    return (
        np.concatenate([row[keep], row[group[short]]]),
        np.concatenate([word[keep], odd]),
        np.concatenate([rarity[keep], np.full(short.sum(), 255, dtype=np.uint8)]),
    )


def with_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))


def facts_and_counts(texts: DataFrame) -> DataFrame:
    """A row per document (id, n, fp, fp2), and rows that hold a slice of a task's counts of part words."""
    cells = (1 << TABLE_BITS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, dtype=np.int32)
        names = ["id", "n", "fp", "fp2", "slice", "counts"]
        for batch in batches:
            hashes, counts = shingle_sets(batch.column(1).cast(pa.string()))
            fp, fp2 = fingerprints(hashes, counts)
            _, _, word = part_words(hashes, counts)
            table += np.bincount((word >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(table)).astype(np.int32)
            size = len(counts)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(fp.view(np.int64)), pa.array(fp2.view(np.int64)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if table.any():
            packed = [zlib.compress(table[k * cells : (k + 1) * cells].tobytes(), 1) for k in range(SLICES)]
            nothing = pa.nulls(SLICES, pa.int64())
            columns = [nothing, nothing, nothing, nothing, pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, "id long, n long, fp long, fp2 long, slice int, counts binary")


def rarity_levels(found: DataFrame) -> np.ndarray:
    """A byte for each cell of the table: four steps for each doubling of its count."""
    cells = (1 << TABLE_BITS) // SLICES

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells, dtype=np.int64)
        for part in rows:
            for raw in part["counts"]:
                total += np.frombuffer(zlib.decompress(raw), dtype=np.int32)
        level = np.minimum(4 * np.log2(total + 1), 254).astype(np.uint8)
        yield pd.DataFrame({"slice": [key[0]], "level": [level.tobytes()]})

    slices = found.where("slice is not null").select("slice", "counts")
    out = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
    for row in slices.groupBy("slice").applyInPandas(add, "slice int, level binary").collect():
        out[row.slice * cells : (row.slice + 1) * cells] = np.frombuffer(row.level, dtype=np.uint8)
    return out


def emitted_words(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """word, fp, need, often: the rarest part words of every document that has a set, and how many must be shared."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)
    often = int(min(4 * np.log2(FREQUENT), 254))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = shingle_sets(batch.column(0).cast(pa.string()))
            fp, _ = fingerprints(hashes, counts)
            row, word, rarity = rarest_words(hashes, counts, shared.value)
            # a cell's count is an upper bound; one that only looks frequent costs a few rows more
            need = np.where(rarity == 255, 0, asked(smallest_partner(counts))[row]).astype(np.int32)
            columns = [pa.array(word.view(np.int64)), pa.array(fp[row].view(np.int64)), pa.array(need), pa.array(rarity >= often)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "fp", "need", "often"])

    return texts.select("text").mapInArrow(run, "word long, fp long, need int, often boolean")


def shared_words(words: DataFrame) -> DataFrame:
    """Distinct (word, fp) of the words that two nodes or more may share, for nodes that share enough."""
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("fp"), F.lit(997))).otherwise(F.lit(0)).cast("int")
    salted = words.select("word", "fp", "need", "often", salt.alias("salt"))
    group = Window.partitionBy("word", "salt")
    several = salted.withColumn("low", F.min("fp").over(group)).withColumn("high", F.max("fp").over(group))
    several = several.where("often or low <> high").groupBy("word", "fp").agg(F.min("need").alias("need"))
    several = cut_lineage(sharing_enough(several))
    # words whose other nodes have just dropped out
    alive = several.groupBy("word").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("word")
    return cut_lineage(sharing_enough(several.join(alive, "word", "left_semi")).select("word", "fp"))


def sharing_enough(words: DataFrame) -> DataFrame:
    """The rows of nodes that keep at least as many words as a linked pair shares; a node has few rows."""
    own = Window.partitionBy("fp")
    kept = words.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("least", F.min("need").over(own))
    return kept.where("n >= least").select("word", "fp", "need")


def distinct_meetings(members: DataFrame, who: str) -> DataFrame:
    """Members of one word for each distinct group of members; words with one member are left out."""
    print_of = members.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(who)).alias("x"), F.sum(F.xxhash64(F.lit(3), who) % 1000003).alias("y"))
    one = print_of.where("n > 1").groupBy("n", "x", "y").agg(F.min("word").alias("word")).select("word")
    return members.join(one, "word", "left_semi")


def tiles_of(members: DataFrame, size_of_tile: int = TILE) -> DataFrame:
    """fp, tile: nodes lie by the most crowded word they have, about `size_of_tile` in a tile.

    A crowd's nodes so fill whole tiles, and few tiles share a word.
    """
    crowd = members.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    label = members.join(crowd, "word").groupBy("fp").agg(F.max(F.struct("n", "word")).alias("label"))
    size = label.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / size_of_tile))
    return cut_lineage(label.join(size, "label").select("fp", F.xxhash64("label", salt).alias("tile")))


def tile_pairs(members: DataFrame, tiles: DataFrame) -> DataFrame:
    """Distinct (a, b) of tiles whose nodes share a word; (a, a) where two of its own nodes do."""
    placed = members.join(tiles, "fp").groupBy("word", "tile").agg(F.count(F.lit(1)).alias("n"))
    placed = cut_lineage(placed)
    within = placed.where("n > 1").select(F.col("tile").alias("a"), F.col("tile").alias("b"))
    several = distinct_meetings(placed.select("word", "tile"), "tile")
    left, right = several.select("word", F.col("tile").alias("a")), several.select("word", F.col("tile").alias("b"))
    across = left.join(right, "word").where("a < b").select("a", "b")
    return across.unionByName(within).distinct()


def chosen_documents(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, want: one document for each node."""
    chosen = facts.where("n > 0").join(nodes.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("id"))
    return cut_lineage(chosen.select("id", F.col("fp").alias("want")))


def of_documents(texts: DataFrame, chosen: DataFrame, what, schema: str) -> DataFrame:
    """fp and the columns that `what` makes of a set, for the chosen documents."""
    few = chosen.count() <= BROADCAST_ROWS
    picked = texts.join(F.broadcast(chosen) if few else chosen, texts["id"].eqNullSafe(chosen["id"])).select("text", "want")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = shingle_sets(batch.column(0).cast(pa.string()))
            fp, _ = fingerprints(hashes, counts)
            rows = np.flatnonzero(fp.view(np.int64) == batch.column(1).to_numpy(zero_copy_only=False))
            ends = np.cumsum(counts)
            made = [what(hashes[ends[k] - counts[k] : ends[k]]) for k in rows]
            columns = [pa.array(fp[rows].view(np.int64)), pa.array(counts[rows], pa.int64()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return picked.mapInArrow(run, schema)


def sketch_bits(band: int) -> int:
    """Bits of the one-bit sketches of a band: two to eight for each element."""
    return 2 * 4 ** (band + 1)


def one_bit_sketch(hashes: np.ndarray) -> bytes:
    """Each element flips one bit. Folding a sketch in halves by XOR gives the shorter sketch of the same set."""
    bits = sketch_bits(int(band_of(np.array([len(hashes)]))[0]))
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def with_near_partner(sizes: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Which sets have another whose size and sketch do not rule a link out."""
    bands = band_of(sizes)
    packed = {b: np.stack([np.frombuffer(sketches[k], dtype=np.uint64) for k in np.flatnonzero(bands == b)]) for b in np.unique(bands)}
    found = np.zeros(len(sizes), dtype=bool)
    for b, own in packed.items():
        here = np.flatnonzero(bands == b)
        for c in (b, b + 1):
            if c not in packed:
                continue
            there = np.flatnonzero(bands == c)
            other = packed[c]
            if c > b:  # folded to the shorter sketch
                other = np.bitwise_xor.reduce(other.reshape(len(other), -1, own.shape[1]), axis=1)
            step = max(1, 4_000_000 // max(1, other.size))
            for k in range(0, len(here), step):
                part = here[k : k + step]
                apart = np.bitwise_count(own[k : k + step, None, :] ^ other[None, :, :]).sum(axis=2, dtype=np.int64)
                total = sizes[part][:, None] + sizes[there][None, :]
                low = np.minimum(sizes[part][:, None], sizes[there][None, :])
                near = (7 * apart <= total) & (3 * (total - low) <= 4 * low) & (part[:, None] != there[None, :])
                found[part[near.any(axis=1)]] = True
                found[there[near.any(axis=0)]] = True
    return found


def survivors(sketches: DataFrame, tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, fp: the nodes of each tile pair that have a possible partner in it."""
    ends = pairs.select(F.xxhash64("a", "b").alias("pair"), F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    members = ends.join(tiles, "tile").select("pair", "fp").join(sketches, "fp")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("fp")
        return rows.loc[with_near_partner(rows["n"].to_numpy(), rows["sketch"].tolist()), ["pair", "fp"]]

    return cut_lineage(members.groupBy("pair").applyInPandas(run, "pair long, fp long"))


def links_within(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the smallest index that its links reach inside this list; intersections are counted exactly."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    uniq, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    both = many[column] > 1
    column, row = (np.cumsum(many > 1) - 1)[column[both]], owner[both]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n), dtype=np.int64)
    width = int((many > 1).sum())
    for k in range(0, width, 4096):
        a, b = np.searchsorted(column, [k, k + 4096])
        block = np.zeros((n, min(4096, width - k)), dtype=np.float32)
        block[row[a:b], column[a:b] - k] = 1
        common += (block @ block.T).astype(np.int64)
    linked = 7 * common >= 3 * (size[:, None] + size[None, :])
    label = np.arange(n)
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def forests(sets: DataFrame, near: DataFrame) -> DataFrame:
    """a, b: spanning forests of the links of every tile pair."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("fp").sort_values("fp")
        fp = rows["fp"].to_numpy()
        label = links_within([np.frombuffer(s, dtype=np.uint64) for s in rows["hashes"]])
        moved = label != np.arange(len(fp))
        return pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})

    return near.join(sets, "fp").groupBy("pair").applyInPandas(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of an edge.

    Alternating large-star and small-star contraction: every round is a few
    keyed shuffles, whatever the shape of the components.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        edges = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        rest = edges.join(low, "a").where("b <> low").select("b", "low").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b"))
        edges = cut_lineage(rest.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id."""
    texts = with_texts(docs, id_col, text_col)
    found = cut_lineage(facts_and_counts(texts))
    facts = found.where("slice is null").select("id", "n", "fp", "fp2")
    members = distinct_meetings(shared_words(emitted_words(texts, rarity_levels(found))), "fp")
    members = cut_lineage(members)
    tiles = tiles_of(members)
    chosen = chosen_documents(facts, tiles)
    sketches = cut_lineage(of_documents(texts, chosen, one_bit_sketch, "fp long, n long, sketch binary"))
    near = survivors(sketches, tiles, tile_pairs(members, tiles))
    wanted = cut_lineage(chosen.join(near.select(F.col("fp").alias("want")).distinct(), "want", "left_semi").select("id", "want"))
    sets = of_documents(texts, wanted, np.ndarray.tobytes, "fp long, n long, hashes binary")
    roots = connected(forests(sets.select("fp", "hashes"), near))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    nodes = facts.where("n > 0").groupBy("fp", "fp2", "n").agg(F.min("id").alias("low"))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "fp2", "n", "low", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("fp2")).alias("alone"))
    least = nodes.groupBy("root", "alone").agg(F.min("low").alias("component_id"))
    classes = nodes.join(least, nodes["root"].eqNullSafe(least["root"]) & nodes["alone"].eqNullSafe(least["alone"])).select("fp", "fp2", "n", "component_id")
    full = facts.where("n > 0").join(classes, ["fp", "fp2", "n"]).select("id", "n", "component_id")
    empty = facts.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id stands for its component; rows that repeat an id stay or go together."""
    classes = cut_lineage(components(docs, id_col, text_col))
    gone = classes.where(quoted(id_col) != F.col("component_id")).select(quoted(id_col).alias("id"))
    gone = gone.join(classes.where(quoted(id_col) == F.col("component_id")).select(quoted(id_col).alias("id")), "id", "left_anti").distinct()
    (name,) = fresh(docs, "gone_id")
    gone = cut_lineage(gone.select(F.col("id").alias(name)))
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, quoted(id_col) == F.col(name), "left_anti")
