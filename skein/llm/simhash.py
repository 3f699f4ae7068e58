"""SimHash fingerprints and exact near-duplicate links through vantage-point trees.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit in one of their halves.
Each half has a vantage-point tree of its own: a node splits by the Hamming distance to a vantage
point, and a ball of radius 1 enters a branch only where the triangle inequality leaves room. The
upper levels, learnt from a bounded sample, deal all fingerprints to shards. A leaf of theirs that
holds too many is split further, at vantage points that follow from the place in the tree, so that
shards stay small while the tree that is broadcast does not grow. A fingerprint is stored in its own
shard and sent as a query to later shards that its ball overlaps. In a shard the tree is carried on
down to small leaves, where the whole 64 bits decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.common import LOWER_ASCII, as_bytes, drawn, fresh, quoted, small_batches
from skein.llm.components import components
from skein.session import reliable

SHINGLE, SEED, MAX_BITS = 3, 42, 3
PARTS, PART_BITS = 2, 32
#: Fingerprints a shard should hold, fingerprints the upper levels are learnt from, and the largest
#: part of a shard that one task stores (a shard that no split makes smaller is dealt to several).
SHARD_ROWS, VANTAGE_SAMPLE, TASK_ROWS = 8_192, 20_000, 16_384
LEAF_PAIRS = 1 << 16
BLOCK_PAIRS = 1 << 20
#: Distance that about halves halves around a vantage point drawn at random.
MIDDLE = PART_BITS // 2
#: Bits of a shard's number for its place below the leaf of the upper levels.
_BELOW = 40


# ------------------------------------------------------------------ fingerprints


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits, each set if it is set in more than half of the hashes of the word shingles."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - size + 1, 1)
    hashed = xxhash.xxh64_intdigest
    last = ends[min(size, len(words)) - 1 :].tolist()
    values = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(values[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def add_fingerprint(docs: DataFrame, out: str, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Add the fingerprint of the whole text as a bigint; null and empty texts have 0."""

    def run(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t, size) for t in as_bytes(texts)], dtype=np.uint64)
        return pa.array(_signed(found), pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return small_batches(docs).withColumn(out, F.arrow_udf(run, "bigint").asNondeterministic()(quoted(text)))


# ------------------------------------------------------------------ vantage-point trees


def half(values: np.ndarray, part: int) -> np.ndarray:
    return ((values >> np.uint64(part * PART_BITS)) & np.uint64(2**PART_BITS - 1)).astype(np.uint32)


def _split(points: np.ndarray) -> tuple[np.uint32, int] | None:
    """A vantage point and the distance up to which points are inside; None if none parts them."""
    tries = points[:: max(1, len(points) // 8)][:8]
    best = None
    for v in tries:
        d = np.bitwise_count(points ^ v)
        inside = np.cumsum(np.bincount(d, minlength=PART_BITS + 1))[:-1]
        cut = int(np.argmin(np.abs(2 * inside - len(points))))
        off = abs(2 * int(inside[cut]) - len(points))
        if 0 < inside[cut] < len(points) and (best is None or off < best[0]):
            best = off, v, cut
    return best and best[1:]


def grow(sample: np.ndarray, shards: int) -> list:
    """Upper levels over the sampled halves: nested [vantage, cut, inside, outside], leaves are ids."""
    leaves = iter(range(1 << 30))
    limit = max(len(sample) // max(shards, 1), 8)

    def node(points):
        found = _split(points) if len(points) > limit else None
        if found is None:
            return next(leaves)
        near = np.bitwise_count(points ^ found[0]) <= found[1]
        return [found[0], found[1], node(points[near]), node(points[~near])]

    return node(sample)


def visits(tree, halves: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, positions whose ball overlaps it, whether the leaf is their own)."""
    stack = [(tree, np.arange(len(halves)), np.ones(len(halves), bool))]
    while stack:
        node, at, own = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, list):
            yield node, at, own
            continue
        d = np.bitwise_count(halves[at] ^ node[0]).astype(np.int16)
        near, far = d - radius <= node[1], d + radius > node[1]
        stack.append((node[2], at[near], (own & (d <= node[1]))[near]))
        stack.append((node[3], at[far], (own & (d > node[1]))[far]))


def _vantage(leaf: int, node: np.ndarray) -> np.ndarray:
    """The vantage point of each node below a leaf: bits mixed from its place."""
    x = (node.astype(np.uint64) + np.uint64(leaf << _BELOW)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def places(tree, deeper: dict[int, int], halves: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, shard, whether the shard is its own) for all shards that the balls overlap.

    ``deeper`` has the levels by which a leaf of ``tree`` is split on; all its nodes of a level are
    gone through at once.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for leaf, at, own in visits(tree, halves, radius):
        node = np.ones(len(at), np.int64)
        for _ in range(deeper.get(leaf, 0)):
            d = np.bitwise_count(halves[at] ^ _vantage(leaf, node)).astype(np.int16)
            near, far = d - radius <= MIDDLE, d + radius > MIDDLE
            own = np.concatenate([(own & (d <= MIDDLE))[near], (own & (d > MIDDLE))[far]])
            at, node = np.concatenate([at[near], at[far]]), np.concatenate([2 * node[near], 2 * node[far] + 1])
        found.append((at, node + (leaf << _BELOW), own))
    return tuple(np.concatenate(x) for x in zip(*found))


class Roots:
    """Smallest member of each set, merged by arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if np.array_equal(up, self.of):
                    break
                self.of = up


def link_shard(stored: np.ndarray, asked: np.ndarray, part: int, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (fingerprint, smallest-numbered one linked to it) that connect what links in a shard.

    Compares ``stored`` with itself and with ``asked``, which is enough to connect all that links;
    links inside a set already connected are not repeated.
    """
    values = np.concatenate([stored, asked])
    halves, others = half(values, part), half(values, 1 - part)
    roots = Roots(len(values))
    radius = max_bits // PARTS
    stack = [(np.arange(len(stored)), np.arange(len(values)), False)]
    while stack:
        data, query, equal = stack.pop()
        if not len(data) or not len(query):
            continue
        if len(data) * len(query) > LEAF_PAIRS:
            points, reach = (others, max_bits) if equal else (halves, radius)
            found = _split(points[data])
            if found is not None:
                v, cut = found
                d, q = (np.bitwise_count(points[x] ^ v).astype(np.int16) for x in (data, query))
                stack.append((data[d <= cut], query[q - reach <= cut], equal))
                stack.append((data[d > cut], query[q + reach > cut], equal))
                continue
            if not equal:  # all halves agree, the other halves go on
                near = np.bitwise_count(halves[query] ^ halves[data[0]]) <= radius
                stack.append((data, query[near], True))
                continue
        rows = max(1, BLOCK_PAIRS // len(query))
        for i in range(0, len(data), rows):
            near = np.bitwise_count(values[data[i : i + rows], None] ^ values[None, query]) <= max_bits
            a, b = np.nonzero(near)
            roots.unite(data[i + a], query[b])
    moved = np.flatnonzero(roots.of != np.arange(len(values)))
    return values[moved], values[roots.of[moved]]


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS, sample: int = VANTAGE_SAMPLE, task_rows: int = TASK_ROWS) -> DataFrame:
    """(a, b): links that connect all distinct values of column ``fp`` within ``max_bits`` bits.

    ``fingerprints`` has to be fixed (checkpointed), it is read several times. Of it the driver gets
    at most ``sample`` values, the row count of each leaf of the trees over them, and that of each
    shard above ``task_rows``, which is one whose halves hardly differ.
    """
    spark = fingerprints.sparkSession
    total = fingerprints.count()
    shards = min(-(-total // shard_rows), max(sample // 16, 1))
    learnt = drawn(fingerprints, F.xxhash64("fp"), sample, total).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    radius = max_bits // PARTS
    trees = spark.sparkContext.broadcast([grow(half(learnt, p), shards) for p in range(PARTS)])

    def crowded(deeper: list[dict[int, int]]) -> list:
        """(part, shard, rows) of shards above ``task_rows``."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for p, tree in enumerate(trees.value):
                    shard, n = np.unique(places(tree, deeper[p], half(values, p), 0)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), p)), pa.array(shard), pa.array(n)], ["part", "shard", "n"])

        rows = fingerprints.select("fp").mapInArrow(count, "part bigint, shard bigint, n bigint")
        return rows.groupBy("part", "shard").agg(F.sum("n").alias("n")).where(F.col("n") > task_rows).collect()

    deeper: list[dict[int, int]] = [{} for _ in range(PARTS)]
    large = crowded(deeper)
    for r in large:
        deeper[r["part"]][r["shard"] >> _BELOW] = max(1, (-(-r["n"] // shard_rows) - 1).bit_length())
    if large:
        large = crowded(deeper)
    split = spark.sparkContext.broadcast([
        (np.array([k for k, _ in some], np.int64), np.array([n for _, n in some], np.int64))
        for some in (sorted((r["shard"], -(-r["n"] // task_rows)) for r in large if r["part"] == p) for p in range(PARTS))
    ])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p, tree in enumerate(trees.value):
                at, shard, own = places(tree, deeper[p], half(values, p), radius)
                home = np.zeros(len(values), np.int64)
                home[at[own]] = shard[own]
                keep = home[at] <= shard
                at, shard, own = at[keep], shard[keep], own[keep]
                keys, many = split.value[p]
                chunks, first = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
                if len(keys):
                    k = np.minimum(np.searchsorted(keys, shard), len(keys) - 1)
                    chunks = np.where(keys[k] == shard, many[k], 1)
                    # the low bits alone would leave equal halves together
                    mixed = values[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                    first = np.where(own, (mixed % chunks.astype(np.uint64)).astype(np.int64), 0)
                # a fingerprint is stored in one chunk of its shard, and sent as a query to all later ones
                copies = chunks - first
                row = np.repeat(np.arange(len(at)), copies)
                chunk = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies) + first[row]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(row), p, np.int32)), pa.array(shard[row]), pa.array(chunk), pa.array(_signed(values[at[row]])),
                    pa.array(own[row] & (chunk == first[row])),
                ], ["part", "shard", "chunk", "fp", "own"])

    def join(shard: pa.Table) -> pa.Table:
        values = shard.column("fp").to_numpy().view(np.uint64)
        own = shard.column("own").to_numpy()
        a, b = link_shard(values[own], values[~own], int(shard.column("part")[0].as_py()), max_bits)
        return pa.table({"a": pa.array(_signed(a), pa.int64()), "b": pa.array(_signed(b), pa.int64())})

    dealt = fingerprints.select("fp").mapInArrow(deal, "part int, shard bigint, chunk bigint, fp bigint, own boolean")
    return dealt.groupBy("part", "shard", "chunk").applyInArrow(join, "a bigint, b bigint")


# ------------------------------------------------------------------ classes of documents


def _marked(docs: DataFrame, doc_id: str, text: str, size: int, *more: Column) -> DataFrame:
    """(doc_id, fp) and ``more`` for every row of ``docs``, fixed in the checkpoint folder."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return reliable(add_fingerprint(rows, "fp", "text", size).select("doc_id", "fp", *more))


def _rooted(kinds: DataFrame, max_bits: int) -> DataFrame:
    """``kinds``, a row per fingerprint, with the ``root`` that its class shares (null: a class of one)."""
    roots = components(reliable(links(kinds, max_bits)))
    return kinds.join(roots.withColumnRenamed("node", "fp"), "fp", "left")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id among all documents reachable over links of at most
    ``max_bits`` differing bits, the document itself included (null only if no such document has an
    id). Copies share a fingerprint, so they meet as one; texts without words share fingerprint 0.
    Repeated rows all come back. An empty table gives an empty result. Other columns are not read.
    """
    marked = _marked(docs, doc_id, text, size)
    known = _rooted(reliable(marked.groupBy("fp").agg(F.min("doc_id").alias("first"))), max_bits)
    least = known.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("least"))
    known = known.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One document of each class: the one with the smallest id, null last, then of the smallest hash of its text.

    Classes are told apart by their root fingerprint, so documents without an id and different texts
    of one id each count in the class of their own text. Rows that agree in id and text are one
    document; one of them stays. Minima are combined before the shuffle.
    """
    key, own_text, n, row = fresh(docs, "class_key", "class_text", "class_rows", "class_row")
    text_key = F.coalesce(F.md5("text"), F.lit(""))
    marked = _marked(docs, doc_id, "text", SHINGLE, text_key.alias("text_key"))
    same = marked.groupBy("fp", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n")
    known = _rooted(reliable(same.groupBy("fp").agg(F.min(best).alias("best"))), MAX_BITS)
    # a root is a fingerprint of its class, so classes of one may stand under their own
    kept = known.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    kept = reliable(kept.select(F.col("best.doc_id").alias(key), F.col("best.text_key").alias(own_text), F.col("best.n").alias(n)))
    whole = docs.join(kept, quoted(doc_id).eqNullSafe(F.col(key)) & (text_key == F.col(own_text)), "inner")
    columns = [quoted(c) for c in docs.columns]
    out = whole.where(F.col(n) == 1).select(*columns)
    if kept.where(F.col(n) > 1).isEmpty():
        return out
    one = whole.where(F.col(n) > 1).groupBy(key, own_text).agg(F.first(F.struct(*columns)).alias(row))
    return out.unionByName(one.select(f"{row}.*"))
