"""Exact top-k search by distributed histogram selection.

All scores of a query are integers in a known range. Each round scores every pair of blocks, counts
scores in the bins of the query's current range and finds the bin of the k-th score; that bin is the
next range, until a bin is one score wide. A last pass keeps what reaches the k-th score and breaks
ties by id. Queries and candidates meet in blocks; a task of that join holds a bounded group of blocks of
queries, which can spill, and reads blocks of candidates one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.llm.common import quoted
from skein.session import reliable

K, BINS = 5, 1024
QUERY_ROWS, CANDIDATE_ROWS = 512, 4096
QUERY_BLOCKS = 16  # of queries that meet candidates together
_LOW = -(1 << 62)


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or not-a-number component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, factor: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("double"))


def _pack(rows: DataFrame, block: str) -> DataFrame:
    """(block, ids, width, values): the rows of a block as bytes; shorter vectors end in zeros."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        vectors = part.column("vec").to_pylist()
        width = max(map(len, vectors))
        values = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            values[i, : len(v)] = v
        ids = np.array(part.column("id").to_pylist(), np.int64)
        return pa.table({
            "block": pa.array([part.column("block")[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()]),
            "width": pa.array([width], pa.int32()), "values": pa.array([values.tobytes()]), "norm": pa.array([float(np.sqrt((values**2).sum(axis=1).max()))]),
        })

    return rows.withColumn("block", F.expr(block)).groupBy("block").applyInArrow(run, "block bigint, ids binary, width int, values binary, norm double")


def _matrix(ids: bytes, width: int, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    return keys, np.frombuffer(values, np.float64).reshape(len(keys), width)


def scores(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact; beyond 64 bits the nearest one."""
    width = max(candidates.shape[1], queries.shape[1])
    candidates, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (candidates, queries))
    top = np.abs(candidates).max(initial=0) * np.abs(queries).max(initial=0) * max(width, 1)
    if top < 2.0**53:
        return (candidates @ queries.T).astype(np.int64)
    if top < 2.0**63:
        return candidates.astype(np.int64) @ queries.astype(np.int64).T
    whole = [[int(x) for x in row] for row in queries]
    found = [[sum(int(a) * b for a, b in zip(c, q)) for q in whole] for c in candidates]
    return np.array([[min(max(x, -(2**63)), 2**63 - 1) for x in row] for row in found], np.int64).reshape(len(candidates), len(queries))


def _meet(candidates: DataFrame, queries: DataFrame, groups: int, asked: int) -> DataFrame:
    """Each block of queries with each block of candidates, by merge join on (group of candidates, group of queries).

    A group of queries is QUERY_BLOCKS blocks on average; a task holds the query blocks of one key at a time, and
    spills them where they are too many. Queries are copied once for each group of candidates, and the other way round.
    """
    sides = max(1, -(-asked // QUERY_BLOCKS))
    left = candidates.select(
        F.pmod("block", F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"),
        F.col("ids").alias("c_ids"), F.col("width").alias("c_width"), F.col("values").alias("c_values"),
    )
    right = queries.select("*", F.pmod("block", F.lit(sides)).cast("int").alias("side"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    return left.join(right.hint("merge"), ["group", "side"])


def _histogram(pairs: DataFrame, k: int, bins: int) -> DataFrame:
    """(query, bin, n): scores in the bins of each query's range, from its top down to what can matter.

    A bin below the block's own k-th score cannot hold the k-th of all, so it is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, values = _matrix(r["c_ids"], r["c_width"], r["c_values"])
                asked, wanted = _matrix(r["ids"], r["width"], r["values"])
                low, span, need = (np.frombuffer(r[n], np.int64) for n in ("low", "span", "need"))
                size = -(-span // bins)
                s = scores(values, wanted)
                out = s < low
                out |= s >= low + span
                out |= keys[:, None] == asked
                b = np.where(out, -1, (s - low) // size)
                at = max(len(keys) - k, 0)
                floor = np.partition(b, at, axis=0)[at]
                c, q = np.nonzero((b >= floor) & (b >= 0) & (need > 0))
                pair, n = np.unique(q * bins + b[c, q], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(asked[pair // bins]), pa.array(pair % bins), pa.array(n.astype(np.int64))], ["query", "bin", "n"])

    return pairs.mapInArrow(run, "query bigint, bin bigint, n bigint").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _finish(pairs: DataFrame, k: int) -> DataFrame:
    """(query, id, score): of each pair of blocks the best k that reach the query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, values = _matrix(r["c_ids"], r["c_width"], r["c_values"])
                asked, wanted = _matrix(r["ids"], r["width"], r["values"])
                low = np.frombuffer(r["low"], np.int64)
                s = scores(values, wanted)
                c, q = np.nonzero((s >= low) & (keys[:, None] != asked))
                found = s[c, q]
                order = np.lexsort((keys[c], -found, q))
                c, q, found = c[order], q[order], found[order]
                begin = np.searchsorted(q, np.arange(len(asked)))
                best = np.arange(len(q)) - begin[q] < k
                yield pa.RecordBatch.from_arrays([pa.array(asked[q[best]]), pa.array(keys[c[best]]), pa.array(found[best])], ["query", "id", "score"])

    return pairs.mapInArrow(run, "query bigint, id bigint, score bigint")


def search(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", bins: int = BINS, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with the other rows.

    ``vector`` holds whole numbers as doubles. Ties go to the smaller id. A query with fewer than k
    candidates gets them all. Rows of a null id or vector take no part; rows with the query's id are
    its own and no candidates, of several only one is asked (the smallest vector). Vectors of other
    lengths count as ending in zeros. Other columns are not read. An empty table gives an empty one.
    """
    rows = vectors.where(quoted(vec_id).isNotNull() & quoted(vector).isNotNull()).select(
        quoted(vec_id).cast("long").alias("id"), quoted(vector).alias("vec"), is_query.alias("asked")
    )
    total = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    n, asked = total[0], total[1] or 0
    blocks = max(1, -(-n // candidate_rows))
    held = reliable(_pack(rows.drop("asked"), f"pmod(xxhash64(id, 1), {blocks})"))
    wide = rows.where("asked").groupBy("id").agg(F.min("vec").alias("vec"))
    wanted = reliable(_pack(wide, f"pmod(xxhash64(id, 2), {max(1, -(-asked // query_rows))})"))
    asked_blocks = max(1, -(-asked // query_rows))
    groups = min(blocks, max(1, 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    longest = held.agg(F.max("norm")).first()[0] or 0.0

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, values = _matrix(r["ids"], r["width"], r["values"])
                reach = np.minimum(np.ceil(np.sqrt((values**2).sum(axis=1)) * longest * (1 + 1e-9)) + 1, 2.0**61).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(-reach), pa.array(2 * reach + 1), pa.array(np.full(len(keys), k))], ["query", "low", "span", "need"]
                )

    state = reliable(wanted.mapInArrow(start, "query bigint, low bigint, span bigint, need bigint"))
    while True:
        pairs = _meet(held, _with_state(wanted, state, query_rows), groups, asked_blocks)
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        hit = (
            _histogram(pairs, k, bins)
            .withColumn("above", F.sum("n").over(down))
            .join(state, "query")
            .where((F.col("above") >= F.col("need")) & (F.col("above") - F.col("n") < F.col("need")) & (F.col("need") > 0))
            .select("query", "bin", (F.col("above") - F.col("n")).alias("above"))
        )
        size = F.ceil(F.col("span") / bins).cast("long")  # of a bin
        found = F.col("bin").isNotNull()
        done = F.col("need") <= 0  # settled, or fewer than k candidates
        state = reliable(state.join(hit, "query", "left").select(
            "query",
            F.when(done, F.col("low")).when(found, F.col("low") + F.col("bin") * size).otherwise(F.lit(_LOW)).alias("low"),
            F.when(done | ~found, F.col("span")).otherwise(F.least(size, F.col("span") - F.col("bin") * size)).alias("span"),
            F.when(done | ~found | (size == 1), F.lit(0)).otherwise(F.col("need") - F.col("above")).cast("long").alias("need"),
        ))
        if state.where("need > 0").isEmpty():
            break
    best = _finish(_meet(held, _with_state(wanted, state, query_rows), groups, asked_blocks), k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"
    )


def _with_state(wanted: DataFrame, state: DataFrame, query_rows: int) -> DataFrame:
    """Blocks of queries with the ranges of their queries, in the order of the block."""
    parts = wanted.count() or 1
    block = f"pmod(xxhash64(query, 2), {parts})"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        keys = np.frombuffer(left.column("ids")[0].as_py(), np.int64)
        right = right.combine_chunks()
        order = np.argsort(right.column("query").to_numpy())
        at = order[np.searchsorted(right.column("query").to_numpy()[order], keys)]
        for n in ("low", "span", "need"):
            left = left.append_column(n, pa.array([right.column(n).to_numpy()[at].astype(np.int64).tobytes()]))
        return left

    return wanted.groupBy("block").cogroup(state.withColumn("block", F.expr(block)).groupBy("block")).applyInArrow(
        run, "block bigint, ids binary, width int, values binary, norm double, low binary, span binary, need binary"
    )
