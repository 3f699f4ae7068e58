"""Whitening of vectors: principal components by spectral divide and conquer, applied to every row.

Sums and the covariance are added up in tasks and then by dimension, so only one matrix of the vectors'
width reaches the driver, which splits it (``spectral``). The components, again no larger than that
matrix, go to the tasks with the function that applies them. No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.llm import spectral
from skein.llm.common import quoted

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Entries from this size on are refused: sums of a batch would leave 64 bits.
LIMIT = 2.0**32


@dataclass(frozen=True)
class Whitening:
    """Counts and sums of the fitted rows, and components as columns by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are usable, their scaled entries as integers, and which entries a row has itself.

    Rows that are null or hold null, infinite or not-a-number entries are not usable. Shorter vectors
    are filled up with entries of 0.
    """
    kept = column.is_valid().to_numpy(zero_copy_only=False)
    lists = column.filter(pa.array(kept))
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    own = np.arange(width) < sizes[:, None]
    c = np.zeros(own.shape)
    c[own] = flat
    fine = np.isfinite(c).all(axis=1)
    kept[kept] = fine
    c = c[fine]
    if c.size and np.abs(c).max() >= LIMIT:
        raise ValueError(f"vectors with entries of {LIMIT:g} or more cannot be summed exactly")
    return kept, np.floor(SCALE * c).astype(np.int64) + SHIFT, own[fine]


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=SHIFT)


def _totals(vectors: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Number of usable rows, and the exact sum of each dimension over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, counts = 0, [], []
        for batch in batches:
            kept, x, own = entries(batch.column(0))
            n += int(kept.sum())
            more = x.shape[1] - len(sums)
            sums, counts = sums + [0] * more, counts + [0] * more
            for d, (s, m) in enumerate(zip(np.where(own, x, 0).sum(axis=0).tolist(), own.sum(axis=0).tolist())):
                sums[d] += s
                counts[d] += m
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(sums)), pa.int32()), pa.array([n, *counts], pa.int64()), pa.array([Decimal(0), *map(Decimal, sums)], pa.decimal128(38, 0))],
            ["dim", "n", "total"],
        )

    parts = vectors.select(quoted(vector)).mapInArrow(run, "dim int, n bigint, total decimal(38,0)")
    rows = {r.dim: r for r in parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
    n = rows[-1].n if -1 in rows else 0
    dims = [rows[d] for d in range(len(rows) - 1)] if rows else []
    return n, [int(r.total) + SHIFT * (n - r.n) for r in dims]


def _products(vectors: DataFrame, vector: str, model: Whitening, whitened: bool) -> tuple[np.ndarray, np.ndarray]:
    """Means and mean products of the centred rows, or of the whitened ones (both have mean 0 but for rounding)."""
    width, mean = len(model.sums), model.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.values) if whitened else width
        out = np.zeros((size + 1, size))
        for batch in batches:
            y = _widened(entries(batch.column(0))[1], width) - mean
            if whitened:
                y = _project(y, model)
            out[0] += y.sum(axis=0)
            out[1:] += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], ["i", "row"])

    parts = vectors.select(quoted(vector)).mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = max((r.j for r in cells), default=-1) + 1
    out = np.zeros((size + 1, size))
    for r in cells:
        out[r.i, r.j] = r.v / model.n
    return out[0], out[1:]


def _project(y: np.ndarray, model: Whitening) -> np.ndarray:
    return y @ model.vectors / np.sqrt(model.values)


def fit(vectors: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> Whitening:
    """The k components of largest variance, over all usable rows; reads the rows twice.

    Components whose variance is 0 to double precision are left out, as no scaling makes them 1; so a
    table of no rows, of one row or of equal rows has none. A component's largest entry is positive.
    """
    n, sums = _totals(vectors, vector)
    none = Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    if not n or not sums:
        return none
    covariance = _products(vectors, vector, none, False)[1]
    trace = float(np.trace(covariance))
    values, found = spectral.largest(covariance, k)
    kept = values > len(sums) * np.finfo(float).eps * trace
    found = found[:, kept] * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])[kept]
    return Whitening(n, sums, values[kept], found, trace)


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity (no components: null)."""
    if not len(model.values):
        return None
    mean, square = _products(vectors, vector, model, True)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(len(mean))).max())


def _deviation(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum of (n * x - S)^2 of each row, exactly; null beyond 64 bits."""
    reach = model.n * np.abs(x).max(initial=0) + max(map(abs, model.sums), default=0)
    if len(model.sums) * float(reach) ** 2 >= 2.0**62:
        # The bound is loose, as rows are near the mean; the differences themselves may still fit.
        t = x.astype(object) * model.n - np.array(model.sums, object)
        if x.size and len(model.sums) * int(np.abs(t).max()) ** 2 < 1 << 63:
            return (t.astype(np.int64) ** 2).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(v * v for v in row) for row in t.tolist())]
    return ((x * model.n - np.array(model.sums, np.int64)) ** 2).sum(axis=1).tolist()


def whiten(vectors: DataFrame, model: Whitening, out: str = "whitened", deviation: str = "deviation", vector: str = "embedding") -> DataFrame:
    """Add ``out``, the row's projections on the components over their standard deviations, and ``deviation``.

    Both are null where the vector is null or has null, infinite or not-a-number entries. ``deviation``
    is the sum over dimensions of (n * x - S)^2, null beyond 64 bits. Shorter vectors are taken as ending
    in zeros, those longer than all fitted ones are refused. Repeated rows, ties and null ids are rows like
    others; an empty table stays empty; other columns pass through.
    """
    width = len(model.sums)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            kept, x, _ = entries(column)
            if x.shape[1] > width:
                raise ValueError("a vector is longer than those the components were fitted on")
            x = _widened(x, width)
            at = np.full(len(kept), -1)
            at[kept] = np.arange(len(x))
            rows = pa.StructArray.from_arrays(
                [pa.array(list(_project(x - model.mean, model)) if model.n else [[]] * len(x), pa.list_(pa.float64())), pa.array(_deviation(x, model), pa.int64())], ["w", "d"]
            )
            yield rows.take(pa.array([int(i) if i >= 0 else None for i in at], pa.int64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    both = F.arrow_udf(run, "struct<w: array<double>, d: bigint>").asNondeterministic()(quoted(vector))
    helper = "whitening"
    while helper.lower() in {c.lower() for c in [*vectors.columns, out, deviation]}:
        helper = f"_{helper}"
    return vectors.withColumn(helper, both).withColumns({out: quoted(helper)["w"], deviation: quoted(helper)["d"]}).drop(helper)


def digest(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component."""
    error = identity_error(vectors, model, vector)
    shares = [float(v / model.trace) for v in model.values] or [0.0]
    done = whiten(vectors.select(quoted(vec_id).alias("vec_id"), quoted(vector).alias("embedding")), model)
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
