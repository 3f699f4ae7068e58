"""Measures of two vertices over the index offsets around them that both lines have, for many pairs at once.

A vertex brings its window as one flat array: how many vertices there are before it, how many from it on, and the places
at the offsets from ``low`` to ``high``, 0 where the line has none. Values are added in the order of the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StructType

from skein.skew import halo_windows

STEP = 1 << 14           # pairs that are measured at a time


def windows(points: DataFrame, low: int, high: int) -> DataFrame:
    """Add ``_f``, the window of each vertex at the offsets in [low, high]; ``pt_idx`` is dense from 0 in each line."""
    near = halo_windows(
        points, {"_f": lambda w: F.collect_list(F.array("x", "y", "z")).over(w.rowsBetween(low, high))}, -low, high)
    before = F.least(F.col("pt_idx"), F.lit(-low))
    after = F.size("_f") - before

    def nothing(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0), (n * 3).cast("int"))

    told = F.array(before.cast("double"), after.cast("double"))
    return near.withColumn("_f", F.concat(
        told, nothing(F.lit(-low) - before), F.flatten("_f"), nothing(F.lit(high + 1) - after)))


class Windows:
    """Windows of many vertices; ``places`` is by offset, axis and vertex."""

    def __init__(self, lists: pa.ListArray):
        self.there = lists.is_valid().to_numpy(zero_copy_only=False)
        values = lists.flatten()
        flat = values.to_numpy(zero_copy_only=False).astype(float).reshape(int(self.there.sum()) or 1, -1)
        if not self.there.all():
            every = np.zeros((len(lists), max(flat.shape[1], 5)))
            every[self.there] = flat[: int(self.there.sum())]
            flat = every
        self.before, self.after = flat[:, 0].astype(np.int32), flat[:, 1].astype(np.int32)
        self.places = np.ascontiguousarray(flat[:, 2:].T).reshape(-1, 3, len(flat))
        self.lost = None
        if values.null_count:
            lost = np.zeros((len(lists), flat.shape[1]), bool)
            lost[self.there] = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, flat.shape[1])
            self.lost = lost[:, 2:].reshape(len(lists), -1, 3).any(axis=2).T


class Measure:
    """Columns that are told of a pair; ``drops`` if pairs without the first one are none."""

    drops = False
    kinds: tuple[tuple[str, DataType], ...] = (("variation", DoubleType()),)

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.kinds]

    @property
    def schema(self) -> StructType:
        out = StructType()
        for name, kind in self.kinds:
            out.add(name, kind)
        return out

    def of(self, a: Windows, b: Windows, i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> list[pa.Array]:
        parts = [self.some(a, b, i[k : k + STEP], j[k : k + STEP], dist[k : k + STEP]) for k in range(0, len(i), STEP)]
        return [pa.concat_arrays([p[c] for p in parts]) for c in range(len(self.kinds))]

    def some(self, a, b, i, j, dist) -> list[pa.Array]:
        raise NotImplementedError

    def offsets(self, a: Windows, b: Windows, i: np.ndarray, j: np.ndarray, upto: np.ndarray | None = None) -> Iterator[tuple]:
        """(offset, pairs that have it, their differences, whether a place is NULL); ``upto`` is the number of offsets from 0 on."""
        before, after = np.minimum(a.before[i], b.before[j]), np.minimum(a.after[i], b.after[j]) if upto is None else upto
        for k, o in enumerate(range(self.low, self.high + 1)):
            here = before >= -o if o < 0 else after > o
            if not here.any():
                continue
            gaps = [a.places[k, c][i] - b.places[k, c][j] for c in range(3)]
            lost = None
            if a.lost is not None or b.lost is not None:
                lost = np.zeros(len(i), bool)
                for w, at in ((a, i), (b, j)):
                    if w.lost is not None:
                        lost |= w.lost[k][at]
                lost &= here
            yield o, here, gaps, lost


def _length(gaps: list[np.ndarray]) -> np.ndarray:
    x, y, z = gaps
    return np.sqrt(x * x + y * y + z * z)


class ShapeVariation(Measure):
    """Sum of |(p_{i+o} - q_{j+o}) - (p_i - q_j)|."""

    def some(self, a, b, i, j, dist):
        middle = [a.places[-self.low, c][i] - b.places[-self.low, c][j] for c in range(3)]
        total, none = np.zeros(len(i)), np.zeros(len(i), bool)
        for _, here, gaps, lost in self.offsets(a, b, i, j):
            total += np.where(here, _length([g - m for g, m in zip(gaps, middle)]), 0.0)
            if lost is not None:
                none |= lost
        return [pa.array(total, mask=none)]


class _AboutMiddle(Measure):
    """Sum of (d_o - d_0)^2 over the window without its last offset."""

    def sums(self, a, b, i, j, dist):
        before, after = np.minimum(a.before[i], b.before[j]), np.minimum(a.after[i], b.after[j])
        total, none = np.zeros(len(i)), np.zeros(len(i), bool)
        for o, here, gaps, lost in self.offsets(a, b, i, j, after - 1):
            off = _length(gaps) - dist
            total += np.where(here, off * off, 0.0)
            if lost is not None:
                none |= lost & here
        return total, none, before + after


class PointSimilarity(_AboutMiddle):
    kinds = (("similarity", DoubleType()),)

    def __init__(self, low: int, high: int, empty: float):
        super().__init__(low, high)
        self.empty = empty

    def some(self, a, b, i, j, dist):
        total, none, n = self.sums(a, b, i, j, dist)
        return [pa.array(np.where(none, self.empty, total / n))]


class DistanceVariation(_AboutMiddle):
    def some(self, a, b, i, j, dist):
        total, none, n = self.sums(a, b, i, j, dist)
        return [pa.array(np.where(n > 2, total / np.maximum(n - 2, 1), 0.0), mask=none & (n > 2))]


class WindowFits(Measure):
    """Bit h - 1: d + alpha * mean |d_o - d| < separation over the 2h + 1 offsets up to h, which both lines have."""

    kinds = (("fits", LongType()),)

    def __init__(self, half: int, separation: float, alpha: float):
        super().__init__(-half, half)
        self.half, self.separation, self.alpha = half, separation, alpha

    def some(self, a, b, i, j, dist):
        offs, none = {}, {}
        reach = np.minimum(np.minimum(a.before[i], b.before[j]), np.minimum(a.after[i], b.after[j]) - 1)
        for o, _, gaps, lost in self.offsets(a, b, i, j):
            offs[o], none[o] = np.abs(_length(gaps) - dist), lost
        fits = np.zeros(len(i), np.int64)
        for h in range(1, int(reach.max(initial=0)) + 1):
            total, ok = np.zeros(len(i)), reach >= h
            for o in range(-h, h + 1):
                total += offs[o]
                if none[o] is not None:
                    ok &= ~none[o]
            ok &= dist + self.alpha * total / float(2 * h + 1) < self.separation
            fits |= ok.astype(np.int64) << (h - 1)
        return [pa.array(fits)]


class TwoTerms(Measure):
    """d_mid + alpha * mean |d_i - d_mid| over samples; none where a side has no samples."""

    drops = True
    kinds = (("_two", StructType().add("score", DoubleType()).add("similar", BooleanType())),)

    def __init__(self, half: int, alpha: float, separation: float):
        super().__init__(-half, half)
        self.half, self.alpha, self.separation = half, alpha, separation

    def some(self, a, b, i, j, dist):
        there = a.there[i] & b.there[j]
        total, lost_any, score = np.zeros(len(i)), np.zeros(len(i), bool), np.zeros(len(i))
        if there.any():
            mid = _length([a.places[self.half, c][i] - b.places[self.half, c][j] for c in range(3)])
            for k in range(2 * self.half + 1):
                total += np.abs(_length([a.places[k, c][i] - b.places[k, c][j] for c in range(3)]) - mid)
                for w, at in ((a, i), (b, j)):
                    if w.lost is not None:
                        lost_any |= w.lost[k][at]
            score = mid + self.alpha * (total / float(2 * self.half + 1))
        similar = pa.array(score < self.separation, mask=lost_any)
        return [pa.StructArray.from_arrays(
            [pa.array(score, mask=lost_any), similar], ["score", "similar"], mask=pa.array(~there))]
