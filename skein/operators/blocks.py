"""Nearest target per line in blocks: no pair of a query and a target is ever shuffled.

A query lies in one cell; a target is copied to every cell from which it may be met. Queries of a
cell come in blocks of about QUERIES rows, targets in shares of whole lines of about TARGETS rows, and
each block of a cell meets each share of it once, in a task, which gives out edges as it goes. So what is
shuffled grows with the rows and not with the pairs, and all edges of a query and a share come one after
another: sums and counts by query are combined before their shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from skein.operators.profiles import Measure, Windows
from skein.session import BATCH_BYTES, reliable

QUERIES, TARGETS, BLOCKS = 1 << 12, 1 << 16, 4    # rows of a block, of a share, blocks that meet one copy of a share
PAIRS, TILE = 1 << 20, 64                         # pairs and queries that are compared at a time
SHARE, TEAM = "_share", "_team"
CHORD = ["n_dx", "n_dy", "n_dz"]                  # direction of a target that is a segment, or a vertex of one


def block_edges(
    queries: DataFrame,
    targets: DataFrame,
    cell: Sequence[str],
    radius: float | None,
    key: Sequence[str],
    own: str | None = "line_id",
    earlier: bool = False,
    limit: int | None = None,
    asks: Sequence[str] = (),
    gives: Sequence[str] = (),
    cosine: float | None = None,
    codes: bool = False,
    crowded: int = 64,
    most: int = TARGETS,
    max_sq: float | None = None,
    vertices: bool = False,
    projected: bool = False,
    ranked: bool = False,
    measure: Measure | None = None,
) -> DataFrame:
    """(key, asks, nbr_line, nbr_id, gives, dist): each query's nearest target of each other line.

    ``asks`` and ``gives`` are columns of the query and of the target that come along. ``radius`` None
    takes every target of the cell. With ``cosine`` a pair counts if |tx, ty, tz . n_tx, n_ty, n_tz| is
    at least that, with ``codes`` if the arrays ``_codes`` and ``_n_codes`` agree in some place. ``limit``
    keeps the nearest lines of each query and share, so that the caller has few rows left to rank. Lines of more
    than ``crowded`` vertices in a share are first met by the boxes of that many vertices. ``max_sq`` is the square of the
    radius where that is what is given.

    With ``vertices`` a target is a segment that brings its vertices, by index, as the array ``_v`` of (nbr_pt, along, x, y, z and
    further columns) and its direction n_dx, n_dy, n_dz. An edge to it then tells, in place of nbr_id, the fields of the vertex that is
    nearest by projection on that direction, and its distance. With ``projected`` a target is a vertex of such a
    segment, the ``_nth`` of the array ``_along``, and counts only if it is the nearest one by projection.

    With ``ranked`` the ``limit`` nearest lines of each query come with their ``rank`` from 1. Where one share holds all
    targets of a cell, a task knows them; only edges of cells with several shares are ranked after a shuffle. A ``measure``
    is taken of each edge by the arrays ``_f`` and ``n__f`` of both sides, in the task, and its columns come along.
    """
    cell, key, asks, gives = list(cell), list(key), list(asks), list(gives)
    spark = queries.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if own:
        queries, targets = queries.where(F.col(own).isNotNull()), targets.where(F.col("nbr_line").isNotNull())
    if radius is not None:  # NaN is within no radius, and would hide the places next to it
        queries = queries.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
        targets = targets.where(~(F.isnan("nx") | F.isnan("ny") | F.isnan("nz")))
    vector = ["tx", "ty", "tz"] if cosine is not None else []
    q_cols = list(dict.fromkeys([*key, *([own] if own else []), "x", "y", "z", *vector, *(["_codes"] if codes else []), *asks]))
    t_cols = ["nbr_id", "nbr_line", "nx", "ny", "nz", *[f"n_{c}" for c in vector], *(["_n_codes"] if codes else [])]
    t_cols += [*CHORD, "_v"] if vertices else [*CHORD, "_along", "_nth"] if projected else []
    framed = ["_f"] if measure is not None else []
    q_cols, t_cols = list(dict.fromkeys([*q_cols, *framed])), list(dict.fromkeys([*t_cols, *gives, *[f"n_{c}" for c in framed]]))
    load = queries.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("_blocks")).join(
        targets.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / most).alias("_shares")), cell)
    parts, at = int(spark.conf.get("spark.sql.shuffle.partitions")), [*cell, SHARE, TEAM]
    share, block = F.pmod(F.xxhash64("nbr_line"), F.col("_shares")), F.pmod(F.xxhash64(*key), F.col("_blocks"))
    whole = F.lit(0).cast("bigint")

    def meet(load: DataFrame) -> DataFrame:
        """Each block with each share of its cell; rows are shuffled once, to where they meet."""
        shares = targets.join(load, cell).select(
            *cell, share.alias(SHARE), F.struct(*t_cols).alias("_t"),
            F.explode(F.sequence(whole, F.floor((F.col("_blocks") - 1) / BLOCKS))).alias(TEAM))
        blocks = queries.join(load, cell).select(
            *cell, block.alias("_block"), F.floor(block / BLOCKS).alias(TEAM), F.struct(*q_cols).alias("_q"),
            F.explode(F.sequence(whole, F.col("_shares") - 1)).alias(SHARE))
        shares = shares.repartition(parts, *at).groupBy(*at).agg(F.array_sort(F.collect_list("_t")).alias("_t"))
        blocks = blocks.repartition(parts, *at).groupBy(*at, "_block").agg(F.collect_list("_q").alias("_q"))
        return blocks.join(shares, at).select("_q", "_t")

    q_type, t_type = queries.select(*q_cols).schema, targets.select(*t_cols).schema
    chosen = [f for f in t_type["_v"].dataType.elementType if f.name not in ("along", *"xyz")] if vertices else [t_type["nbr_id"]]
    out = StructType([q_type[c] for c in dict.fromkeys([*key, *asks])] + [t_type["nbr_line"], *chosen]
                     + [t_type[c] for c in dict.fromkeys(gives)])
    out = StructType([*[type(f)(f.name, f.dataType, True) for f in out]]).add("dist", DoubleType())
    measured = [] if measure is None else measure.names
    q_out, t_out = list(dict.fromkeys([*key, *asks])), list(dict.fromkeys(["nbr_line", *([] if vertices else ["nbr_id"]), *gives]))
    v_out = [f.name for f in chosen] if vertices else []
    r2 = max_sq if max_sq is not None else None if radius is None else float(radius) * float(radius)
    slice_rows = 1 << (13 if any(out[c].dataType.typeName() == "array" for c in [*asks, *gives]) else 16)

    def run(batches: Iterator[pa.RecordBatch], told: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, t in zip(batch.column(0), batch.column(1)):
                yield from _meet(q.values, t.values, told)

    def _meet(q: pa.StructArray, t: pa.StructArray, told: bool) -> Iterator[pa.RecordBatch]:
        share = _Share(t, own is not None, crowded, cosine is not None, codes, projected)
        held = _Vertices(t) if vertices else None
        places, lines = _numbers(q, ("x", "y", "z")), _whole(q.field(own)) if own else None
        near = None if radius is None else _by_place(places)
        along = _numbers(q, vector) if vector else None
        marks = _lists(q.field("_codes")) if codes else None
        frames = None if measure is None else (Windows(q.field("_f")), Windows(t.field("n__f")))
        # the nearest lines are found in place, unless the distance is told by vertices after that
        few = limit if held is None else None
        step = TILE if r2 is not None and not share.cut else max(1, min(TILE, PAIRS // max(1, len(share.low))))
        for lo in range(0, len(places), step):
            own_rows = np.arange(lo, min(lo + step, len(places))) if near is None else near[lo : lo + step]
            qi, ti, d = share.nearest(
                places[own_rows], None if lines is None else lines[own_rows], r2, earlier,
                None if along is None else along[own_rows], cosine, None if marks is None else marks[own_rows], few)
            lacks, vi = np.zeros(len(qi), bool), np.zeros(len(qi), np.int64)
            if held is not None:
                vi, d, lacks = held.nearest(places[own_rows][qi], share.place[ti])
            if limit is not None and len(qi):
                order = np.lexsort((share.line[ti], np.where(lacks, -np.inf, d), qi))
                qi, ti, d, lacks, vi = (c[order] for c in (qi, ti, d, lacks, vi))
                first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
                nth = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
                qi, ti, d, lacks, vi, nth = (c[nth < limit] for c in (qi, ti, d, lacks, vi, nth))
            else:
                nth = np.zeros(len(qi), np.int64)
            for a in range(0, len(qi), slice_rows):
                b = a + slice_rows
                i, j = pa.array(own_rows[qi[a:b]]), pa.array(share.place[ti[a:b]])
                v = pa.array(vi[a:b])
                columns = [*[q.field(c).take(i) for c in q_out], *[t.field(c).take(j) for c in t_out],
                           *[held.rows.field(c).take(v) for c in v_out], pa.array(d[a:b], mask=lacks[a:b])]
                if told:
                    columns.append(pa.array((nth[a:b] + 1).astype(np.int32)))
                if frames is not None:
                    columns += measure.of(*frames, own_rows[qi[a:b]], share.place[ti[a:b]], d[a:b])
                made = pa.RecordBatch.from_arrays(
                    columns, [*q_out, *t_out, *v_out, "dist", *(["rank"] if told else []), *measured])
                yield made if measure is None or not measure.drops else made.filter(made.column(measured[0]).is_valid())

    if vertices:  # in the order in which batches give them
        given = [*q_out, *t_out, *v_out]
        out = StructType([*[out[c] for c in given], out["dist"]])

    def edges(load: DataFrame, told: bool) -> DataFrame:
        schema = StructType([*out, *(StructType().add("rank", IntegerType()) if told else []),
                             *(measure.schema if measure is not None else [])])
        return meet(load).mapInArrow(lambda batches: run(batches, told), schema)

    if not ranked:
        return edges(load, False)
    load = reliable(load)
    if load.where("_shares > 1").isEmpty():
        return edges(load, True)
    nearest = Window.partitionBy(*key).orderBy("dist", "nbr_line")
    several = edges(load.where("_shares > 1"), False).withColumn("rank", F.row_number().over(nearest))
    return edges(load.where("_shares = 1"), True).unionByName(several.where(F.col("rank") <= limit))


def _numbers(rows: pa.StructArray, names: Sequence[str]) -> np.ndarray:
    return np.stack([rows.field(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)


def _whole(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(column: pa.Array) -> np.ndarray:
    return _whole(column.flatten()).reshape(len(column), -1)


def _all_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _first_least(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Position in each run (none is empty) of the first of its least values."""
    first = np.r_[0, np.cumsum(size)[:-1]]
    least = np.repeat(np.minimum.reduceat(values, first), size)
    return np.minimum.reduceat(np.where(values == least, np.arange(len(values)), len(values)), first) - first


class _Runs:
    """Arrays of places along a direction, and which of them are nearest to a place on it."""

    def __init__(self, lists: pa.ListArray, chord: pa.StructArray):
        offsets = lists.offsets.to_numpy().astype(np.int64)
        self.rows = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        self.start, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
        along = self.rows.field("along") if pa.types.is_struct(self.rows.type) else self.rows
        self.along, self.lost = along.to_numpy(zero_copy_only=False).astype(float), along.is_null().to_numpy(zero_copy_only=False)
        self.chord = _numbers(chord, CHORD)
        self.no_chord = np.logical_or.reduce([chord.field(c).is_null().to_numpy(zero_copy_only=False) for c in CHORD])

    def pick(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Number of the vertex nearest by projection of each place ``at``; as in SQL, NULL comes before and NaN after all."""
        out = np.zeros(len(rows), np.int64)
        upto = np.cumsum(self.size[rows])
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            p, r = at[lo:hi], rows[lo:hi]
            n, c = self.size[r], self.chord[r]
            q = p[:, 0] * c[:, 0] + p[:, 1] * c[:, 1] + p[:, 2] * c[:, 2]
            every = _all_of(self.start[r], n)
            off = np.abs(self.along[every] - np.repeat(q, n))
            off = np.where(np.isnan(off), np.inf, off)
            out[lo:hi] = _first_least(np.where(self.lost[every] | np.repeat(self.no_chord[r], n), -np.inf, off), n)
            lo = hi
        return out


class _Vertices(_Runs):
    """The vertices of segments."""

    def __init__(self, t: pa.StructArray):
        super().__init__(t.field("_v"), t)
        self.at = _numbers(self.rows, ("x", "y", "z"))
        self.bare = np.logical_or.reduce([self.rows.field(c).is_null().to_numpy(zero_copy_only=False) for c in "xyz"])

    def nearest(self, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chosen vertices of segments, their distances, and which of these are NULL."""
        v = self.start[rows] + self.pick(at, rows)
        x, y, z = (at[:, c] - self.at[v, c] for c in range(3))
        return v, np.sqrt(x * x + y * y + z * z), self.bare[v]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, new])


def _by_place(at: np.ndarray) -> np.ndarray:
    """An order in which rows that come together are near: by the places of ever smaller cells."""
    low, high = np.nanmin(at, axis=0), np.nanmax(at, axis=0)
    unit = (at - low) / np.where(high > low, high - low, 1.0)
    grid = np.clip(np.nan_to_num(unit * 1024.0), 0, 1023).astype(np.int64)
    morton = np.zeros(len(at), np.int64)
    for b in range(9, -1, -1):
        for c in range(3):
            morton = morton * 2 + (grid[:, c] >> b & 1)
    return np.argsort(morton, kind="stable")


class _Share:
    """Targets of whole lines, by line, in runs of at most ``crowded`` near ones with their boxes."""

    def __init__(self, t: pa.StructArray, own: bool, crowded: int, vectors: bool, codes: bool, projected: bool = False):
        at = _numbers(t, ("nx", "ny", "nz"))
        line = _whole(t.field("nbr_line") if own else t.field("nbr_line").dictionary_encode(null_encoding="encode").indices)
        order = np.argsort(line, kind="stable")
        start = _starts(line[order])
        size = np.diff(np.r_[start, len(order)])
        if len(size) and size.max() > crowded:
            near = np.empty(len(order), np.int64)
            near[_by_place(at)] = np.arange(len(order))
            order = np.lexsort((near, line))
        within = np.arange(len(order)) - np.repeat(start, size)
        self.start = np.flatnonzero(within % crowded == 0)
        self.size = np.diff(np.r_[self.start, len(order)])
        self.single = bool(len(start) == len(order))
        self.cut = len(start) != len(self.start)
        #: position among the targets as they came, which are ordered by id
        self.place, self.at, self.line = order, at[order], line[order]
        self.vectors = _numbers(t, ("n_tx", "n_ty", "n_tz"))[order] if vectors else None
        self.codes = _lists(t.field("_n_codes"))[order] if codes else None
        self.runs = _Runs(t.field("_along"), t) if projected else None
        self.nth = _whole(t.field("_nth")) if projected else None
        self.along_x = self.sorted_x = None
        self.low = np.minimum.reduceat(self.at, self.start) if len(order) else self.at
        self.high = np.maximum.reduceat(self.at, self.start) if len(order) else self.at

    def nearest(self, at, lines, r2, earlier, along, cosine, marks, few=None):
        """(query, target, distance) of the nearest target of each line; by query, then by line.

        Where only the ``few`` nearest lines of a query are asked for, farther ones may be left out, and queries need not be in order.
        """
        if few is not None and r2 is not None and not self.cut:
            return self._few(at, lines, r2, earlier, along, cosine, marks, few)
        if self.cut:
            q, v = self._in_boxes(at, lines, r2, earlier, along is None and marks is None and self.runs is None)
            x, y, z = (at[q, c] - self.at[v, c] for c in range(3))
            d2 = x * x + y * y + z * z
            ok = np.ones(len(q), bool) if r2 is None else d2 <= r2
        else:
            v, there = None, self.at
            if r2 is not None:  # targets that none of these queries reaches
                low, high = at.min(axis=0), at.max(axis=0)
                reach = r2**0.5 * (1.0 + 1e-9) + np.maximum(np.abs(low), np.abs(high)) * 1e-12
                v = self._in_box(low - reach, high + reach)
                there = there[v]
                if len(at) > 1 and len(at) * len(v) > PAIRS:
                    half = len(at) // 2
                    a, b = ([None if c is None else c[rows] for c in (at, lines, along, marks)] for rows in (slice(half), slice(half, None)))
                    first, second = (self.nearest(x[0], x[1], r2, earlier, x[2], cosine, x[3]) for x in (a, b))
                    return np.r_[first[0], second[0] + half], np.r_[first[1], second[1]], np.r_[first[2], second[2]]
            d2 = np.square(at[:, 0, None] - there[None, :, 0])
            for c in (1, 2):
                gap = at[:, c, None] - there[None, :, c]
                d2 += np.square(gap, out=gap)
            q, t = np.nonzero(np.ones(d2.shape, bool) if r2 is None else d2 <= r2)
            d2, v = d2[q, t], t if v is None else v[t]
            ok = np.ones(len(q), bool)
        if lines is not None:
            mine, other = lines[q], self.line[v]
            ok &= mine > other if earlier else mine != other
        if along is not None:
            a, b = along[q], self.vectors[v]
            ok &= np.abs(a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]) >= cosine
        if marks is not None:
            ok &= (marks[q] == self.codes[v]).any(axis=1)
        q, v, d2 = q[ok], v[ok], d2[ok]
        if self.runs is not None:
            ok = self.runs.pick(at[q], self.place[v]) == self.nth[self.place[v]]
            q, v, d2 = q[ok], v[ok], d2[ok]
        if not self.single and len(q):
            line = self.line[v]
            first = _starts(q, line)
            n = np.diff(np.r_[first, len(q)])
            if len(first) < len(q):
                several = np.repeat(n > 1, n)
                some = np.flatnonzero(several)
                n = n[n > 1]
                first = np.r_[0, np.cumsum(n)[:-1]]
                far = np.where(np.isnan(d2[some]), np.inf, d2[some])
                least = np.repeat(np.minimum.reduceat(far, first), n)
                place = np.where(far == least, self.place[v[some]], len(self.place))
                several[some[place == np.repeat(np.minimum.reduceat(place, first), n)]] = False
                q, v, d2 = q[~several], v[~several], d2[~several]
        return q, v, np.sqrt(d2)

    def _in_box(self, low, high):
        """Positions of the targets in a box."""
        if self.along_x is None:
            self.along_x = np.argsort(self.at[:, 0], kind="stable")
            self.sorted_x = self.at[self.along_x, 0]
        v = self.along_x[np.searchsorted(self.sorted_x, low[0]) : np.searchsorted(self.sorted_x, high[0], "right")]
        for c in (1, 2):
            there = self.at[v, c]
            v = v[(there >= low[c]) & (there <= high[c])]
        return np.sort(v)

    def _few(self, at, lines, r2, earlier, along, cosine, marks, few):
        """As ``nearest``, by radii that grow for the queries that have met fewer than ``few`` lines."""
        low, high = at.min(axis=0), at.max(axis=0)
        reach = r2**0.5 * (1.0 + 1e-9) + np.maximum(np.abs(low), np.abs(high)) * 1e-12
        there = len(self._in_box(low - reach, high + reach))
        # the first radius is one that twice as many targets would be met in, were they spread evenly over a plane
        now = r2 if there <= 8 * few else r2 * 4.0 * few / there
        todo, parts = np.arange(len(at)), []
        while True:
            now = r2 if now > r2 / 2 else now
            q, v, d = self.nearest(
                at[todo], None if lines is None else lines[todo], now, earlier,
                None if along is None else along[todo], cosine, None if marks is None else marks[todo])
            if now == r2:
                parts.append((todo[q], v, d))
                break
            # a line within a hair of the radius might tie with one beyond it
            full = np.bincount(q[d * d <= now * (1.0 - 1e-9)], minlength=len(todo)) >= few
            kept = full[q]
            parts.append((todo[q[kept]], v[kept], d[kept]))
            todo = todo[~full]
            if not len(todo):
                break
            now *= 4.0
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _in_boxes(self, at, lines, r2, earlier, prune):
        """Pairs of a query and a target in a box that may hold the nearest target of its line."""
        owner = self.line[self.start]
        mask = np.ones((len(at), len(self.start)), bool)
        if r2 is not None:
            closest = np.zeros(mask.shape)
            for c in range(3):
                a = at[:, c, None]
                gap = np.maximum(self.low[None, :, c] - a, a - self.high[None, :, c])
                closest += np.square(np.maximum(gap, 0.0, out=gap), out=gap)
            mask = closest <= r2 * (1.0 + 1e-9)
        if lines is not None:
            mask &= lines[:, None] > owner[None, :] if earlier else lines[:, None] != owner[None, :]
        q, run = np.nonzero(mask)
        if prune and len(q):
            # a run that is farther than all of another one of its line has no part in it
            near, far = np.zeros(len(q)), np.zeros(len(q))
            for c in range(3):
                a = at[q, c]
                near += np.square(np.maximum(np.maximum(self.low[run, c] - a, a - self.high[run, c]), 0.0))
                far += np.square(np.maximum(a - self.low[run, c], self.high[run, c] - a))
            first = _starts(q, owner[run])
            bound = np.repeat(np.minimum.reduceat(far, first), np.diff(np.r_[first, len(q)]))
            keep = ~(near > bound * (1.0 + 1e-9))
            q, run = q[keep], run[keep]
        n = self.size[run]
        if not len(n):
            return q, run
        return np.repeat(q, n), _all_of(self.start[run], n)
