"""Ordered geometry of polylines held as (line_id, pt_idx, x, y, z) rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from skein.functions.vec import Vec3, clamp
from skein.session import BATCH_BYTES
from skein.skew import (
    CHUNK,
    CHUNK_OF,
    attach_line,
    chunked_fold,
    halo_windows,
    line_running_sums,
    running_sums,
    salted_join,
    spread_join,
)

P = Vec3.of()
ZERO = 0.0


# ------------------------------------------------------------------ boxes and normalisation


def bounding_box(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Corner, extent and diagonal of the box around all points, or around each group."""
    aggs = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("min_", F.min), ("max_", F.max))]
    box = points.groupBy(*(by or [])).agg(*aggs)
    size = Vec3(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"])
    return box.withColumns(
        {**size.columns("ext_x", "ext_y", "ext_z"), "diagonal": size.length()}
    )


def _scalar_box(points: DataFrame) -> Column:
    names = [f"{n}_{c}" for c in "xyz" for n in ("min", "max")]
    return bounding_box(points).select(F.struct(*names).alias("box")).scalar()


def normalize(
    points: DataFrame,
    radius: float,
    scale_to_extent: bool = True,
    move: tuple[float, float, float] = (0.0, 0.0, 0.0),
    centralize: bool = False,
) -> DataFrame:
    """Shift and scale all points: (p - offset) / interval.

    The box comes from one scalar subquery, so the points themselves are only projected.
    ``interval`` is ``radius`` times the longest side (or 1). The offset is the box corner (or 0)
    less ``move``; with ``centralize`` it is the box centre.
    """
    boxed = points.withColumn("_box", _scalar_box(points))
    low = Vec3(*[F.col("_box")[f"min_{c}"] for c in "xyz"])
    high = Vec3(*[F.col("_box")[f"max_{c}"] for c in "xyz"])
    side = high - low
    interval = (F.greatest(*side.parts) if scale_to_extent else F.lit(1.0)) * F.lit(float(radius))
    if centralize:
        offset = low + side / F.lit(2.0)
    else:
        offset = (low if scale_to_extent else Vec3.lit(0, 0, 0)) - Vec3.lit(*move)
    return boxed.withColumns(((P - offset) / interval).columns()).drop("_box")


def denormalize(points: DataFrame, radius: float) -> DataFrame:
    """Undo the scaling by ``radius`` up to factor two and centre the result."""
    return normalize(points, 1.0 / (2.0 * radius), scale_to_extent=False, centralize=True)


def shift_nonnegative(points: DataFrame, axes: str = "xyz") -> DataFrame:
    """Move all points so that the smallest coordinate of each axis is zero."""
    boxed = points.withColumn("_box", _scalar_box(points))
    return boxed.withColumns({c: F.col(c) - F.col("_box")[f"min_{c}"] for c in axes}).drop("_box")


# ------------------------------------------------------------------ line sets


def line_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))


def line_offsets(points: DataFrame, parts: int | None = None) -> DataFrame:
    """Size and first global index of every line, lines ordered by id."""
    sizes = line_sizes(points)
    summed = running_sums(sizes, [], ["line_id"], {"_end": F.col("n")}, parts=parts)
    return summed.select("line_id", "n", (F.col("_end") - F.col("n")).alias("first_gid"))


def global_index(points: DataFrame) -> DataFrame:
    """Add ``gid``, the position of each point in the flat line set."""
    out = attach_line(points, line_offsets(points))
    return out.withColumn("gid", F.col("first_gid") + F.col("pt_idx")).drop("n", "first_gid")


def nested(points: DataFrame) -> DataFrame:
    """One row per chunk of a line, holding its vertices in order; chunk 0 only for short lines."""
    return (
        points.withColumn("chunk", F.floor(F.col("pt_idx") / F.lit(CHUNK)))
        .groupBy("line_id", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("pt_idx", "x", "y", "z"))).alias("path"))
    )


def flat(lines: DataFrame) -> DataFrame:
    """Inverse of ``nested``."""
    v = F.explode("path").alias("v")
    return lines.select("line_id", v).select("line_id", "v.pt_idx", "v.x", "v.y", "v.z")


def largest_line(points: DataFrame) -> DataFrame:
    return line_sizes(points).agg(F.max("n").alias("max_size"))


def first_lines(points: DataFrame, n: int) -> DataFrame:
    """Keep lines with an id below ``n``; reaches the scan as a pushed filter."""
    return points.where(F.col("line_id") < n)


def downsample(points: DataFrame, k: int) -> DataFrame:
    """Keep every k-th vertex of each line and renumber."""
    kept = points.where(F.col("pt_idx") % k == 0)
    return kept.withColumn("pt_idx", F.floor(F.col("pt_idx") / k).cast("int"))


def long_lines(points: DataFrame, min_length: float) -> DataFrame:
    """Points of the lines with at least the given arc length."""
    keep = line_lengths(points).where(F.col("arc_length") >= min_length).select("line_id", "n")
    return attach_line(points, keep).drop("n")


# ------------------------------------------------------------------ derivatives


def tangents(points: DataFrame, chunk: int = CHUNK, unit: bool = True) -> DataFrame:
    """Add tx, ty, tz: the unit difference of the two neighbours, clamped at the line ends."""

    def cols(w):
        lead, lag = P.lead(w), P.lag(w)
        ahead = Vec3(*[F.coalesce(a, b) for a, b in zip(lead.parts, P.parts)])
        back = Vec3(*[F.coalesce(a, b) for a, b in zip(lag.parts, P.parts)])
        return (ahead - back).columns("tx", "ty", "tz")

    raw = halo_windows(points, cols, 1, 1, chunk)
    t = Vec3.of("tx", "ty", "tz")
    return raw.withColumns(t.unit0().columns("tx", "ty", "tz")) if unit else raw


def step_lengths(points: DataFrame, chunk: int = CHUNK, name: str = "step") -> DataFrame:
    """Add the distance to the previous vertex, 0 at the first."""
    return halo_windows(
        points, {name: lambda w: F.coalesce(P.dist(P.lag(w)), F.lit(ZERO))}, 1, 0, chunk
    )


def line_lengths(points: DataFrame) -> DataFrame:
    """Size, arc length, chord and tortuosity per line; tortuosity is 1 for a single vertex."""
    ends = [
        F.min_by(F.struct("x", "y", "z"), "pt_idx").alias("_a"),
        F.max_by(F.struct("x", "y", "z"), "pt_idx").alias("_b"),
    ]
    out = step_lengths(points).groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("step").alias("arc_length"), *ends
    )
    chord = Vec3.field(F.col("_a")).dist(Vec3.field(F.col("_b")))
    return out.select(
        "line_id",
        "n",
        "arc_length",
        chord.alias("chord"),
        F.when(F.col("n") == 1, F.lit(1.0))
        .otherwise(F.col("arc_length") / F.nullif(chord, F.lit(ZERO)))
        .alias("tortuosity"),
    )


def arc_positions(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``step`` and the arc length ``arc`` from the first vertex."""
    return line_running_sums(step_lengths(points, chunk), {"arc": F.col("step")}, chunk)


def curvature(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``kappa`` from differences over two vertices on both sides; NULL on lines under 5.

    The first three values equal the one at index 2, the last two the one at n - 3.
    """

    d, n, m = Vec3.of("_dx", "_dy", "_dz"), "_n", Vec3.of("_mx", "_my", "_mz")

    def delta(w):
        return (P - P.lag(w)).columns("_dx", "_dy", "_dz")

    def length(w):
        return {n: d.length()}

    def slope(w):
        both = F.col(n) + F.lead(n).over(w)
        return {**((d + d.lead(w)) / both).columns("_mx", "_my", "_mz"), "_both": both}

    def bend(w):
        return {"_k": ((m.lead(w) - m.lag(w)) / F.col("_both")).length()}

    def fill(w):
        k, i = F.col("_k"), F.col("pt_idx")
        head = F.when(i == 0, F.lead("_k", 2).over(w)).when(i == 1, F.lead("_k", 1).over(w))
        at_end = F.lead(i, 1).over(w).isNull()
        near_end = F.lead(i, 2).over(w).isNull()
        tail = F.when(at_end, F.lag("_k", 2).over(w)).when(near_end, F.lag("_k", 1).over(w))
        return {"kappa": F.when(i < 2, head).otherwise(F.coalesce(tail, k))}

    out = halo_windows(points, [delta, length, slope, bend, fill], 4, 4, chunk)
    return out.drop("_dx", "_dy", "_dz", "_n", "_mx", "_my", "_mz", "_both", "_k")


def cross_curvature(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``kappa`` at index i >= 1 from r = p[i] - p[i-1] and its difference to the next step."""

    def cols(w):
        r, nxt = P - P.lag(w), P.lead(w) - P
        k = r.cross((nxt - r) * r).length() / F.nullif(r.sq() * r.length(), F.lit(ZERO))
        return {"kappa": k}

    return halo_windows(points, cols, 1, 1, chunk)


# Fixed values of the smoothing kernel: neighbour weight, own weight, number of passes.
SMOOTH_WEIGHT = math.exp(-90.0 / 32.0) / math.sqrt(32.0 * math.pi)
SMOOTH_SELF = 1.0
SMOOTH_PASSES = 160


def smooth(
    points: DataFrame,
    half_window: int,
    passes: int = SMOOTH_PASSES,
    chunk: int = CHUNK,
) -> DataFrame:
    """Weighted moving mean over [i - w, i + w), repeated; all neighbours weigh the same.

    Each chunk of a line is one row, with the vertices that all passes together reach from it, so that they take
    one shuffle. A task smooths the chunks of a batch at once; missing coordinates count as neighbours and add nothing.
    """
    columns, reach = points.columns, passes * half_window
    size = F.lit(max(chunk, 2 * reach + 1))
    spots = [F.floor((F.col("pt_idx") + F.lit(d)) / size) for d in (-reach, 0, reach)]
    chunks = (
        points.withColumn(CHUNK_OF, F.explode(F.array_distinct(F.array(*spots))))
        .where(F.col(CHUNK_OF) >= 0)
        .groupBy("line_id", CHUNK_OF)
        .agg(F.array_sort(F.collect_list(F.struct("pt_idx", F.struct(*columns).alias("_p"), (spots[1] == F.col(CHUNK_OF)).alias("_own")))).alias("_v"))
        .select("_v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            start, rows = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
            start, keep = start - start[0], rows.field("_own")
            points = rows.field("_p")
            smoothed = {c: _smoothed(points.field(c), start, half_window, passes) for c in "xyz"}
            kept = [smoothed.get(c, points.field(c)).filter(keep) for c in columns]
            yield pa.RecordBatch.from_arrays(kept, columns)

    points.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    schema = StructType([type(f)(f.name, f.dataType, True) for f in points.schema])
    return chunks.mapInArrow(run, schema)


def _smoothed(column: pa.Array, start: np.ndarray, half_window: int, passes: int) -> pa.Array:
    """The passes over runs of values that begin at ``start`` (with the end of the last one)."""
    lost = column.is_null().to_numpy(zero_copy_only=False)
    value = np.where(lost, 0.0, column.to_numpy(zero_copy_only=False).astype(float))
    size = np.diff(start)
    at = np.arange(len(value)) - np.repeat(start[:-1], size)
    ahead = np.repeat(size, size) - 1 - at
    total = SMOOTH_SELF + SMOOTH_WEIGHT * (np.minimum(at, half_window) + np.minimum(ahead, half_window - 1))
    # for each offset, the vertices that have a neighbour there
    inside = [(o, (at + o >= 0) & (o <= ahead)) for o in range(-half_window, half_window)]
    for _ in range(passes):
        around = np.zeros(len(value))
        for o, there in inside:  # from the lowest offset on, as a window sums
            a, b = max(0, -o), len(value) - max(0, o)
            if a < b:
                around[a:b] += np.where(there[a:b], value[a + o : b + o], 0.0)
        value = np.where(lost, 0.0, (value * (SMOOTH_SELF - SMOOTH_WEIGHT) + SMOOTH_WEIGHT * around) / total)
    return pa.array(value, mask=lost).cast(column.type)


# ------------------------------------------------------------------ vertex filters


def drop_near_previous(points: DataFrame, eps: float = 1e-6, chunk: int = CHUNK) -> DataFrame:
    """Drop vertices within ``eps`` of the vertex before them (kept or not)."""
    stepped = halo_windows(points, {"_d": lambda w: P.dist(P.lag(w))}, 1, 0, chunk)
    return stepped.where(F.col("_d").isNull() | (F.col("_d") > eps)).drop("_d")


def drop_near_kept(points: DataFrame, eps: float = 1e-6, chunk: int = 1 << 12) -> DataFrame:
    """Drop vertices within ``eps`` of the last vertex that was kept."""

    def step(s, e):
        keep = s["x"].isNull() | (Vec3.field(e).dist(Vec3.field(s)) > eps)
        new = {c: F.when(keep, e[c]).otherwise(s[c]) for c in "xyz"}
        return new, keep, F.struct(e["pt_idx"], e["x"], e["y"], e["z"])

    none = F.lit(None)
    kept = chunked_fold(
        points,
        [F.col("x"), F.col("y"), F.col("z")],
        {c: ("double", none) for c in "xyz"},
        "struct<pt_idx:int,x:double,y:double,z:double>",
        step,
        chunk,
    )
    v = F.explode("out").alias("v")
    return kept.select("line_id", v).select("line_id", "v.pt_idx", "v.x", "v.y", "v.z")


# ------------------------------------------------------------------ samples along a line


def resample_around(
    points: DataFrame, centers: DataFrame, length: float, half: int, chunk: int = CHUNK
) -> DataFrame:
    """2*half+1 samples at equal arc spacing around given vertices (line_id, pt_idx).

    A side that ends early is made up on the other side; centers on too short a line give no rows.
    Sample offsets are located by an equi-join on arc cells of fixed width, each line segment being
    listed in the cells it spans.
    """
    seg = length / (2 * half)
    arcs = arc_positions(points, chunk)
    ends = arcs.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("arc").alias("_total")
    )
    at = (
        attach_line(arcs.join(centers, ["line_id", "pt_idx"], "left_semi"), ends)
        .withColumn("_fwd", F.floor((F.col("_total") - F.col("arc")) / seg).cast("int"))
        .withColumn("_back", F.floor(F.col("arc") / seg).cast("int"))
        .where(F.col("_fwd") + F.col("_back") >= 2 * half)
    )
    ahead = F.least(F.col("_fwd"), F.greatest(F.lit(half), F.lit(2 * half) - F.col("_back")))
    sample = F.explode(F.sequence(ahead - 2 * half, ahead)).alias("offset")
    wanted = at.select("line_id", F.col("pt_idx").alias("center"), F.col("arc").alias("_arc0"),
                       ahead.alias("_ahead"), sample).withColumns(
        {
            "s": F.col("_arc0") + F.col("offset") * F.lit(seg),
            "sample": F.col("offset") - F.col("_ahead") + 2 * half,
        }
    )
    width = F.lit(float(length))
    wanted = wanted.withColumn("_cell", F.floor(F.greatest(F.col("s"), F.lit(ZERO)) / width))
    pieces = halo_windows(
        arcs,
        lambda w: {
            "_a1": F.lead("arc").over(w),
            **P.lead(w).columns("x1", "y1", "z1"),
        },
        0,
        1,
        chunk,
    ).where(F.col("_a1").isNotNull() & (F.col("_a1") > F.col("arc")))
    spans = pieces.withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col("arc") / width), F.floor(F.col("_a1") / width))),
    )
    hit = spread_join(
        wanted,
        spans.select("line_id", "_cell", F.col("arc").alias("_a"), "_a1", "x", "y", "z",
                     "x1", "y1", "z1", F.col("pt_idx").alias("seg_idx")),
        ["line_id", "_cell"],
    ).where((F.col("s") >= F.col("_a") - 1e-12) & (F.col("s") <= F.col("_a1") + 1e-12))
    t = clamp((F.col("s") - F.col("_a")) / (F.col("_a1") - F.col("_a")), 0.0, 1.0)
    a, b = P, Vec3.of("x1", "y1", "z1")
    spot = a + (b - a) * t
    return (
        hit.withColumns(spot.columns("sx", "sy", "sz"))
        .groupBy("line_id", "center", "sample", "offset")
        .agg(F.min_by(F.struct("sx", "sy", "sz"), "seg_idx").alias("p"))
        .select("line_id", "center", "sample", "offset",
                F.col("p.sx").alias("x"), F.col("p.sy").alias("y"), F.col("p.sz").alias("z"))
    )


def index_window(points: DataFrame, half: int, chunk: int = CHUNK) -> DataFrame:
    """The 2*half+1 vertices around each vertex as an array; vertices near an end are left out."""

    def cols(w):
        frame = w.rowsBetween(-half, half)
        return {"path": F.collect_list(F.struct("pt_idx", "x", "y", "z")).over(frame)}

    return halo_windows(points, cols, half, half, chunk).where(F.size("path") == 2 * half + 1)


def index_range_near(points: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """For each (line_id, qx, qy, qz): the index range within ``radius`` of arc of its foot.

    The foot is the closest spot on the line. ``low`` is the last inner vertex at or beyond the
    radius before it, else 0; ``high`` the first one after it, else the line size.
    """
    arcs = arc_positions(points)
    pieces = halo_windows(
        arcs,
        lambda w: {"_a1": F.lead("arc").over(w), **P.lead(w).columns("x1", "y1", "z1")},
        0,
        1,
    ).where(F.col("_a1").isNotNull())
    q, b = Vec3.of("qx", "qy", "qz"), Vec3.of("x1", "y1", "z1")
    d1 = b - P
    t = F.coalesce(clamp((q - P).dot(d1) / F.nullif(d1.sq(), F.lit(ZERO)), 0.0, 1.0), F.lit(ZERO))
    foot = (
        salted_join(pieces, centers, ["line_id"], spread=["pt_idx"])
        .withColumn("_t", t)
        .withColumn("_d", (q - P - d1 * F.col("_t")).length())
        .groupBy("line_id", "qx", "qy", "qz")
        .agg(
            F.min_by(
                F.struct(
                    F.col("pt_idx").alias("i"),
                    (F.col("arc") + F.col("_t") * (F.col("_a1") - F.col("arc"))).alias("at"),
                ),
                F.struct("_d", "pt_idx"),
            ).alias("f")
        )
    )
    low = F.max(
        F.when(
            (F.col("pt_idx") < F.col("f.i")) & (F.col("pt_idx") > 0)
            & (F.col("f.at") - F.col("arc") >= radius),
            F.col("pt_idx"),
        )
    )
    high = F.min(
        F.when(
            (F.col("pt_idx") > F.col("f.i") + 1) & (F.col("arc") - F.col("f.at") >= radius),
            F.col("pt_idx"),
        )
    )
    return (
        salted_join(arcs, foot, ["line_id"], spread=["pt_idx"])
        .groupBy("line_id", "qx", "qy", "qz")
        .agg(
            F.coalesce(low, F.lit(0)).alias("low"),
            F.coalesce(high, F.count(F.lit(1)).cast("int")).alias("high"),
        )
    )
