"""View-independent opacity: control points of lines, fragments per pixel, smoothing, blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.scalars import smoothstep
from skein.functions.vec import clamp
from skein.operators.geometry import arc_positions, line_lengths
from skein.session import reliable
from skein.skew import (
    CHUNK,
    attach_line,
    explode_range,
    halo_windows,
    line_running_sums,
    rank_within,
    running_sums,
)

# The tornado preset and the limits of the passes.
Q_BACK = 100.0
R_FRONT = 500.0
LAMBDA = 1.5
SMOOTH_PASSES = 10
LAPLACE_WEIGHT = 0.1
FADE = 0.1
LOW, HIGH = 0.001, 0.999
END_GAP = 1e-4


# ------------------------------------------------------------------ control points


def control_points(points: DataFrame, total: int) -> DataFrame:
    """(line_id, n, arc_length, n_cp, cp_offset): ``total`` control points dealt to the lines.

    Lines up to the mean length per control point get two. The others share the rest by length,
    rounded down, and the largest remainders (then the larger ids) get one more each. The tables of
    one row per line are fixed, as several sums and all later passes read them.
    """
    lines = reliable(line_lengths(points).select("line_id", "n", "arc_length"))
    all_length = lines.agg(F.sum("arc_length")).scalar()
    each = lines.withColumn("_short", F.col("arc_length") <= all_length / F.lit(float(total)))
    rest = each.agg(
        F.struct(
            (F.lit(total) - 2 * F.count_if("_short")).alias("cps"),
            F.sum(F.when(~F.col("_short"), F.col("arc_length"))).alias("length"),
        )
    ).scalar()
    shared = each.withColumn("_rest", rest).withColumn(
        "_share", F.col("arc_length") / F.col("_rest.length") * F.col("_rest.cps")
    ).withColumn("_whole", F.floor("_share"))
    long = shared.where(~F.col("_short"))
    open_cps = long.agg(
        (F.max("_rest.cps") - F.sum("_whole")).alias("left")
    ).scalar()
    by_rest = [(F.col("_share") - F.col("_whole")).desc(), F.col("line_id").desc()]
    dealt = rank_within(long, [], by_rest, "_order", dtype="bigint").select(
        "line_id", "n", "arc_length",
        (F.col("_whole") + F.when(F.col("_order") < open_cps, 1).otherwise(0)).alias("n_cp"),
    )
    short = shared.where("_short").select(
        "line_id", "n", "arc_length", F.lit(2).cast("bigint").alias("n_cp")
    )
    summed = running_sums(dealt.unionByName(short), [], ["line_id"], {"_end": F.col("n_cp")})
    return reliable(summed.withColumn("cp_offset", F.col("_end") - F.col("n_cp")).drop("_end"))


def control_point_lines(lines: DataFrame) -> DataFrame:
    """(cp_id, line_id, cp_in_line) of all control points."""
    each = explode_range(lines, F.lit(0), F.col("n_cp") - 1, "cp_in_line")
    return each.select(
        (F.col("cp_offset") + F.col("cp_in_line")).alias("cp_id"), "line_id",
        F.col("cp_in_line").cast("int").alias("cp_in_line"),
    )


def alpha_weights(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``alpha_weight``: the place of each vertex on the axis of control points."""
    placed = attach_line(
        arc_positions(points), lines.select("line_id", "n", "arc_length", "n_cp", "cp_offset")
    )
    along = F.try_divide(F.col("arc"), F.col("arc_length")) * (F.col("n_cp") - 1)
    capped = F.least(F.coalesce(along, F.lit(0.0)), F.col("n_cp") - 1 - F.lit(END_GAP))
    at = F.when(F.col("pt_idx") == 0, F.lit(0.0)).otherwise(capped)
    return placed.withColumn("alpha_weight", F.col("cp_offset") + at).drop(
        "n", "arc_length", "n_cp", "cp_offset", "step", "arc"
    )


# ------------------------------------------------------------------ fragments


def fragments(points: DataFrame, width: int, height: int, x: Column, y: Column) -> DataFrame:
    """Put every point with 0 <= x, y < 1 into its pixel of a width x height image."""
    inside = points.where((x >= 0) & (x < 1) & (y >= 0) & (y < 1))
    px, py = F.floor(x * F.lit(width)), F.floor(y * F.lit(height))
    return inside.withColumn("pixel", (py * width + px).cast("bigint"))


def depth_order(frags: DataFrame, **args) -> DataFrame:
    """Add ``frag``, the position of a fragment from the front of its pixel."""
    return rank_within(frags, ["pixel"], ["depth", "line_id", "pt_idx"], "frag", **args)


def squared_importance() -> Column:
    g = clamp(F.col("importance"), LOW, HIGH)
    return g * g


def pixel_importance(frags: DataFrame) -> DataFrame:
    return frags.groupBy("pixel").agg(
        F.sum(squared_importance()).alias("gall"), F.count(F.lit(1)).alias("n")
    )


def fragment_opacity(
    ordered: DataFrame,
    q: float = Q_BACK,
    r: float = R_FRONT,
    lam: float = LAMBDA,
    direct: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``alpha`` from the importance in front of and behind each fragment of its pixel.

    1 / (1 + (1 - g)^(2 lambda) (r gf + q gb)), or g itself with ``direct``. The sums in front run
    over chunks of a pixel, so a pixel of any depth spreads over tasks.
    """
    g = clamp(F.col("importance"), LOW, HIGH)
    if direct:
        return ordered.withColumn("alpha", g)
    summed = line_running_sums(
        ordered, {"_upto": squared_importance()}, chunk, line="pixel", idx="frag"
    )
    given = attach_line(summed, pixel_importance(ordered), chunk=chunk, line="pixel", idx="frag")
    front = F.col("_upto") - squared_importance()
    back = F.col("gall") - F.col("_upto")
    load = F.pow(F.lit(1.0) - g, F.lit(2.0 * lam)) * (F.lit(r) * front + F.lit(q) * back)
    alpha = clamp(F.lit(1.0) / (F.lit(1.0) + load), 0.0, 1.0)
    return given.withColumn("alpha", alpha).drop("_upto", "gall", "n")


def gather_minimum(frags: DataFrame) -> DataFrame:
    """Least alpha per control point; a fragment belongs to the nearest one."""
    cp = F.floor(F.col("alpha_weight") + F.lit(0.5)).cast("bigint")
    return frags.groupBy(cp.alias("cp_id")).agg(F.min("alpha").alias("alpha"))


def smooth_alpha(
    cps: DataFrame, passes: int = SMOOTH_PASSES, weight: float = LAPLACE_WEIGHT, chunk: int = CHUNK
) -> DataFrame:
    """Move 1 - alpha towards the mean of both neighbours on the line, ``passes`` times.

    Control points without a valued neighbour become opaque. All passes run on one partitioning.
    """

    def one(w):
        v = F.lit(1.0) - F.col("alpha")
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        mean = F.coalesce((before + after) / F.lit(2.0), before, after)
        moved = F.lit(1.0) - (v + (mean - v) * F.lit(weight))
        return {"alpha": F.when(mean.isNull(), F.lit(1.0)).otherwise(moved)}

    return halo_windows(cps, [one] * passes, passes, passes, chunk, idx="cp_in_line")


def vertex_alpha(points: DataFrame, cps: DataFrame) -> DataFrame:
    """Alpha of each vertex, blended between the two control points around its weight."""
    low = F.floor("alpha_weight").cast("bigint")
    keyed = points.withColumns({"_c0": low, "_c1": low + 1})
    first = cps.select(F.col("cp_id").alias("_c0"), F.col("alpha").alias("_a0"))
    second = cps.select(F.col("cp_id").alias("_c1"), F.col("alpha").alias("_a1"))
    a0, a1 = F.coalesce("_a0", F.lit(0.0)), F.coalesce("_a1", F.lit(0.0))
    t = smoothstep(F.col("alpha_weight") - F.floor("alpha_weight"))
    joined = keyed.join(first, "_c0", "left").join(second, "_c1", "left")
    return joined.withColumn("alpha", a0 + (a1 - a0) * t).drop("_c0", "_c1", "_a0", "_a1")


def fade(current: Column, target: Column, rate: float = FADE) -> Column:
    return current + (target - current) * F.lit(rate)


def fade_frames(current: Column, target: Column, frames: int, rate: float = FADE) -> Column:
    """``frames`` fades in closed form."""
    return target + (current - target) * F.pow(F.lit(1.0 - rate), F.lit(float(frames)))


# ------------------------------------------------------------------ compositing


def composite(ordered: DataFrame, chunk: int = 1 << 12) -> DataFrame:
    """Blend r, g, b with transparency ``a`` front to back per pixel.

    Blending is associative: a run of fragments is its weighted colour and its remaining
    transparency. Runs of up to ``chunk`` fragments are folded first, then the runs of a pixel.
    """

    def run(rgbt: Column) -> Column:
        def over(s, e):
            add = [(s[c] + s["t"] * e[c]).alias(c) for c in "rgb"]
            return F.struct(*add, (s["t"] * e["t"]).alias("t"))

        zero = F.struct(*[F.lit(0.0).alias(c) for c in "rgb"], F.lit(1.0).alias("t"))
        return F.aggregate(rgbt, zero, over)

    a = F.col("a")
    part = F.struct("frag", *[(F.col(c) * (F.lit(1.0) - a)).alias(c) for c in "rgb"], a.alias("t"))
    runs = (
        ordered.withColumn("_chunk", F.floor(F.col("frag") / F.lit(chunk)))
        .groupBy("pixel", "_chunk")
        .agg(run(F.array_sort(F.collect_list(part))).alias("_r"))
    )
    first = F.struct("_chunk", *[F.col("_r")[c].alias(c) for c in "rgbt"])
    pixels = runs.groupBy("pixel").agg(run(F.array_sort(F.collect_list(first))).alias("_p"))
    alpha = F.lit(1.0) - F.col("_p")["t"]
    return pixels.select(
        "pixel",
        *[F.try_divide(F.col("_p")[c], alpha).alias(c) for c in "rgb"],
        alpha.alias("alpha"),
    )
