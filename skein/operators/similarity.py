"""Similarity of segments and vertices over index windows, and the measures built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.scalars import finite_or, gaussian_pdf
from skein.functions.vec import Vec3, clamp
from skein.operators.geometry import resample_around
from skein.operators.profiles import DistanceVariation, Measure, PointSimilarity, ShapeVariation, TwoTerms, WindowFits, windows
from skein.operators.search import EDGES_KEY, Search, nearest_lines, neighbour_edges
from skein.session import reliable
from skein.skew import halo_windows, rank_within, salted_join, spread_join

P, Q = Vec3.of("px", "py", "pz"), Vec3.of("qx", "qy", "qz")

# Window half-widths and kernels.
SEGMENT_WINDOW = 20
POINT_WINDOW = 1
VARIATION_WINDOW = 8
EMPTY_SIMILARITY = 16.0
TABLE_WIDTH = 64
SPREAD_SHARE = 0.14
SPREAD_SIGMA = 0.6
SPREAD_GAIN = 1.8
SPREAD_FLOOR = 0.2


def framed(points: DataFrame, low: int, high: int) -> DataFrame:
    """Add ``_f``, the array of places at the index offsets in [low, high] that the line has.

    Edges that bring ``_f`` of both vertices along (``asks`` and ``gives`` of the search) need no join.
    """
    return halo_windows(
        points, {"_f": lambda w: F.collect_list(F.struct("x", "y", "z")).over(w.rowsBetween(low, high))}, -low, high)


def _measured(edges: DataFrame | Search, points: DataFrame, measure: Measure) -> DataFrame | None:
    """The edges with the measure, if they are still to be found and that is done in blocks."""
    if not isinstance(edges, Search) or not edges.blocks():
        return None
    return edges.measured(windows(points.select("line_id", "pt_idx", "x", "y", "z"), measure.low, measure.high), measure)


def _found(edges: DataFrame | Search, low: int, high: int) -> DataFrame:
    """The edges; those that are still to be found bring the windows of both vertices along."""
    if not isinstance(edges, Search):
        return edges
    return neighbour_edges(
        framed(edges.points, low, high), edges.radius, asks=["_f"], gives=["_f"], limit=edges.limit, most=edges.most)


def _profile(edges: DataFrame, points: DataFrame, low: int, high: int, value, keep: Sequence[str] = ()) -> DataFrame:
    """Per edge the array ``_w`` of ``value`` at the index offsets in [low, high] that both lines have.

    ``value`` takes both vertices as structs; ``_at`` is the place of offset 0. Each vertex gets the
    array of vertices in reach of it once, so that an edge stays one row and meets two arrays of at
    most high - low + 1 entries. ``keep`` names columns of edges with arrays that stay. ``pt_idx`` has to be dense from 0 in each line.
    """
    if {"_f", "n__f"} <= set(edges.columns):
        both = edges.withColumnsRenamed({"_f": "_a", "n__f": "_b"})
    else:
        frames = framed(points.select("line_id", "pt_idx", *Vec3.of().named("x", "y", "z")), low, high)
        a = frames.select("line_id", "pt_idx", F.col("_f").alias("_a"))
        b = frames.select(
            F.col("line_id").alias("nbr_line"), F.col("pt_idx").alias("nbr_pt"), F.col("_f").alias("_b")
        )
        both = spread_join(edges.select(*EDGES_KEY), a, ["line_id", "pt_idx"])
        both = spread_join(both, b, ["nbr_line", "nbr_pt"])
    before_a, before_b = (F.least(F.col(c), F.lit(-low)) for c in ("pt_idx", "nbr_pt"))
    before = F.least(before_a, before_b)
    after = F.least(F.size("_a") - before_a, F.size("_b") - before_b)
    cut_a, cut_b = (
        F.slice(F.col(c), n - before + 1, before + after)
        for c, n in (("_a", before_a), ("_b", before_b))
    )
    return both.select(
        *EDGES_KEY, *keep, F.zip_with(cut_a, cut_b, value).alias("_w"), (before + 1).alias("_at")
    )


def _distance(p: Column, q: Column) -> Column:
    return Vec3.field(p).dist(Vec3.field(q))


def _center(w: Column) -> Column:
    return F.element_at(w, F.col("_at"))


def _sum(w: Column, fn) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda s, e: s + fn(e))


def point_similarity(
    edges: DataFrame | Search, points: DataFrame, window: int = POINT_WINDOW, keep: Sequence[str] = ()
) -> DataFrame:
    """Sum of (d_i - d_0)^2 over the window without its last offset, over the window's full length."""
    told = _measured(edges, points, PointSimilarity(-window, window, EMPTY_SIMILARITY))
    if told is not None:
        return told.select(*EDGES_KEY, *keep, "similarity")
    prof = _profile(_found(edges, -window, window), points, -window, window, _distance, keep)
    w = F.col("_w")
    d0 = _center(w)
    inner = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
    total = _sum(inner, lambda e: (e - d0) * (e - d0))
    return prof.select(
        *EDGES_KEY, *keep,
        F.coalesce(total / F.nullif(F.size(w), F.lit(0)), F.lit(EMPTY_SIMILARITY)).alias("similarity"),
    )


def distance_variation(
    edges: DataFrame | Search, points: DataFrame, window: int = VARIATION_WINDOW
) -> DataFrame:
    """Mean of (d_0 - d_i)^2 over the window, its length counted without the ends; 0 if empty."""
    told = _measured(edges, points, DistanceVariation(-window, window))
    if told is not None:
        return told.select(*EDGES_KEY, "dist", "variation")
    prof = _profile(_found(edges, -window, window), points, -window, window, _distance)
    w = F.col("_w")
    d0 = _center(w)
    inner = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
    total = _sum(inner, lambda e: (d0 - e) * (d0 - e))
    n = F.size(w) - 2
    return prof.select(
        *EDGES_KEY,
        d0.alias("dist"),
        F.when(n > 0, total / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0)).alias("variation"),
    )


def shape_variation(
    edges: DataFrame | Search, points: DataFrame, half: int = VARIATION_WINDOW, sides: str = "backward", keep: Sequence[str] = ()
) -> DataFrame:
    """Sum over offsets of |(p_{i+o} - q_{j+o}) - (p_i - q_j)|; ``sides`` is backward or both."""
    high = half if sides == "both" else 0
    told = _measured(edges, points, ShapeVariation(-half, high))
    if told is not None:
        return told.select(*EDGES_KEY, *keep, "variation")
    prof = _profile(
        _found(edges, -half, high), points, -half, high, lambda p, q: (Vec3.field(p) - Vec3.field(q)).struct(), keep
    )
    w = F.col("_w")
    c = _center(w)
    total = _sum(w, lambda e: Vec3.field(e).dist(Vec3.field(c)))
    return prof.select(*EDGES_KEY, *keep, total.alias("variation"))


def segment_similarity(
    pairs: DataFrame, points: DataFrame, window: int = SEGMENT_WINDOW
) -> DataFrame:
    """Mean squared distance of two segments aligned at their middle vertices.

    ``pairs`` has line_id, beg, end_ and nbr_line, nbr_beg, nbr_end.
    """
    key = ["line_id", "beg", "end_", "nbr_line", "nbr_beg", "nbr_end"]

    def mid(b, e):
        return F.floor((F.col(b) + F.col(e)) / 2).cast("int")

    base = pairs.select(*key, mid("beg", "end_").alias("_m"), mid("nbr_beg", "nbr_end").alias("_n"))
    low = F.greatest(F.lit(-window), F.col("beg") - F.col("_m"), F.col("nbr_beg") - F.col("_n"))
    high = F.least(
        F.lit(window), F.col("end_") - 1 - F.col("_m"), F.col("nbr_end") - 1 - F.col("_n")
    )
    spread = base.where(low <= high).withColumn("o", F.explode(F.sequence(low, high)))
    spread = spread.withColumns({"_i": F.col("_m") + F.col("o"), "_j": F.col("_n") + F.col("o")})
    a = points.select("line_id", F.col("pt_idx").alias("_i"), *Vec3.of().named("px", "py", "pz"))
    b = points.select(
        F.col("line_id").alias("nbr_line"), F.col("pt_idx").alias("_j"),
        *Vec3.of().named("qx", "qy", "qz"),
    )
    return (
        spread.join(a, ["line_id", "_i"])
        .join(b, ["nbr_line", "_j"])
        .groupBy(*key)
        .agg(F.avg(P.sq_dist(Q)).alias("similarity"))
    )


def segment_windows(points: DataFrame, segments: DataFrame, window: int = SEGMENT_WINDOW) -> DataFrame:
    """The segments with ``_w``, the places of their vertices up to ``window`` from the middle one, and ``_at``, its position."""
    mid = F.floor((F.col("beg") + F.col("end_")) / 2).cast("int")
    low = F.greatest(F.col("beg"), mid - window)
    spans = segments.select("line_id", "beg", "end_", low.alias("_l"), F.least(F.col("end_") - 1, mid + window).alias("_h"))
    each = spans.withColumn("pt_idx", F.explode(F.sequence("_l", "_h"))).join(
        points.select("line_id", "pt_idx", "x", "y", "z"), ["line_id", "pt_idx"])
    held = each.groupBy("line_id", "beg", "end_").agg(
        F.array_sort(F.collect_list(F.struct("pt_idx", "x", "y", "z"))).alias("_w"))
    return segments.join(held, ["line_id", "beg", "end_"]).withColumn("_at", mid - low + 1)


def affinity(near: DataFrame, points: DataFrame | None = None, window: int = SEGMENT_WINDOW) -> DataFrame:
    """Similarity of every segment with the segments found for its centroid.

    Pairs that bring the windows of both segments along (``segment_windows``, as ``_w``, ``_at``, ``n__w`` and ``n__at``)
    need no join.
    """
    if not {"_w", "_at", "n__w", "n__at"} <= set(near.columns):
        return segment_similarity(near, points, window)
    before = F.least("_at", "n__at") - 1
    n = before + F.least(F.size("_w") - F.col("_at"), F.size("n__w") - F.col("n__at")) + 1
    a, b = (F.slice(w, F.col(at) - before, n) for w, at in (("_w", "_at"), ("n__w", "n__at")))
    d2 = F.filter(F.zip_with(a, b, lambda p, q: Vec3.field(p).sq_dist(Vec3.field(q))), lambda d: d.isNotNull())
    # The array is made once, where it is told; the expression above is long.
    each = near.select("line_id", "beg", "end_", "nbr_line", "nbr_beg", "nbr_end", F.explode(F.array(d2)).alias("_d"))
    return each.select(
        "line_id", "beg", "end_", "nbr_line", "nbr_beg", "nbr_end",
        (_sum(F.col("_d"), lambda e: e) / F.nullif(F.size("_d"), F.lit(0))).alias("similarity"))


def two_term_similarity(
    edges: DataFrame | Search, points: DataFrame, length: float, half: int = 10, alpha: float = 0.2,
    separation: float = 1.0,
) -> DataFrame:
    """d_mid + alpha * mean |d_i - d_mid| of the lines resampled around both ends of an edge.

    Edges on which one side is too short have no row. ``similar`` is the test against
    ``separation``. Edges that are still to be found meet the samples of both vertices where rows meet.
    """
    if isinstance(edges, Search):
        if edges.blocks():
            samples = resample_around(points, points.select("line_id", "pt_idx"), length, half)
            held = samples.groupBy("line_id", F.col("center").alias("pt_idx")).agg(
                F.array_sort(F.collect_list(F.struct("sample", F.array("x", "y", "z").alias("p")))).alias("_s"))
            flat = F.concat(F.array(F.lit(float(half)), F.lit(half + 1.0)), F.flatten("_s.p"))
            held = held.where(F.size("_s") == 2 * half + 1).select("line_id", "pt_idx", flat.alias("_f"))
            told = edges.measured(
                points.select("line_id", "pt_idx", "x", "y", "z").join(held, ["line_id", "pt_idx"], "left"),
                TwoTerms(half, alpha, separation))
            return told.select(*EDGES_KEY, "_two.score", "_two.similar")
        edges = neighbour_edges(edges.points, edges.radius)
    ends = edges.select("line_id", "pt_idx").unionByName(
        edges.select(F.col("nbr_line").alias("line_id"), F.col("nbr_pt").alias("pt_idx"))
    ).distinct()
    samples = resample_around(points, ends, length, half).drop("offset")
    a = samples.select(
        "line_id", F.col("center").alias("pt_idx"), "sample", *Vec3.of().named("px", "py", "pz")
    )
    b = samples.select(
        F.col("line_id").alias("nbr_line"), F.col("center").alias("nbr_pt"), "sample",
        *Vec3.of().named("qx", "qy", "qz"),
    )
    d = F.struct("sample", P.dist(Q).alias("d"))
    prof = (
        edges.select(*EDGES_KEY)
        .join(a, ["line_id", "pt_idx"])
        .join(b, ["nbr_line", "nbr_pt", "sample"])
        .groupBy(*EDGES_KEY)
        .agg(F.array_sort(F.collect_list(d)).alias("_w"))
        .where(F.size("_w") == 2 * half + 1)
    )
    w = F.col("_w")
    mid = F.element_at(w, half + 1)["d"]
    spread = _sum(w, lambda e: F.abs(e["d"] - mid)) / F.size(w)
    score = mid + F.lit(alpha) * spread
    return prof.select(*EDGES_KEY, score.alias("score"), (score < separation).alias("similar"))


def window_fits(edges: DataFrame | Search, points: DataFrame, separation: float, half: int, alpha: float) -> DataFrame:
    """The edges with ``dist`` and ``fits``: bit h - 1 tells the two-term test by index windows of h a side.

    The test is d + alpha * mean |d_o - d| < separation for the distances d_o at the 2h + 1 offsets up
    to h; windows that reach beyond an end of a line do not pass. ``half`` is at most 62.
    """
    prof = _profile(edges, points, -half, half, _distance)
    w, at, d = F.col("_w"), F.col("_at"), _center(F.col("_w"))

    def bit(h: int) -> Column:
        off = _sum(F.slice(w, F.greatest(at - h, F.lit(1)), F.lit(2 * h + 1)), lambda e: F.abs(e - d))
        inside = (at > h) & (at + h <= F.size(w))
        passes = inside & (d + F.lit(float(alpha)) * off / F.lit(float(2 * h + 1)) < separation)
        return F.when(passes, F.lit(1 << (h - 1))).otherwise(F.lit(0)).cast("bigint")

    fits = bit(1)
    for h in range(2, half + 1):
        fits = fits.bitwiseOR(bit(h))
    return prof.select(*EDGES_KEY, d.alias("dist"), fits.alias("fits"))


# ------------------------------------------------------------------ per-point measures


def transparency(edges: DataFrame, curved: DataFrame) -> DataFrame:
    """alpha = sum phi(d) (kappa_i - kappa_j)^2 / sum phi(d), clamped; 1 without neighbours.

    ``curved`` holds all points with ``kappa``; it is joined to the edges on full vertex keys, unless they
    bring it along as ``kappa`` and ``n_kappa``.
    """
    k = curved.select("line_id", "pt_idx", "kappa")
    other = k.select(
        F.col("line_id").alias("nbr_line"), F.col("pt_idx").alias("nbr_pt"),
        F.col("kappa").alias("_other"),
    )
    phi = gaussian_pdf(F.col("dist"))
    diff = F.col("kappa") - F.col("_other")
    if {"kappa", "n_kappa"} <= set(edges.columns):
        both = edges.withColumnRenamed("n_kappa", "_other")
    else:
        both = edges.select(*EDGES_KEY, "dist").join(other, ["nbr_line", "nbr_pt"]).join(k, ["line_id", "pt_idx"])
    weighed = (
        both.groupBy("line_id", "pt_idx")
        .agg(F.sum(phi * diff * diff).alias("_n"), F.sum(phi).alias("_d"))
    )
    ratio = clamp(finite_or(F.try_divide(F.col("_n"), F.col("_d"))), 0.0, 1.0)
    alpha = F.when(F.col("_d").isNull() | (F.col("_d") == 0), F.lit(1.0)).otherwise(ratio)
    return k.join(weighed, ["line_id", "pt_idx"], "left").select(
        "line_id", "pt_idx", alpha.alias("alpha")
    )


def center_surround(similar: DataFrame, points: DataFrame, inner: float) -> DataFrame:
    """|mean similarity within 2R - mean within R|, Gaussian weights; -1 without neighbour in R.

    ``similar`` holds edges with ``dist`` and ``similarity``.
    """
    d, s = F.col("dist"), F.col("similarity")

    def weighted(r: float) -> Column:
        g = F.when(d < r, F.exp(-d * d / F.lit(2.0 * r * r)))
        return F.coalesce(F.sum(g * s) / F.nullif(F.sum(g), F.lit(0.0)), F.lit(0.0))

    per_point = similar.groupBy("line_id", "pt_idx").agg(
        F.abs(weighted(2 * inner) - weighted(inner)).alias("_a"),
        F.count_if(d < inner).alias("_n"),
    )
    alpha = F.when(F.coalesce("_n", F.lit(0)) == 0, F.lit(-1.0)).otherwise(
        clamp(F.col("_a"), 0.0, 1.0)
    )
    return points.select("line_id", "pt_idx").join(
        per_point, ["line_id", "pt_idx"], "left"
    ).select("line_id", "pt_idx", alpha.alias("alpha"))


def saliency(table: DataFrame, width: int = TABLE_WIDTH) -> DataFrame:
    """1 - exp(-sum(variation / (1 + dist / 2)) / width) per point of a table of ``width`` neighbours."""
    term = F.col("variation") / (F.lit(1.0) + F.lit(0.5) * F.col("dist"))
    total = finite_or(F.sum(term)) / F.lit(float(width))
    return table.groupBy("line_id", "pt_idx").agg((F.lit(1.0) - F.exp(-total)).alias("saliency"))


def table_statistics(table: DataFrame) -> DataFrame:
    """Mean and largest variation over a neighbour table, and its number of entries."""
    return table.agg(
        F.avg("variation").alias("mean_variation"),
        F.max("variation").alias("max_variation"),
        F.count(F.lit(1)).alias("entries"),
    )


def weighted_alpha(table: DataFrame, alpha: float) -> DataFrame:
    """Inverse-square weighted mean of 1 - avg*alpha*(exp(-s^2/2) - low)/(1 - low) per point.

    ``avg`` is the mean variation of the table and ``low`` is exp(-max^2/2). The mean is linear in both, so sums
    by point are taken in the one pass over the table that also tells these.
    """
    s = F.col("variation")
    weight = F.coalesce(
        F.try_divide(F.lit(1.0), F.col("dist") * F.col("dist")), F.lit(0.0)
    )
    told = F.when(s.isNotNull(), F.col("_w"))
    sums = reliable(
        table.withColumn("_w", weight)
        .groupBy("line_id", "pt_idx")
        .agg(
            F.sum("_w").alias("_all"), F.sum(told).alias("_told"),
            F.sum(F.exp(-s * s / F.lit(2.0)) * F.col("_w")).alias("_near"),
            F.sum(s).alias("_s"), F.count(s).alias("_n"), F.max(s).alias("_top"),
        )
    )
    stats = sums.agg(
        F.struct((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"), F.max("_top").alias("top")).alias("s")
    ).scalar()
    given = sums.withColumn("_g", stats)
    top = F.col("_g.top")
    low = F.exp(-top * top / F.lit(2.0))
    part = F.col("_told") - F.col("_g.mean") * F.lit(alpha) * (
        F.col("_near") - low * F.col("_told")
    ) / F.nullif(F.lit(1.0) - low, F.lit(0.0))
    return given.select("line_id", "pt_idx", F.try_divide(part, F.col("_all")).alias("alpha"))


def simple_opacity(table: DataFrame, alpha: float) -> DataFrame:
    """Variation of the nearest neighbour over the largest such value, times ``alpha``."""
    nearest = reliable(table.where(F.col("rank") == 1).select("line_id", "pt_idx", "variation"))
    top = nearest.agg(F.max("variation")).scalar()
    return nearest.select(
        "line_id", "pt_idx",
        (F.try_divide(F.col("variation"), top) * F.lit(alpha)).alias("opacity"),
    )


def neighbour_counts(table: DataFrame, points: DataFrame) -> DataFrame:
    """Number of table entries of every point."""
    counts = table.groupBy("line_id", "pt_idx").agg(F.count(F.lit(1)).alias("neighbours"))
    return points.select("line_id", "pt_idx").join(counts, ["line_id", "pt_idx"], "left").select(
        "line_id", "pt_idx", F.coalesce("neighbours", F.lit(0)).alias("neighbours")
    )


def spread_opacity(
    points: DataFrame, share: float = SPREAD_SHARE, sigma: float = SPREAD_SIGMA,
    start_radius: float = 1.0,
) -> DataFrame:
    """Raise opacity around the ``share`` most opaque points.

    Each point takes the nearest of them at distance d, with opacity o*:
    max((o + 1.8 o* e) / 2, 0.2 e), where e = exp(-d / (2 sigma^2)).

    Points at one place have the same nearest one, and of targets at one place the first by line and index stands for all; so
    places are searched, once each, and points join what their place has found.
    """
    points, place = reliable(points), ["x", "y", "z"]
    n = points.count()
    order = [F.col("opacity").desc(), F.col("line_id"), F.col("pt_idx")]
    top = rank_within(points, [], order, "_rank", dtype="bigint").where(
        F.col("_rank") < n * share
    )
    somewhere = [~(F.isnan(c) | F.col(c).isNull()) for c in place]
    targets = reliable(
        top.where(somewhere[0] & somewhere[1] & somewhere[2])
        .groupBy(*[F.col(c).alias(f"n{c}") for c in place])
        .agg(F.min(F.struct("line_id", "pt_idx", "opacity")).alias("nbr_id"))
        .withColumn("nbr_line", F.lit(0).cast("bigint"))
    )
    places = reliable(points.where(somewhere[0] & somewhere[1] & somewhere[2]).select(*place).distinct())
    near = nearest_lines(places, targets, 1, start_radius, key=place, own=None, growth=4.0).select(
        *place, F.col("nbr_id.opacity").alias("_top"), "dist"
    )
    e = F.exp(-F.col("dist") / F.lit(2.0 * sigma * sigma))
    raised = (F.col("opacity") + F.lit(SPREAD_GAIN) * F.col("_top") * e) / F.lit(2.0)
    keyed = points.where(F.col("line_id").isNotNull() & F.col("pt_idx").isNotNull())
    found = salted_join(keyed.select("line_id", "pt_idx", "opacity", *place), near, place, spread=["line_id", "pt_idx"])
    return found.select(
        "line_id", "pt_idx", F.greatest(raised, F.lit(SPREAD_FLOOR) * e).alias("opacity")
    )
