"""Locality-sensitive hashing of segments and approximate search on it."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions.vec import Vec3
from skein.operators.blocks import CHORD, TARGETS, block_edges
from skein.operators.search import QUERY_KEY, as_targets, in_blocks, largest_in_cell, nearest_in_blocks, nearest_per_line
from skein.operators.segmentation import SEG_KEY, segment_points
from skein.session import reliable
from skein.skew import salted_join, spread_join

# Fixed values of the hash family.
WIDTH = 4.0
TABLE_SIZE = 10_000
PRIME = 4_294_967_291
MULTIPLIER_BITS = 29
VERTEX_GATE = 0.2527      # largest squared distance of an accepted vertex
TANGENT_GATE = 0.98       # smallest |cosine| of an accepted pair of tangents
CENTROID_GATE = 1.5       # largest squared distance of an accepted centroid
SEEDING_GATE = 1.0
BUCKET = ["table_id", "fp1", "fp2"]
ADJACENT = 20             # links of an occupied bucket
BLOCK = 64               # vertices of a segment that are held in one array
SEGMENTS = 1 << 14       # segments with their vertices that one task holds at a time (about 50 bytes each vertex)

P = Vec3.of()
C = Vec3.of("cx", "cy", "cz")


@dataclass(frozen=True)
class HashFunction:
    """h(x) = trunc(clamp((a.x + b) / w - offset, 0, n_buckets - 1))."""

    a: tuple[float, float, float]
    b: float
    w: float = WIDTH
    offset: float = 0.0
    n_buckets: int = 1

    def projection(self, v: Vec3) -> Column:
        return (Vec3.lit(*self.a).dot(v) + F.lit(self.b)) / F.lit(self.w)

    def __call__(self, v: Vec3) -> Column:
        shifted = F.greatest(self.projection(v) - F.lit(self.offset), F.lit(0.0))
        return F.least(shifted, F.lit(float(self.n_buckets - 1))).cast("int")


def draw_functions(n: int, seed: int, width: float = WIDTH) -> list[HashFunction]:
    """``n`` functions with normal directions and uniform shifts in [0, width)."""
    rng = random.Random(seed)
    return [
        HashFunction(
            (rng.gauss(0.0, 1.0), rng.gauss(0.0, 1.0), rng.gauss(0.0, 1.0)),
            rng.uniform(0.0, width),
            width,
        )
        for _ in range(n)
    ]


def _ranges(functions: Sequence[HashFunction], segments: DataFrame) -> list[tuple[float, float]]:
    """Least and largest projected centroid of each function (one small row); 0 without segments."""
    aggs = []
    for i, f in enumerate(functions):
        aggs += [F.min(f.projection(C)).alias(f"l{i}"), F.max(f.projection(C)).alias(f"h{i}")]
    row = segments.agg(*aggs).first()
    return [(row[f"l{i}"] or 0.0, row[f"h{i}"] or 0.0) for i in range(len(functions))]


def fit(functions: Sequence[HashFunction], segments: DataFrame) -> list[HashFunction]:
    """Set offset and bucket count from the range of the projected centroids."""
    return [
        replace(f, offset=low, n_buckets=int(high - low + 1))
        for f, (low, high) in zip(functions, _ranges(functions, segments))
    ]


def fit_buckets(
    functions: Sequence[HashFunction], segments: DataFrame, n_buckets: int
) -> list[HashFunction]:
    """Set the width so that the projected centroids fill ``n_buckets`` equal buckets."""
    out = []
    for f, (low, high) in zip(functions, _ranges([replace(f, w=1.0) for f in functions], segments)):
        step = (high - low) / n_buckets or 1.0
        out.append(replace(f, w=step, offset=low / step, n_buckets=n_buckets))
    return out


def underfill(functions: Sequence[HashFunction], segments: DataFrame) -> DataFrame:
    """Per function: its bucket count and by how much buckets fall short of the mean size."""
    codes = F.posexplode(F.array(*[f(C) for f in functions])).alias("fn_id", "bucket")
    sizes = segments.select(codes).groupBy("fn_id", "bucket").count()
    total = F.lit(segments.count())
    n_buckets = F.element_at(F.array(*[F.lit(f.n_buckets) for f in functions]), F.col("fn_id") + 1)
    mean = total / n_buckets
    return (
        sizes.groupBy("fn_id")
        .agg(
            F.count(F.lit(1)).alias("_used"),
            F.collect_list("count").alias("_sizes"),
        )
        .select(
            "fn_id",
            n_buckets.alias("n_buckets"),
            (
                F.aggregate(
                    "_sizes", F.lit(0.0), lambda s, c: s + F.greatest(mean - c, F.lit(0.0))
                )
                + (n_buckets - F.col("_used")) * mean
            ).alias("underfill"),
        )
    )


def best_function(functions: Sequence[HashFunction], segments: DataFrame) -> int:
    return underfill(functions, segments).orderBy("underfill", "fn_id").first()["fn_id"]


@dataclass(frozen=True)
class LshIndex:
    """``tables`` hash tables of ``per_table`` functions each over a fitted pool."""

    functions: list[HashFunction]
    tables: int = 1
    per_table: int = 1
    seed: int = 1
    table_size: int = TABLE_SIZE
    prime: int = PRIME
    _plan: list = field(init=False, compare=False)

    def __post_init__(self):
        rng = random.Random(self.seed)
        plan = []
        for _ in range(self.tables):
            picks = [rng.randrange(len(self.functions)) for _ in range(self.per_table)]
            plan.append(
                [(i, rng.randrange(1 << MULTIPLIER_BITS), rng.randrange(1 << MULTIPLIER_BITS))
                 for i in picks]
            )
        object.__setattr__(self, "_plan", plan)

    @property
    def plan(self) -> list[list[tuple[int, int, int]]]:
        """Per table: (function, first multiplier, second multiplier)."""
        return self._plan

    def fingerprints(self, v: Vec3) -> Column:
        """Array of (table_id, fp1, fp2) of a place."""
        entries = []
        for t, picks in enumerate(self._plan):
            sums = [F.lit(0).cast("bigint"), F.lit(0).cast("bigint")]
            for i, *multipliers in picks:
                code = self.functions[i](v).cast("bigint")
                for k, (m, modulus) in enumerate(zip(multipliers, (self.table_size, self.prime))):
                    sums[k] = (sums[k] + (F.lit(m) * code) % F.lit(modulus)) % F.lit(modulus)
            entries.append(
                F.struct(F.lit(t).alias("table_id"), sums[0].alias("fp1"), sums[1].alias("fp2"))
            )
        return F.array(*entries)

    def codes(self, v: Vec3) -> Column:
        """Array of one number per table that tells the bucket of a place."""
        return F.transform(self.fingerprints(v), lambda e: e["fp1"] * F.lit(self.prime) + e["fp2"])

    def place(self, df: DataFrame, v: Vec3) -> DataFrame:
        """One row per table, with the bucket of ``v`` in it."""
        hashed = df.withColumn("_b", F.explode(self.fingerprints(v)))
        return hashed.select(*df.columns, *[F.col("_b")[c].alias(c) for c in BUCKET])

    def buckets(self, segments: DataFrame) -> DataFrame:
        return self.place(segments, C)

    def append(self, buckets: DataFrame, segments: DataFrame) -> DataFrame:
        return buckets.unionByName(self.buckets(segments))


def histogram(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy(*BUCKET).agg(
        F.count(F.lit(1)).alias("segments"), F.count_distinct("line_id").alias("lines")
    )


def candidate_counts(index: LshIndex, points: DataFrame, buckets: DataFrame) -> DataFrame:
    """Per point and table: how many segments of other lines share its bucket.

    Counted from bucket totals less the own line's share; no pair is formed.
    """
    own = buckets.groupBy(*BUCKET, "line_id").agg(F.count(F.lit(1)).alias("_own"))
    total = own.groupBy(*BUCKET).agg(F.sum("_own").alias("_all"))
    placed = index.place(points.select(*QUERY_KEY, "x", "y", "z"), P)
    joined = placed.join(total, BUCKET, "left").join(own, [*BUCKET, "line_id"], "left")
    n = F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))
    return joined.select(*QUERY_KEY, "table_id", n.alias("candidates"))


# ------------------------------------------------------------------ second level


def nearest_by_projection(
    pairs: DataFrame,
    points: DataFrame,
    segments: DataFrame | None = None,
    key: Sequence[str] = QUERY_KEY,
) -> DataFrame:
    """For (query, segment) pairs: the segment vertex whose projection on the chord is nearest.

    ``pairs`` has the query key and x, y, z, and the segment as nbr_line, beg, end_, dx, dy, dz.
    A pair meets the vertices of its segment in blocks of BLOCK, so one row per pair is enough for
    all but the longest segments, whose blocks are then compared.
    """
    seg = ["nbr_line", "beg", "end_"]
    along = Vec3.of("dx", "dy", "dz")
    if segments is None:
        segments = pairs.withColumnRenamed("nbr_line", "line_id").select(
            *SEG_KEY, "dx", "dy", "dz"
        ).distinct()
    block = F.floor((F.col("pt_idx") - F.col("beg")) / F.lit(BLOCK))
    vertex = F.struct("pt_idx", P.dot(along).alias("along"), P.struct().alias("at"))
    blocks = (
        segment_points(points, segments)
        .join(segments.select(*SEG_KEY, "dx", "dy", "dz"), SEG_KEY)
        .groupBy(F.col("line_id").alias("nbr_line"), "beg", "end_", block.alias("_block"))
        .agg(F.collect_list(vertex).alias("_v"))
    )

    def offer(v: Column) -> Column:
        off = F.abs(v["along"] - F.col("_q"))
        return F.struct(off.alias("off"), v["pt_idx"].alias("nbr_pt"), v["at"].alias("at"))

    # Exploding the one result keeps later filters from evaluating the lambda once more each.
    best = spread_join(pairs.withColumn("_q", P.dot(along)), blocks, seg).select(
        *key, *seg, "x", "y", "z", F.explode(F.array(F.array_min(F.transform("_v", offer)))).alias("_m")
    )
    if (segments.agg(F.max(F.col("end_") - F.col("beg"))).first()[0] or 0) > BLOCK:
        best = best.groupBy(*key, *seg, "x", "y", "z").agg(F.min("_m").alias("_m"))
    d2 = P.sq_dist(Vec3.field(F.col("_m.at")))
    return best.select(*key, *seg, F.col("_m.nbr_pt").alias("nbr_pt"), d2.alias("d2"))


def _with_vertices(points: DataFrame, segments: DataFrame, gives: Sequence[str] = ()) -> DataFrame:
    """The segments with ``_v``, the array of their vertices by index, and their direction n_dx, n_dy, n_dz."""
    chord = Vec3.of(*CHORD)
    dirs = segments.select(*SEG_KEY, *Vec3.of("dx", "dy", "dz").named(*CHORD))
    vertex = F.struct(
        F.col("pt_idx").alias("nbr_pt"), P.dot(chord).alias("along"), "x", "y", "z",
        *[F.col(c).alias(f"n_{c}") for c in gives])
    held = (
        segment_points(points.select(*dict.fromkeys([*QUERY_KEY, "x", "y", "z", *gives])), segments)
        .join(dirs, SEG_KEY)
        .groupBy(*SEG_KEY)
        .agg(F.array_sort(F.collect_list(vertex)).alias("_v"))
    )
    return segments.join(held, SEG_KEY).withColumns(Vec3.of("dx", "dy", "dz").columns(*CHORD))


def _short(segments: DataFrame) -> bool:
    """Whether the vertices of each segment fit one array, and no segment comes twice."""
    top = segments.groupBy(*SEG_KEY).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n"), F.max(F.col("end_") - F.col("beg"))).first()
    return (top[0] or 0) <= 1 and (top[1] or 0) <= BLOCK


def _best_per_line(found: DataFrame, key: Sequence[str]) -> DataFrame:
    return (
        found.groupBy(*key, "nbr_line")
        .agg(F.min(F.struct("d2", "nbr_pt")).alias("m"))
        .select(*key, "nbr_line", F.col("m.nbr_pt").alias("nbr_pt"), F.sqrt("m.d2").alias("dist"))
    )


def ann_edges(
    index: LshIndex,
    points: DataFrame,
    segments: DataFrame,
    max_sq: float = VERTEX_GATE,
    min_cosine: float = TANGENT_GATE,
    where: Column | None = None,
) -> DataFrame:
    """Approximate nearest vertex per (point, other line), with distance and tangent gates.

    ``points`` carries tx, ty, tz and ``segments`` their attributes. A candidate shares a bucket
    with the point; its vertex is the one nearest by projection. Since that vertex has to pass the
    distance gate, only segments with a vertex in the cells around the point are looked at: the
    join key is (bucket, cell) and holds one row per segment, not per vertex. ``where`` may test
    the pair further.

    Points and vertices meet in blocks, where a vertex brings the places of its segment along its direction and so
    tells in place whether it is the one nearest by projection; no pair is shuffled. Segments of more than BLOCK vertices,
    lines that crowd a cell, keys that repeat and ``where`` take the join.
    """
    size = max_sq**0.5
    if where is None and largest_in_cell(as_targets(points), 2.0 * size) <= TARGETS and _short(segments) and in_blocks(
            points, as_targets(points), QUERY_KEY, "line_id"):
        held = _with_vertices(points, segments.withColumn("_n_codes", index.codes(C)), ["tx", "ty", "tz"])
        v = F.col("_m")
        targets = held.select(
            F.col("line_id").alias("nbr_line"), *CHORD, "_n_codes", F.col("_v.along").alias("_along"),
            F.posexplode("_v").alias("_nth", "_m"),
        ).select(
            "nbr_line", v["nbr_pt"].alias("nbr_id"), *Vec3.field(v).named("nx", "ny", "nz"),
            *[v[f"n_t{c}"].alias(f"n_t{c}") for c in "xyz"], *CHORD, "_n_codes", "_along", "_nth")
        found = nearest_in_blocks(
            points.withColumn("_codes", index.codes(P)), targets, size, cosine=min_cosine, codes=True, max_sq=max_sq,
            projected=True, most=SEGMENTS)
        return found.withColumnRenamed("nbr_id", "nbr_pt")
    cell = ["_gx", "_gy", "_gz"]

    def cells(v: Vec3) -> list[Column]:
        return [F.floor(c / F.lit(size)).cast("bigint") for c in v.parts]

    placed = index.place(points.select(*QUERY_KEY, "x", "y", "z"), P)
    for name, c in zip(cell, cells(P)):
        placed = placed.withColumn(name, F.explode(F.array(c - 1, c, c + 1)))
    spots = (
        segment_points(points.select(*QUERY_KEY, "x", "y", "z"), segments)
        .select(*SEG_KEY, *[c.alias(n) for n, c in zip(cell, cells(P))])
        .distinct()
    )
    targets = (
        index.buckets(segments.select(*SEG_KEY, "cx", "cy", "cz", "dx", "dy", "dz"))
        .drop("cx", "cy", "cz")
        .join(spots, SEG_KEY)
        .withColumnRenamed("line_id", "nbr_line")
    )
    pairs = (
        salted_join(placed, targets, [*BUCKET, *cell], spread=QUERY_KEY)
        .where(F.col("line_id") != F.col("nbr_line"))
        .select(*QUERY_KEY, "x", "y", "z", "nbr_line", "beg", "end_", "dx", "dy", "dz")
        .distinct()
    )
    found = nearest_by_projection(pairs, points.select(*QUERY_KEY, "x", "y", "z"), segments)
    found = found.where(F.col("d2") <= max_sq)
    t = points.select(*QUERY_KEY, "tx", "ty", "tz")
    other = t.select(
        F.col("line_id").alias("nbr_line"), F.col("pt_idx").alias("nbr_pt"),
        *Vec3.of("tx", "ty", "tz").named("ux", "uy", "uz"),
    )
    along = F.abs(Vec3.of("tx", "ty", "tz").dot(Vec3.of("ux", "uy", "uz")))
    gated = found.join(t, list(QUERY_KEY)).join(other, ["nbr_line", "nbr_pt"]).where(
        along >= min_cosine
    )
    if where is not None:
        gated = gated.where(where)
    return _best_per_line(gated, QUERY_KEY)


def centroid_edges(
    index: LshIndex,
    points: DataFrame,
    segments: DataFrame,
    max_sq: float = CENTROID_GATE,
    key: Sequence[str] = QUERY_KEY,
    own: str | None = "line_id",
    asks: Sequence[str] = (),
    gives: Sequence[str] = (),
) -> DataFrame:
    """Nearest segment per (point, other line) by centroid among those sharing a bucket.

    Points and segments bring the buckets of all tables along and meet once, so that a pair is told by its
    codes and tables need no merging. Lines that crowd a cell are searched bucket by bucket. Columns of the point
    named in ``asks`` come along, and of the segment those in ``gives`` as n_<name>.
    """
    given = [f"n_{c}" for c in gives]
    asked = points.withColumn("_codes", index.codes(P))
    held = segments.select(
        F.col("line_id").alias("nbr_line"), F.struct("beg", "end_").alias("nbr_id"),
        *C.named("nx", "ny", "nz"), index.codes(C).alias("_n_codes"), *[F.col(c).alias(n) for c, n in zip(gives, given)],
    )
    if largest_in_cell(held, 2.0 * max_sq**0.5) <= TARGETS and in_blocks(points, held, key, own):
        found = nearest_in_blocks(asked, held, max_sq**0.5, key, own, codes=True, asks=asks, gives=given,
                                  most=SEGMENTS if gives else TARGETS)
        return found.select(*key, *asks, "nbr_line", "nbr_id.beg", "nbr_id.end_", *given, "dist")
    placed = index.place(points, P)
    targets = index.buckets(segments.select(*SEG_KEY, "cx", "cy", "cz")).select(
        F.col("line_id").alias("nbr_line"), F.struct("beg", "end_").alias("nbr_id"),
        *C.named("nx", "ny", "nz"), *BUCKET,
    )
    found = nearest_per_line(placed, targets, max_sq**0.5, key, same=BUCKET, own=own)
    found = found.select(*key, "nbr_line", "nbr_id.beg", "nbr_id.end_", "dist")
    if asks:
        found = found.join(points.select(*key, *asks), list(key))
    if gives:
        found = found.join(held.select("nbr_line", "nbr_id.beg", "nbr_id.end_", *given), ["nbr_line", "beg", "end_"])
    return found


def seeding_edges(index: LshIndex, points: DataFrame, segments: DataFrame) -> DataFrame:
    return centroid_edges(index, points, segments, SEEDING_GATE)


def vertex_edges(
    index: LshIndex, points: DataFrame, segments: DataFrame, max_sq: float = CENTROID_GATE,
    asks: Sequence[str] = (), gives: Sequence[str] = (),
) -> DataFrame:
    """As ``centroid_edges``, refined to the vertex nearest by projection.

    Segments bring their vertices along, so that no pair is shuffled; segments of more than BLOCK vertices are
    joined to them. Columns of the point named in ``asks`` come along, and of the vertex those in ``gives`` as n_<name>.
    """
    place = points.select(*dict.fromkeys([*QUERY_KEY, "x", "y", "z", *asks, *gives]))
    held = segments.select(
        F.col("line_id").alias("nbr_line"), F.struct("beg", "end_").alias("nbr_id"), *C.named("nx", "ny", "nz"))
    if largest_in_cell(held, 2.0 * max_sq**0.5) <= TARGETS and _short(segments) and in_blocks(place, held, QUERY_KEY, "line_id"):
        held = _with_vertices(place, segments, gives).select(
            F.col("line_id").alias("nbr_line"), F.struct("beg", "end_").alias("nbr_id"), *C.named("nx", "ny", "nz"),
            index.codes(C).alias("_n_codes"), *CHORD, "_v")
        return nearest_in_blocks(
            place.withColumn("_codes", index.codes(P)), held, max_sq**0.5, codes=True, asks=asks, vertices=True, most=SEGMENTS)
    near = centroid_edges(index, place.select(*QUERY_KEY, "x", "y", "z"), segments, max_sq)
    dirs = segments.select(
        F.col("line_id").alias("nbr_line"), "beg", "end_", "dx", "dy", "dz"
    )
    pairs = near.join(place, list(QUERY_KEY)).join(dirs, ["nbr_line", "beg", "end_"])
    found = nearest_by_projection(pairs, place, segments).select(
        *QUERY_KEY, "nbr_line", "nbr_pt", F.sqrt("d2").alias("dist")
    )
    if asks:
        found = found.join(place.select(*QUERY_KEY, *asks), list(QUERY_KEY))
    if gives:
        found = found.join(as_targets(place, *[F.col(c).alias(f"n_{c}") for c in gives]).select(
            "nbr_line", F.col("nbr_id").alias("nbr_pt"), *[f"n_{c}" for c in gives]), ["nbr_line", "nbr_pt"])
    return found


# ------------------------------------------------------------------ multi-probe search


def _near_buckets(asked: DataFrame, held: DataFrame, codes: Sequence[str], m: int) -> DataFrame:
    """Pairs of an asked bucket (codes named q...) and a held one whose codes all differ by at most ``m``.

    Buckets meet in cells of side 2m + 1, of which an asked one touches at most two along each code.
    ``gap`` is the largest difference of a pair.
    """
    side = F.lit(2 * m + 1)
    cells = [f"_c{c}" for c in codes]
    for c, cell in zip(codes, cells):
        low, high = (F.floor((F.col(f"q{c}") + d) / side) for d in (-m, m))
        asked = asked.withColumn(cell, F.explode(F.sequence(low, high)))
    held = held.withColumns({cell: F.floor(F.col(c) / side) for c, cell in zip(codes, cells)})
    gaps = F.array_max(F.array(*[F.abs(F.col(c) - F.col(f"q{c}")) for c in codes]))
    return asked.join(held, cells).withColumn("gap", gaps).where(F.col("gap") <= m).drop(*cells)


def _coded(functions: Sequence[HashFunction], df: DataFrame, v: Vec3, names: Sequence[str]) -> DataFrame:
    return df.withColumns({c: f(v) for c, f in zip(names, functions)})


def _nearest_probed(
    asked: DataFrame, matches: DataFrame, filed: DataFrame, codes: Sequence[str], key: Sequence[str], own: str | None,
    points: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """Nearest segment per line in the buckets that ``matches`` gives to the bucket of each asked point.

    ``matches`` names each pair of buckets once. Segments are copied to the asked buckets, where points meet them in
    blocks; rows that repeat a key or lack a coordinate are joined and grouped instead. With ``points`` segments bring their
    vertices along, and an edge tells the vertex nearest by projection; with ``limit`` farther lines may be left out.
    """
    q = [f"q{c}" for c in codes]
    lacks = [F.col(c).isNull() for c in "xyz"], [F.col(f"c{c}").isNull() for c in "xyz"]
    bare = [df.where(a | b | c).isEmpty() for df, (a, b, c) in zip((asked, filed), lacks)]
    held = filed.select(
        F.col("line_id").alias("nbr_line"), F.struct("beg", "end_").alias("nbr_id"), *C.named("nx", "ny", "nz"), *codes)
    if all(bare) and (points is None or _short(filed)) and in_blocks(asked, held, key, own):
        if points is not None:
            held = _with_vertices(points, filed).select(
                F.col("line_id").alias("nbr_line"), F.struct("beg", "end_").alias("nbr_id"), *C.named("nx", "ny", "nz"),
                *CHORD, "_v", *codes)
        reaches = matches.select(*q, "reach").distinct()
        copies = salted_join(held, matches.select(*q, *codes), codes, spread=["nbr_line", "nbr_id"]).drop(*codes)
        found = block_edges(asked.join(reaches, q), copies, q, None, key, own, asks=["reach"], limit=limit,
                            vertices=points is not None, most=TARGETS if points is None else SEGMENTS)
        if points is not None:
            return found.select(*key, "nbr_line", "nbr_pt", "dist")
        return found.select(*key, "nbr_line", "reach", "nbr_id.beg", "nbr_id.end_", "dist")
    probes = salted_join(asked, matches, q, spread=key).drop(*q)
    targets = filed.select(
        F.col("line_id").alias("nbr_line"), "beg", "end_", *C.named("nx", "ny", "nz"), *codes
    )
    pairs = salted_join(probes, targets, codes, spread=key)
    if own:
        pairs = pairs.where(F.col(own) != F.col("nbr_line"))
    d2 = P.sq_dist(Vec3.of("nx", "ny", "nz"))
    found = (
        pairs.groupBy(*key, "nbr_line", "reach")
        .agg(F.min(F.struct(d2.alias("d2"), "beg", "end_")).alias("m"))
        .select(*key, "nbr_line", "reach", "m.beg", "m.end_", F.sqrt("m.d2").alias("dist"))
    )
    return found if points is None else _refined(found, asked, points, filed, key)


def multi_probe(
    functions: Sequence[HashFunction],
    points: DataFrame,
    segments: DataFrame,
    k: int,
    max_reach: int | None = None,
    key: Sequence[str] = QUERY_KEY,
    own: str | None = "line_id",
    vertices: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Nearest segment per line from the buckets around a point, widened until ``k`` lines are met.

    A bucket is the tuple of all hash codes; the probe of reach m holds the buckets whose codes all
    differ by at most m. How far to reach is settled between buckets, not points: lines are counted
    by their gap to each bucket that holds points, and the reach is the gap at which there are
    ``k`` other lines. The gap looked at doubles for buckets that lack lines, up to ``max_reach``.
    Points then meet only buckets of their probe that hold segments. With ``vertices``, the points of the segments, a
    segment is refined to its vertex nearest by projection (nbr_line, nbr_pt, dist) without a shuffle of pairs. Where only
    the ``limit`` nearest lines of a point are asked for, farther ones may be left out.
    """
    codes = [f"_h{i}" for i in range(len(functions))]
    q = [f"q{c}" for c in codes]
    widest = max_reach if max_reach is not None else max(f.n_buckets for f in functions)

    filed = _coded(functions, segments, C, codes)
    held = reliable(filed.select(*codes, "line_id").distinct())
    asked = _coded(functions, points.select(*key, "x", "y", "z"), P, q)
    todo = reliable(asked.select(*q).distinct())
    enough = k + 1 if own else k
    upto = Window.partitionBy(*q).orderBy("gap")
    matches, m = None, min(1, widest)
    while True:
        lines = _near_buckets(todo, held, codes, m).groupBy(*q, "line_id").agg(F.min("gap").alias("gap"))
        lines = lines.groupBy(*q, "gap").count().withColumn("lines", F.sum("count").over(upto))
        met = lines.where(F.col("lines") >= enough).groupBy(*q).agg(F.min("gap").alias("reach"))
        if m >= widest:
            met = todo.join(met, q, "left").withColumn("reach", F.coalesce("reach", F.lit(widest)))
        met = reliable(met)
        near = _near_buckets(met, held.select(*codes).distinct(), codes, m).where("gap <= reach").drop("gap")
        matches = near if matches is None else matches.unionByName(near)
        if m >= widest:
            break
        todo = reliable(todo.join(met, q, "left_anti"))
        if todo.isEmpty():
            break
        m = min(2 * m, widest)
    return _nearest_probed(asked, matches, filed, codes, key, own, vertices, limit)


def _beside(buckets: DataFrame, codes: Sequence[str], functions: Sequence[HashFunction]) -> list[DataFrame]:
    """Per function, each code with the occupied codes before and after it (NULL at the ends).

    A table has a row per code, so it is as long as the function has buckets, whatever the data.
    """
    out = []
    for c, f in zip(codes, functions):
        grid = buckets.sparkSession.range(f.n_buckets).select(F.col("id").cast("int").alias(c))
        used = buckets.select(c).distinct().withColumn("_u", F.col(c))
        w = Window.partitionBy(F.lit(0)).orderBy(c)
        out.append(grid.join(used, c, "left").select(
            c,
            F.last("_u", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_p{c}"),
            F.first("_u", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias(f"_n{c}"),
        ))
    return out


def bucket_graph(functions: Sequence[HashFunction], buckets: DataFrame, codes: Sequence[str], width: int = ADJACENT) -> DataFrame:
    """Links of each occupied bucket (codes named q...) to its best ``width`` adjacent ones.

    Buckets are adjacent if some function gives them neighbouring occupied codes; more such functions
    are better, ties go by codes. Buckets meet on the codes of a set of functions. Of those that share
    such a set of codes only the first ``width`` in code order can be among the best ones: whatever
    comes before in that order agrees in the same functions at least. So lists are cut before the
    join, and work grows with the buckets, not with the pairs of a slab.
    """
    q = [f"q{c}" for c in codes]
    beside = _beside(buckets, codes, functions)
    sets = [[c for i, c in enumerate(codes) if s >> i & 1] for s in range(1, 1 << len(codes))]

    def at(chosen: Sequence[str], value) -> Column:
        return F.array(*[value(c).cast("int") if c in chosen else F.lit(-1) for c in codes])

    listed = buckets.select(*codes, F.explode(F.array(*[at(s, F.col) for s in sets])).alias("_at"))
    first = Window.partitionBy("_at").orderBy(*codes)
    listed = listed.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= width).drop("_i")
    asked = buckets
    for c, table in zip(codes, beside):
        asked = asked.join(F.broadcast(table), c)
    sides = {c: (F.col(f"_p{c}"), F.col(f"_n{c}")) for c in codes}
    wanted = [at(s, dict(zip(s, picked)).get) for s in sets for picked in product(*[sides[c] for c in s])]
    ends = F.array(*[F.array(*sides[c]) for c in codes])
    asked = asked.select(*[F.col(c).alias(f"q{c}") for c in codes], ends.alias("_ends"), F.explode(F.array(*wanted)).alias("_at"))
    asked = asked.where(~F.exists("_at", lambda x: x.isNull()))
    common = sum(F.coalesce(F.array_contains(F.col("_ends")[i], F.col(c)), F.lit(False)).cast("int") for i, c in enumerate(codes))
    best = Window.partitionBy(*q).orderBy(F.desc("common"), *codes)
    pairs = asked.join(listed, "_at").select(*q, *codes, common.alias("common")).distinct()
    return pairs.withColumn("_i", F.row_number().over(best)).where(F.col("_i") <= width).drop("_i")


def occupied_probe(
    functions: Sequence[HashFunction],
    points: DataFrame,
    segments: DataFrame,
    k: int,
    width: int = ADJACENT,
    max_steps: int | None = None,
    key: Sequence[str] = QUERY_KEY,
    own: str | None = "line_id",
) -> DataFrame:
    """Nearest segment per line from occupied buckets, walked breadth-first until ``k`` lines are met.

    A walk starts in the bucket of the point, or if that holds no segment in those that have the next
    or previous occupied code of some function, and follows ``bucket_graph`` step by step; buckets of
    one step come by the sum of their code differences, then by codes. Walks belong to buckets that
    hold points, not to points. They end in the bucket where ``k`` other lines are met (all its
    segments count), where no bucket is left to go to, or after ``max_steps``; ``reach`` is the step
    of the last bucket. To see whether ``k`` lines are met, ``k`` + 1 lines of each bucket are enough.
    An empty table gives an empty one.
    """
    codes = [f"_h{i}" for i in range(len(functions))]
    q = [f"q{c}" for c in codes]
    enough = k + 1 if own else k
    filed = _coded(functions, segments, C, codes)
    members = filed.select(*codes, "line_id").distinct()
    lines = members.withColumn("_i", F.row_number().over(Window.partitionBy(*codes).orderBy("line_id")))
    lines = reliable(lines.where(F.col("_i") <= enough).drop("_i"))
    buckets = reliable(lines.select(*codes).distinct())
    links = reliable(bucket_graph(functions, buckets, codes, width).drop("common"))
    asked = _coded(functions, points.select(*key, "x", "y", "z"), P, q)
    starts = reliable(asked.select(*q).distinct())

    same = starts.join(buckets.select("*", *[F.col(c).alias(f"q{c}") for c in codes]), q)
    lost = starts.join(buckets.select(*[F.col(c).alias(f"q{c}") for c in codes]), q, "left_anti")
    for c, table in zip(codes, _beside(buckets, codes, functions)):
        lost = lost.join(F.broadcast(table.withColumnRenamed(c, f"q{c}")), f"q{c}")
    near = [
        lost.select(*q, F.explode(F.array(f"_p{c}", f"_n{c}")).alias(c)).join(buckets, c).select(*q, *codes)
        for c in codes
    ]
    front = same.select(*q, *codes)
    for n in near:
        front = front.unionByName(n)
    onward = links.toDF(*codes, *[f"n{c}" for c in codes])
    front = reliable(front.distinct())
    seen, met, step = front.withColumn("reach", F.lit(0)), None, 0
    while step != max_steps:
        found = front.join(lines, codes).select(*q, "line_id")
        met = reliable((found if met is None else met.unionByName(found)).distinct())
        done = met.groupBy(*q).count().where(F.col("count") >= enough)
        ahead = front.join(done, q, "left_anti").join(onward, codes)
        ahead = ahead.select(*q, *[F.col(f"n{c}").alias(c) for c in codes]).distinct()
        front = reliable(ahead.join(seen, [*q, *codes], "left_anti"))
        if front.isEmpty():
            break
        step += 1
        seen = seen.unionByName(front.withColumn("reach", F.lit(step)))
    gap = sum(F.abs(F.col(c) - F.col(f"q{c}")) for c in codes)
    seen = reliable(seen.withColumn("_at", F.struct("reach", gap.alias("gap"), *codes)))
    firsts = seen.join(lines, codes).groupBy(*q, "line_id").agg(F.min("_at").alias("_stop"))
    nth = F.row_number().over(Window.partitionBy(*q).orderBy("_stop"))
    stops = firsts.withColumn("_i", nth).where(F.col("_i") == enough).select(*q, "_stop")
    walked = seen.join(stops, q, "left").where(F.col("_stop").isNull() | (F.col("_at") <= F.col("_stop")))
    steps = walked.groupBy(*q).agg(F.max("reach").alias("reach"))
    matches = reliable(walked.select(*q, *codes).join(steps, q))
    return _nearest_probed(asked, matches, filed, codes, key, own)


def _refined(found: DataFrame, asked: DataFrame, points: DataFrame, segments: DataFrame, key: Sequence[str]) -> DataFrame:
    dirs = segments.select(F.col("line_id").alias("nbr_line"), "beg", "end_", "dx", "dy", "dz")
    pairs = found.select(*key, "nbr_line", "beg", "end_").join(asked.select(*key, "x", "y", "z"), list(key)).join(
        dirs, ["nbr_line", "beg", "end_"]
    )
    refined = nearest_by_projection(pairs, points.select(*QUERY_KEY, "x", "y", "z"), segments, key)
    return refined.select(*key, "nbr_line", "nbr_pt", F.sqrt("d2").alias("dist"))


def probe_vertices(
    found: DataFrame, points: DataFrame, segments: DataFrame, key: Sequence[str] = QUERY_KEY
) -> DataFrame:
    """Segments found by ``multi_probe``, refined to the vertex nearest by projection."""
    return _refined(found, points, points, segments, key)


def ranked(found: DataFrame, key: Sequence[str] = QUERY_KEY) -> DataFrame:
    """Add the rank by distance from 1 within each query."""
    w = Window.partitionBy(*key).orderBy("dist", "nbr_line")
    return found.withColumn("rank", F.row_number().over(w))
