"""Exact neighbour search between points and lines.

Queries meet targets in blocks of grid cells, where nothing but the input is shuffled; only targets of
lines with very many vertices in a cell are joined vertex by vertex. Queries are tables
with an id and x, y, z; targets are tables with nbr_line, nbr_id and nx, ny, nz.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions.vec import Vec3
from skein.operators.blocks import TARGETS, block_edges
from skein.operators.geometry import bounding_box
from skein.operators.profiles import Measure
from skein.session import reliable
from skein.skew import HOT_ROWS, hottest, salted_join

P, N = Vec3.of(), Vec3.of("nx", "ny", "nz")
QUERY_KEY = ("line_id", "pt_idx")
EDGES_KEY = ("line_id", "pt_idx", "nbr_line", "nbr_pt")
CELL = ["_cx", "_cy", "_cz"]
MAX_LEVELS = 12
CROWDED = 64             # vertices of one line in one cell above which cells are refined
WIDEST = 16              # most that the sides of cells are widened
FEW = 1 << 16            # targets below which cells are not widened
CELLS = 64               # least number of cells that rows are dealt to where cells are widened


def as_targets(points: DataFrame, *extra: str) -> DataFrame:
    return points.select(
        F.col("line_id").alias("nbr_line"), F.col("pt_idx").alias("nbr_id"),
        *P.named("nx", "ny", "nz"), *extra,
    )


def _sides(size: float | Sequence[float]) -> Sequence[float]:
    return size if isinstance(size, Sequence) else [size] * 3


def _cells(v: Vec3, size: float | Sequence[float]) -> dict[str, Column]:
    return {n: F.floor(c / F.lit(side)).cast("bigint") for n, c, side in zip(CELL, v.parts, _sides(size))}


def _around(df: DataFrame, v: Vec3, radius: float, size: float | Sequence[float]) -> DataFrame:
    """One row per cell that the ball around ``v`` may touch: 8 with cells of twice the radius."""
    for name, c, side in zip(CELL, v.parts, _sides(size)):
        # the slack covers the rounding of a difference that the distance test lets pass
        reach = F.lit(radius) + (F.abs(c) + F.lit(radius)) * F.lit(1e-12)
        low, high = (F.floor(x / F.lit(side)).cast("bigint") for x in (c - reach, c + reach))
        df = df.withColumn(name, F.explode(F.sequence(low, high)))
    return df


def _parent(levels: int) -> list[Column]:
    return [F.shiftright(F.col(c), levels).alias(c) for c in CELL]


def largest_in_cell(targets: DataFrame, size: float, same: Sequence[str] = ()) -> int:
    """Most vertices of one line in a cell."""
    return hottest(targets.withColumns(_cells(N, size)), [*CELL, *same, "nbr_line"])


def _asked_in_cell(queries: DataFrame, size: float, same: Sequence[str]) -> int:
    """Bound on the query rows that meet in one cell, as each is copied to adjoining cells only."""
    return hottest(queries.withColumns(_cells(P, size)), [*CELL, *same]) * 27


def nearest_per_line(
    queries: DataFrame,
    targets: DataFrame,
    radius: float,
    key: Sequence[str] = QUERY_KEY,
    same: Sequence[str] = (),
    own: str | None = "line_id",
    gate: Column | None = None,
    crowded: int = CROWDED,
    hot_rows: int = HOT_ROWS,
    earlier: bool = False,
    most: int = TARGETS,
    limit: int | None = None,
) -> DataFrame:
    """For each query and each other line: its nearest target within ``radius``.

    ``own`` names the query column whose line is left out, with ``earlier`` also the lines after it; ``same`` lists further columns on which
    both sides have to agree; ``gate`` is an extra condition on a pair. Returns key, nbr_line,
    nbr_id and dist; the smallest nbr_id wins a tie. Where only the ``limit`` nearest lines are asked for, farther
    ones may be left out.

    Pairs are met and compared in blocks (``nearest_in_blocks``), without a shuffle of pairs. That needs lines of
    no more than ``most`` vertices in a cell, keys that do not repeat, whole numbers as lines, and neither ``gate`` nor ``same``.

    Else, where one line has many vertices in a cell, cells are refined by halving: a query first meets
    (cell, line) boxes instead of vertices, and keeps only those boxes of a line that can still
    hold its nearest vertex, level by level. So the work follows the size of the result rather
    than the number of vertex pairs. Rows of crowded cells are dealt to several tasks.
    """
    key, same = list(key), list(same)
    size = 2.0 * radius
    per_line = largest_in_cell(targets, size, same)
    if not same and gate is None and per_line <= most and in_blocks(queries, targets, key, own):
        return nearest_in_blocks(queries, targets, radius, key, own, earlier=earlier, crowded=crowded, limit=limit)
    largest = _asked_in_cell(queries, size, same)
    r2 = F.lit(float(radius) * float(radius))
    other = (F.col(own) > F.col("nbr_line") if earlier else F.col(own) != F.col("nbr_line")) if own else F.lit(True)
    d2 = P.sq_dist(N)
    best = F.min(F.struct(d2.alias("d2"), F.col("nbr_id"))).alias("_m")

    def finish(pairs: DataFrame) -> DataFrame:
        ok = (d2 <= r2) & other
        near = pairs.where(ok if gate is None else ok & gate)
        return near.groupBy(*key, "nbr_line").agg(best).select(
            *key, "nbr_line", F.col("_m.nbr_id").alias("nbr_id"), F.sqrt("_m.d2").alias("dist")
        )

    around = _around(queries, P, radius, size)
    if per_line <= crowded or gate is not None:
        return finish(
            salted_join(
                around, targets.withColumns(_cells(N, size)), [*CELL, *same], spread=key,
                hot_rows=hot_rows, largest=largest,
            )
        )

    # One vertex per place is enough, and lets refinement separate the rest.
    targets = targets.groupBy("nbr_line", "nx", "ny", "nz", *same).agg(
        F.min("nbr_id").alias("nbr_id")
    )
    levels = 0
    while levels < MAX_LEVELS and per_line > crowded:
        levels += 1
        per_line = largest_in_cell(targets, size / 2**levels, same)
    fine = targets.withColumns(_cells(N, size / 2**levels))
    box = [f(c).alias(f"_{n}{c}") for c in ("nx", "ny", "nz") for n, f in (("l", F.min), ("h", F.max))]

    def boxes(level: int) -> DataFrame:
        up = fine.select("nbr_line", *same, "nx", "ny", "nz", *_parent(levels - level))
        return up.groupBy(*CELL, *same, "nbr_line").agg(*box)

    sides = [(P.x, "nx"), (P.y, "ny"), (P.z, "nz")]
    gaps = [F.greatest(F.col(f"_l{c}") - a, a - F.col(f"_h{c}"), F.lit(0.0)) for a, c in sides]
    reach = [F.greatest(a - F.col(f"_l{c}"), F.col(f"_h{c}") - a) for a, c in sides]
    closest = gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]
    farthest = reach[0] * reach[0] + reach[1] * reach[1] + reach[2] * reach[2]
    per_query_line = Window.partitionBy(*key, "nbr_line")
    drop = [f"_{n}{c}" for c in ("nx", "ny", "nz") for n in "lh"]

    def prune(cand: DataFrame) -> DataFrame:
        slack = F.lit(1.0 + 1e-9)
        bound = F.least(F.min(farthest).over(per_query_line) * slack, r2 * slack)
        return cand.withColumn("_b", bound).where(closest <= F.col("_b")).drop("_b", *drop)

    cand = prune(
        salted_join(
            around, boxes(0), [*CELL, *same], spread=key, hot_rows=hot_rows,
            largest=largest,
        ).where(other)
    )
    for level in range(1, levels + 1):
        below = boxes(level).select(
            "*", *[F.shiftright(F.col(c), 1).alias(f"_p{c}") for c in CELL]
        )
        up = cand.withColumnsRenamed({c: f"_p{c}" for c in CELL})
        cand = prune(
            up.join(below, [*[f"_p{c}" for c in CELL], *same, "nbr_line"]).drop(
                *[f"_p{c}" for c in CELL]
            )
        )
    return finish(cand.join(fine, [*CELL, *same, "nbr_line"]))


def in_blocks(queries: DataFrame, targets: DataFrame, key: Sequence[str], own: str | None) -> bool:
    """Whether blocks may give out edges as they go: each query is one row, and lines can be told apart there."""
    whole = {"bigint", "int", "smallint", "tinyint"}
    kinds = dict(queries.dtypes).get(own, "int"), dict(targets.dtypes)["nbr_line"]
    return (own is None or set(kinds) <= whole) and hottest(queries, key) <= 1


def wide_cells(targets: DataFrame, radius: float, most: int) -> list[float]:
    """Sides of the cells: twice the radius, doubled as long as a cell's targets still fit a share of ``most``.

    A target is copied to each cell that it may be met from, which are 8 of twice the radius, but 1 + 1 / k on average along an
    axis where cells are k times as long, and one where a cell holds all. Sides are doubled where that saves the most copies.
    """
    size = 2.0 * radius
    counts = reliable(targets.groupBy(*[c.alias(n) for n, c in _cells(N, size).items()]).count())
    span = counts.agg(*[(F.max(c) - F.min(c) + 1).alias(c) for c in CELL], F.sum("count").alias("n")).first()
    if (span["n"] or 0) < FEW:
        return [size] * 3
    wide, open_axes = [1, 1, 1], {0, 1, 2}

    def copies(k: int, w: int) -> float:
        return 1.0 + 1.0 / w if span[CELL[k]] is not None and span[CELL[k]] > w else 1.0

    while open_axes:
        k = max(sorted(open_axes), key=lambda i: copies(i, wide[i]) / copies(i, 2 * wide[i]))
        tried = [w * 2 if i == k else w for i, w in enumerate(wide)]
        if copies(k, wide[k]) == 1.0 or wide[k] >= WIDEST:
            open_axes.discard(k)
            continue
        top = counts.groupBy(*[F.floor(F.col(c) / w) for c, w in zip(CELL, tried)]).agg(F.sum("count").alias("n")).agg(
            F.max("n")).first()[0]
        each = copies(0, tried[0]) * copies(1, tried[1]) * copies(2, tried[2])
        if top * each > most or top * CELLS > span["n"]:
            open_axes.discard(k)
        else:
            wide = tried
    return [size * w for w in wide]


def nearest_in_blocks(
    queries: DataFrame, targets: DataFrame, radius: float, key: Sequence[str] = QUERY_KEY, own: str | None = "line_id",
    most: int = TARGETS, size: Sequence[float] | None = None, **args
) -> DataFrame:
    """As ``nearest_per_line`` for keys that do not repeat, with the arguments of ``block_edges``."""
    size = size or wide_cells(targets, radius, most)
    return block_edges(
        queries.withColumns(_cells(P, size)), _around(targets, N, radius, size), CELL, radius, key, own, most=most, **args)


def neighbour_edges(points: DataFrame, radius: float, asks: Sequence[str] = (), gives: Sequence[str] = (), limit: int | None = None,
                    size: Sequence[float] | None = None, **args) -> DataFrame:
    """Edges from every point to the nearest vertex of each other line within ``radius``.

    Columns of the point named in ``asks`` come along, and of the vertex those in ``gives`` as n_<name>. With
    ``limit`` only the nearest lines of each point, with their ``rank`` from 1. ``size`` tells the sides of the cells
    where it is known that blocks will do.
    """
    key, points = list(QUERY_KEY), points if size else reliable(points)
    if not asks and not gives and limit is None and not size:
        return nearest_per_line(points, as_targets(points), radius, **args).withColumnRenamed("nbr_id", "nbr_pt")
    targets = as_targets(points, *[F.col(c).alias(f"n_{c}") for c in gives])
    given = [f"n_{c}" for c in gives]
    most = args.pop("most", TARGETS)
    if size or largest_in_cell(targets, 2.0 * radius) <= most and in_blocks(points, targets, key, "line_id"):
        # what is ranked should come from as few shares as may be
        return nearest_in_blocks(points, targets, radius, asks=asks, gives=given, limit=limit, ranked=limit is not None, size=size,
                                 most=most * 4 if limit else most, **args).withColumnRenamed("nbr_id", "nbr_pt")
    edges = nearest_per_line(points, targets, radius, most=0, **args).withColumnRenamed("nbr_id", "nbr_pt")
    if asks:
        edges = edges.join(points.select(*key, *asks), key)
    if gives:
        edges = edges.join(targets.select("nbr_line", F.col("nbr_id").alias("nbr_pt"), *given), ["nbr_line", "nbr_pt"])
    return edges if limit is None else top_neighbours(edges, limit)


@dataclass(frozen=True)
class Search:
    """``neighbour_edges`` that are still to be found, so that a measure of them is taken where rows meet."""

    points: DataFrame
    radius: float
    limit: int | None = None
    most: int = TARGETS

    def blocks(self) -> bool:
        """Whether the edges are found in blocks."""
        targets = as_targets(self.points)
        return largest_in_cell(targets, 2.0 * self.radius) <= self.most and in_blocks(self.points, targets, QUERY_KEY, "line_id")

    def measured(self, held: DataFrame, measure: Measure) -> DataFrame:
        """The edges with ``dist``, ``rank`` if there is a limit, and the measure. ``held`` has the points with ``_f``."""
        return nearest_in_blocks(
            held, as_targets(held, F.col("_f").alias("n__f")), self.radius, limit=self.limit, ranked=self.limit is not None,
            most=self.most * 4 if self.limit else self.most,
            size=wide_cells(as_targets(self.points), self.radius, self.most * 4 if self.limit else self.most), measure=measure,
        ).withColumnRenamed("nbr_id", "nbr_pt")


def aligned_edges(points: DataFrame, radius: float, cosine: float = 0.98) -> DataFrame:
    """As ``neighbour_edges`` among vertices with nearly parallel tangents (tx, ty, tz)."""
    points = reliable(points)
    targets = as_targets(
        points, *[F.col(f"t{c}").alias(f"n_t{c}") for c in "xyz"]
    )
    along = Vec3.of("tx", "ty", "tz").dot(Vec3.of("n_tx", "n_ty", "n_tz"))
    if largest_in_cell(targets, 2.0 * radius) <= TARGETS and in_blocks(points, targets, QUERY_KEY, "line_id"):
        edges = nearest_in_blocks(points, targets, radius, cosine=cosine)
    else:
        edges = nearest_per_line(points, targets, radius, gate=F.abs(along) >= cosine)
    return edges.withColumnRenamed("nbr_id", "nbr_pt")


# ------------------------------------------------------------------ one query point


def nearest_vertices(points: DataFrame, at: Vec3) -> DataFrame:
    """Nearest vertex of every line to one place, given as literals or scalar subqueries."""
    return (
        points.withColumn("_d", P.dist(at))
        .groupBy("line_id")
        .agg(F.min(F.struct(F.col("_d").alias("dist"), F.col("pt_idx"))).alias("m"))
        .select("line_id", "m.pt_idx", "m.dist")
    )


# ------------------------------------------------------------------ k nearest lines


def nearest_lines(
    queries: DataFrame,
    targets: DataFrame,
    k: int,
    start_radius: float,
    key: Sequence[str] = QUERY_KEY,
    own: str | None = "line_id",
    growth: float = 2.0,
) -> DataFrame:
    """The ``k`` nearest lines of each query, by nearest vertex; exact.

    The search radius grows by ``growth`` for the queries that have found fewer than ``k`` lines; within a
    radius all lines are known, so a query with ``k`` of them is finished. The radius ends at the
    diagonal of all data.
    """
    key = list(key)
    both = queries.select("x", "y", "z").unionByName(targets.select(*N.named()))
    limit = bounding_box(both).first()["diagonal"]
    rank = Window.partitionBy(*key).orderBy("dist", "nbr_line")
    radius, open_queries, parts = float(start_radius), queries, []
    while True:
        found = nearest_per_line(open_queries, targets, radius, key, own=own, limit=k).withColumn(
            "rank", F.row_number().over(rank)
        ).where(F.col("rank") <= k)
        last = radius >= limit
        if last:
            parts.append(found)
            break
        found = reliable(found)
        full = found.groupBy(*key).count().where(F.col("count") >= k).select(*key)
        parts.append(found.join(full, key, "left_semi"))
        open_queries = reliable(open_queries.join(full, key, "left_anti"))
        if open_queries.isEmpty():
            break
        radius = min(radius * growth, limit * (1 + 1e-9))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ------------------------------------------------------------------ selections


def points_within(points: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """Points within ``radius`` of at least one center (x, y, z)."""
    spots = centers.select(*P.named("nx", "ny", "nz"))
    near = _around(spots, N, radius, 2.0 * radius).distinct()
    keyed = points.withColumns(_cells(P, 2.0 * radius))
    cond = P.sq_dist(N) <= F.lit(float(radius) ** 2)
    for c in CELL:
        near = near.withColumnRenamed(c, f"{c}2")
        cond = cond & (F.col(c) == F.col(f"{c}2"))
    return keyed.join(near, cond, "left_semi").drop(*CELL)


def lines_within(points: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """Distinct lines with a vertex within ``radius`` of any center."""
    return points_within(points, centers, radius).select("line_id").distinct()


def mark_lines(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Add alpha 1 to the points of the given lines, 0 to the others."""
    hits = lines.withColumn("_hit", F.lit(1.0))
    flagged = salted_join(points, hits, ["line_id"], "left", spread=["pt_idx"])
    return flagged.withColumn("alpha", F.coalesce("_hit", F.lit(0.0))).drop("_hit")


# ------------------------------------------------------------------ edges


def mutual_edges(edges: DataFrame, slack: int = 1) -> DataFrame:
    """Edges whose target lists the source line with a vertex within ``slack`` of the source.

    Both sides of the semi join are the same edges; they are fixed once instead of found twice.
    """
    edges = reliable(edges)
    back = edges.select(
        F.col("line_id").alias("nbr_line"),
        F.col("pt_idx").alias("nbr_pt"),
        F.col("nbr_line").alias("line_id"),
        F.col("nbr_pt").alias("_back"),
    )
    a, b = edges.alias("a"), back.alias("b")
    cond = (
        (F.col("a.line_id") == F.col("b.line_id"))
        & (F.col("a.nbr_line") == F.col("b.nbr_line"))
        & (F.col("a.nbr_pt") == F.col("b.nbr_pt"))
        & (F.abs(F.col("b._back") - F.col("a.pt_idx")) <= slack)
    )
    return a.join(b, cond, "left_semi")


def own_near(points: DataFrame, reach: float) -> DataFrame:
    """The points with ``_own``: the vertices of their own line within ``reach``, themselves included."""
    size = 4.0 * reach
    spots = _around(as_targets(points), N, reach, size).groupBy(*CELL, F.col("nbr_line").alias("line_id")).agg(
        F.collect_list(F.struct("nbr_id", "nx", "ny", "nz")).alias("_own"))
    near = points.withColumns(_cells(P, size)).join(spots, [*CELL, "line_id"], "left").drop(*CELL)
    return near.withColumn("_own", F.filter(
        "_own", lambda o: P.sq_dist(Vec3(o["nx"], o["ny"], o["nz"])) <= F.lit(reach * reach * (1.0 + 1e-9))))


def mutual_cells(points: DataFrame, radius: float, crowded: int = CROWDED) -> list[float] | None:
    """Sides of the cells in which ``mutual_neighbour_edges`` are told in place; none where lines crowd a cell."""
    targets = as_targets(points)
    if largest_in_cell(targets, 4.0 * radius) > crowded or not in_blocks(points, targets, QUERY_KEY, "line_id"):
        return None
    return wide_cells(targets, radius, TARGETS)


def mutual_neighbour_edges(
    points: DataFrame, radius: float, asks: Sequence[str] = (), gives: Sequence[str] = (), slack: int = 1, crowded: int = CROWDED,
    size: Sequence[float] | None = None,
) -> DataFrame:
    """``mutual_edges`` of ``neighbour_edges``, told in place: no edge is shuffled to meet its way back.

    The way back from a target ends in the vertex of the source's line that is nearest to it, and since the target
    is within ``radius`` of the source, that vertex is within twice the radius of the source. A point
    so needs its own line's vertices that near, of which there are few. Lines that crowd a cell take the join. ``size`` is what
    ``mutual_cells`` has told, and points may bring ``_own`` (``own_near``), so that neither is worked out again.
    """
    if size is None:
        points = reliable(points)
        size = mutual_cells(points, radius, crowded)
    if size is None:
        edges = neighbour_edges(points, radius, asks, gives)
        return mutual_edges(edges, slack)
    held = points if "_own" in points.columns else own_near(points, 2.0 * radius)
    taken, given = list(dict.fromkeys([*asks, "_own"])), list(dict.fromkeys([*gives, *"xyz"]))
    edges = neighbour_edges(held, radius, asks=taken, gives=given, size=size)
    there = Vec3.of("n_x", "n_y", "n_z")

    def back(o: Column) -> Column:
        return F.struct(there.sq_dist(Vec3(o["nx"], o["ny"], o["nz"])).alias("d2"), o["nbr_id"])

    nearest = F.array_min(F.transform("_own", back))["nbr_id"]
    found = edges.where((F.size("_own") == 1) | (F.abs(nearest - F.col("pt_idx")) <= slack))
    return found.drop("_own", *[f"n_{c}" for c in "xyz" if c not in gives])


def top_neighbours(edges: DataFrame, k: int = 64) -> DataFrame:
    """The ``k`` nearest lines of each point with their rank from 1."""
    w = Window.partitionBy("line_id", "pt_idx").orderBy("dist", "nbr_line")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def drop_lines(table: DataFrame, lines: DataFrame, *columns: str) -> DataFrame:
    """Rows that name none of ``lines`` in any of ``columns``."""
    gone = lines.select(F.col("line_id").alias("_gone"))
    for c in columns or ("line_id",):
        table = table.join(gone, F.col(c) == F.col("_gone"), "left_anti")
    return table


def rank_error(exact: DataFrame, found: DataFrame, key: Sequence[str] = QUERY_KEY) -> DataFrame:
    """Per query: lines found and mean absolute difference of distances at equal rank."""
    return (
        exact.select(*key, "rank", F.col("dist").alias("_exact"))
        .join(found.select(*key, "rank", "dist"), [*key, "rank"])
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("_exact") - F.col("dist"))).alias("error")
        )
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """Totals over all queries: queries, neighbours and mean error."""
    return errors.agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("n").alias("neighbours"),
        F.avg("error").alias("mean_error"),
    )
