"""Exact neighbour search on the event lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.vec import Vec3
from skein.operators import geometry as G
from skein.operators import search as N
from skein.queries.base import POINTS, TANGENTS, query, rounded, s6, with_ctes
from skein.sources.tables import event_points, supplier_critical_points

KEY = ["line_id", "pt_idx"]
RADIUS = 0.5

PAIRS = f"""pairs AS (
  SELECT a.line_id, a.pt_idx, b.line_id AS nbr_line, b.pt_idx AS nbr_pt,
    (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS d2
  FROM points a JOIN points b ON a.line_id <> b.line_id AND b.x BETWEEN a.x - {RADIUS} AND a.x + {RADIUS}
  WHERE (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= {RADIUS**2}e0)"""

EDGES = PAIRS + """,
edges AS (
  SELECT line_id, pt_idx, nbr_line, arg_min(nbr_pt, (d2, nbr_pt)) AS nbr_pt, sqrt(min(d2)) AS dist
  FROM pairs GROUP BY line_id, pt_idx, nbr_line)"""

CRITICAL = """critical AS (
  SELECT s_suppkey AS cp_id, (s_suppkey*7 % 31)::DOUBLE AS x, abs(s_acctbal)/250e0 AS y,
    (s_nationkey % 5 + 1)::DOUBLE AS z, CAST(s_nationkey % 8 AS INTEGER) AS type,
    (1e0 + s_suppkey % 3)::DOUBLE AS scale
  FROM supplier)"""


def edges(spark, folder):
    return N.neighbour_edges(event_points(spark, folder), RADIUS)


@query("range_edges", with_ctes(POINTS, EDGES, select=f"""
SELECT line_id, pt_idx, nbr_line, nbr_pt, {s6('dist')} FROM edges"""))
def range_edges(spark, folder):
    return rounded(edges(spark, folder), "dist")


@query("range_edges_refined", with_ctes(POINTS, EDGES.replace("0.5", "2.0").replace("0.25e0", "4.0e0"), select=f"""
SELECT line_id, pt_idx, nbr_line, nbr_pt, {s6('dist')} FROM edges"""))
def range_edges_refined(spark, folder):
    found = N.neighbour_edges(event_points(spark, folder), 2.0, crowded=2)
    return rounded(found, "dist")


@query("aligned_edges", with_ctes(POINTS, TANGENTS, f"""aligned AS (
  SELECT a.line_id, a.pt_idx, b.line_id AS nbr_line, b.pt_idx AS nbr_pt,
    (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS d2
  FROM tangents a JOIN tangents b ON a.line_id <> b.line_id AND b.x BETWEEN a.x - 0.6 AND a.x + 0.6
  WHERE (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.2527e0
    AND abs(a.tx*b.tx + a.ty*b.ty + a.tz*b.tz) >= 0.98e0)""", select=f"""
SELECT line_id, pt_idx, nbr_line, arg_min(nbr_pt, (d2, nbr_pt)) AS nbr_pt, {s6('sqrt(min(d2))', 'dist')}
FROM aligned GROUP BY line_id, pt_idx, nbr_line"""))
def aligned_edges(spark, folder):
    points = G.tangents(event_points(spark, folder))
    return rounded(N.aligned_edges(points, 0.2527**0.5), "dist")


@query("exact_nearest_per_line", with_ctes(POINTS, """centre AS (
  SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points),
dist AS (SELECT line_id, pt_idx, sqrt((x-cx)**2+(y-cy)**2+(z-cz)**2) AS d FROM points, centre)""",
  select=f"""SELECT line_id, arg_min(pt_idx, (d, pt_idx)) AS pt_idx, {s6('min(d)', 'dist')}
FROM dist GROUP BY line_id"""))
def exact_nearest_per_line(spark, folder):
    points = event_points(spark, folder)
    mean = points.agg(F.struct(*[F.avg(c).alias(c) for c in "xyz"]).alias("c")).scalar()
    with_mean = points.withColumn("_c", mean)
    return rounded(N.nearest_vertices(with_mean, Vec3.field(F.col("_c"))), "dist")


KNN = """best AS (
  SELECT a.line_id, a.pt_idx, b.line_id AS nbr_line, min((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d2
  FROM points a JOIN points b ON a.line_id <> b.line_id GROUP BY ALL),
knn AS (
  SELECT line_id, pt_idx, nbr_line, sqrt(d2) AS dist,
    CAST(row_number() OVER (PARTITION BY line_id, pt_idx ORDER BY sqrt(d2), nbr_line) AS INTEGER) AS rank
  FROM best QUALIFY rank <= 3)"""


@query("exact_knn_lines", with_ctes(POINTS, KNN, select=f"""
SELECT line_id, pt_idx, nbr_line, rank, {s6('dist')} FROM knn"""))
def exact_knn_lines(spark, folder):
    points = event_points(spark, folder)
    found = N.nearest_lines(points, N.as_targets(points), 3, RADIUS)
    return rounded(found.select(*KEY, "nbr_line", "rank", "dist"), "dist")


@query("radius_selection", with_ctes(POINTS, CRITICAL, select="""
SELECT DISTINCT p.line_id FROM points p JOIN critical c
  ON (p.x-c.x)**2 + (p.y-c.y)**2 + (p.z-c.z)**2 <= 0.0625e0"""))
def radius_selection(spark, folder):
    return N.lines_within(
        event_points(spark, folder), supplier_critical_points(spark, folder), 0.25
    )


@query("critical_point_lines", with_ctes(POINTS, CRITICAL, """hit AS (
SELECT DISTINCT p.line_id FROM points p JOIN critical c
  ON (p.x-c.x)**2 + (p.y-c.y)**2 + (p.z-c.z)**2 <= 0.04e0)""", select="""
SELECT line_id, pt_idx, CASE WHEN line_id IN (SELECT line_id FROM hit) THEN 1e0 ELSE 0e0 END AS alpha
FROM points"""))
def critical_point_lines(spark, folder):
    points = event_points(spark, folder)
    lines = N.lines_within(points, supplier_critical_points(spark, folder), 0.2)
    return N.mark_lines(points, lines).select(*KEY, "alpha")


MUTUAL = """mutual AS (
  SELECT * FROM edges a WHERE EXISTS (SELECT 1 FROM edges b
    WHERE b.line_id = a.nbr_line AND b.pt_idx = a.nbr_pt AND b.nbr_line = a.line_id
      AND abs(b.nbr_pt - a.pt_idx) <= 1))"""


@query("mutual_edges", with_ctes(POINTS, EDGES, MUTUAL, select=f"""
SELECT line_id, pt_idx, nbr_line, nbr_pt, {s6('dist')} FROM mutual"""))
def mutual_edges(spark, folder):
    return rounded(N.mutual_neighbour_edges(event_points(spark, folder), RADIUS), "dist")


@query("topk_neighbors", with_ctes(POINTS, EDGES, select=f"""
SELECT line_id, pt_idx, nbr_line, nbr_pt, {s6('dist')},
  CAST(row_number() OVER (PARTITION BY line_id, pt_idx ORDER BY dist, nbr_line) AS INTEGER) AS rank
FROM edges QUALIFY rank <= 64"""))
def topk_neighbors(spark, folder):
    return rounded(N.neighbour_edges(event_points(spark, folder), RADIUS, limit=64), "dist")
