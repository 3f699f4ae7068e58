"""Similarity, transparency and saliency of the event lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars
from skein.operators import geometry as G
from skein.operators import lsh as L
from skein.operators import search as N
from skein.operators import similarity as M
from skein.queries.base import ARCS, CURVATURE, POINTS, query, rounded, s6, with_ctes
from skein.queries.geometry_queries import KEY
from skein.queries.lsh_queries import BASE, FILED, _index, _table
from skein.queries.search_queries import CRITICAL, EDGES, RADIUS, edges
from skein.session import reliable
from skein.plans.analysis import Application, Settings, analyze
from skein.sources.tables import event_points, supplier_critical_points

#: Vertices with their windows that one task holds at a time (about 400 bytes each).
FRAMED = 1 << 14


def profile_sql(name: str, low: int, high: int, value: str) -> str:
    """CTE with the value at every index offset that both lines of an edge have."""
    return f"""{name} AS (
  SELECT e.line_id, e.pt_idx, e.nbr_line, e.nbr_pt, e.dist, o, {value} AS v
  FROM edges e, range({low}, {high + 1}) t(o)
  JOIN points a ON a.line_id = e.line_id AND a.pt_idx = e.pt_idx + o
  JOIN points b ON b.line_id = e.nbr_line AND b.pt_idx = e.nbr_pt + o
  JOIN points p ON p.line_id = e.line_id AND p.pt_idx = e.pt_idx
  JOIN points q ON q.line_id = e.nbr_line AND q.pt_idx = e.nbr_pt)"""


DIST = "sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)"
SHAPE = "sqrt(((a.x-b.x)-(p.x-q.x))**2 + ((a.y-b.y)-(p.y-q.y))**2 + ((a.z-b.z)-(p.z-q.z))**2)"

POINT_SIM = profile_sql("prof", -1, 1, DIST) + """,
similars AS (
  SELECT line_id, pt_idx, nbr_line, nbr_pt, dist,
    (SUM((v-dist)**2) - arg_max((v-dist)**2, o)) / COUNT(*) AS similarity
  FROM prof GROUP BY line_id, pt_idx, nbr_line, nbr_pt, dist)"""

VARIATION = profile_sql("shape", -8, 0, SHAPE) + """,
varied AS (
  SELECT line_id, pt_idx, nbr_line, nbr_pt, dist, SUM(v) AS variation,
    row_number() OVER (PARTITION BY line_id, pt_idx ORDER BY dist, nbr_line) AS rank
  FROM shape GROUP BY line_id, pt_idx, nbr_line, nbr_pt, dist),
tbl AS (SELECT * FROM varied WHERE rank <= 64)"""


def neighbour_table(points):
    """Top 64 neighbours of each point with the variation of each."""
    return M.shape_variation(table_search(points), points, keep=["dist", "rank"])


def table_search(points):
    return N.Search(points, RADIUS, 64, FRAMED)


@query("point_similarity", with_ctes(POINTS, EDGES, POINT_SIM, select=f"""
SELECT line_id, pt_idx, nbr_line, nbr_pt, {s6('similarity')} FROM similars"""))
def point_similarity(spark, folder):
    points = reliable(event_points(spark, folder))
    return rounded(M.point_similarity(N.Search(points, RADIUS, most=FRAMED), points), "similarity")


@query("distance_variation", with_ctes(POINTS, EDGES, profile_sql("prof", -8, 8, DIST), select=f"""
SELECT line_id, pt_idx, nbr_line, nbr_pt, {s6('dist')}, {s6('''CASE WHEN COUNT(*) > 2 THEN
  (SUM((v-dist)**2) - arg_max((v-dist)**2, o)) / (COUNT(*) - 2) ELSE 0e0 END''', 'variation')}
FROM prof GROUP BY line_id, pt_idx, nbr_line, nbr_pt, prof.dist"""))
def distance_variation(spark, folder):
    points = reliable(event_points(spark, folder))
    return rounded(M.distance_variation(N.Search(points, RADIUS, most=FRAMED), points), "dist", "variation")


@query("shape_variation", with_ctes(POINTS, EDGES, VARIATION, select=f"""
SELECT line_id, pt_idx, nbr_line, nbr_pt, {s6('variation')} FROM varied"""))
def shape_variation(spark, folder):
    points = reliable(event_points(spark, folder))
    return rounded(M.shape_variation(N.Search(points, RADIUS, most=FRAMED), points), "variation")


@query("shape_variation_both", with_ctes(POINTS, EDGES, profile_sql("shape", -8, 8, SHAPE), select=f"""
SELECT line_id, pt_idx, nbr_line, nbr_pt, {s6('SUM(v)', 'variation')} FROM shape
GROUP BY line_id, pt_idx, nbr_line, nbr_pt"""))
def shape_variation_both(spark, folder):
    points = reliable(event_points(spark, folder))
    return rounded(M.shape_variation(N.Search(points, RADIUS, most=FRAMED), points, sides="both"), "variation")


SEG_PAIRS = """seg_pairs AS (
  SELECT DISTINCT a.line_id, a.beg, a.end_, f.line_id AS nbr_line, f.beg AS nbr_beg, f.end_ AS nbr_end,
    (a.cx-f.cx)**2 + (a.cy-f.cy)**2 + (a.cz-f.cz)**2 AS d2
  FROM filed a JOIN filed f ON f.table_id = a.table_id AND f.fp1 = a.fp1 AND f.fp2 = a.fp2
  WHERE d2 <= 1.5e0),
seg_near AS (
  SELECT * FROM seg_pairs
  QUALIFY row_number() OVER (PARTITION BY line_id, beg, end_, nbr_line ORDER BY d2, nbr_beg) = 1),
aligned AS (
  SELECT *, (beg+end_)//2 AS m, (nbr_beg+nbr_end)//2 AS n FROM seg_near),
offsets AS (
  SELECT *, unnest(range(GREATEST(-20, beg-m, nbr_beg-n), LEAST(20, end_-1-m, nbr_end-1-n) + 1)) AS o FROM aligned)"""


def _segment_pairs(points, segments):
    """Pairs of segments that bring the windows of both along."""
    index, window = _index(segments), ["_w", "_at"]
    segments = M.segment_windows(points, segments)
    asked = segments.select("line_id", "beg", "end_", *L.C.named("x", "y", "z"), *window)
    near = L.centroid_edges(
        index,
        asked.withColumnsRenamed({"beg": "q_beg", "end_": "q_end"}),
        segments,
        key=["line_id", "q_beg", "q_end"],
        own=None,
        asks=window,
        gives=window,
    )
    return near.select(
        "line_id", F.col("q_beg").alias("beg"), F.col("q_end").alias("end_"), "nbr_line",
        F.col("beg").alias("nbr_beg"), F.col("end_").alias("nbr_end"), *window, "n__w", "n__at",
    )


@query("affinity_matrix", with_ctes(*BASE, FILED, SEG_PAIRS, select=f"""
SELECT s.line_id, s.beg, s.end_, s.nbr_line, s.nbr_beg, s.nbr_end,
  {s6('avg((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)', 'similarity')}
FROM offsets s JOIN points a ON a.line_id = s.line_id AND a.pt_idx = s.m + s.o
  JOIN points b ON b.line_id = s.nbr_line AND b.pt_idx = s.n + s.o
GROUP BY s.line_id, s.beg, s.end_, s.nbr_line, s.nbr_beg, s.nbr_end"""))
def affinity_matrix(spark, folder):
    points = event_points(spark, folder)
    pairs = _segment_pairs(points, _table(points))
    return rounded(M.affinity(pairs), "similarity")


ALPHA = """alphas AS (
  SELECT p.line_id, p.pt_idx, CASE WHEN SUM(w) IS NULL OR SUM(w) = 0 THEN 1e0
    ELSE LEAST(1e0, GREATEST(0e0, COALESCE(SUM(w*(p.kappa-q.kappa)**2) / SUM(w), 0e0))) END AS alpha
  FROM curved p LEFT JOIN (SELECT *, exp(-dist*dist/2)/sqrt(2*pi()) AS w FROM edges) e
    ON e.line_id = p.line_id AND e.pt_idx = p.pt_idx
  LEFT JOIN curved q ON q.line_id = e.nbr_line AND q.pt_idx = e.nbr_pt
  GROUP BY p.line_id, p.pt_idx)"""


def alphas(spark, folder):
    points = event_points(spark, folder)
    curved = G.curvature(points)
    return M.transparency(N.neighbour_edges(curved, RADIUS, asks=["kappa"], gives=["kappa"]), curved)


@query("transparency_alpha", with_ctes(POINTS, CURVATURE, EDGES, ALPHA, select=f"""
SELECT line_id, pt_idx, {s6('alpha')} FROM alphas"""))
def transparency_alpha(spark, folder):
    return rounded(alphas(spark, folder), "alpha")


@query("rgba_colors", with_ctes(POINTS, CURVATURE, EDGES, ALPHA, """rounded_alpha AS (
  SELECT line_id, pt_idx, ROUND(alpha + 3.7e-8, 6) AS a FROM alphas)""", select="""
SELECT line_id, pt_idx, CAST(trunc(73 + 169*a) AS BIGINT) AS r, CAST(trunc(185 - 126*a) AS BIGINT) AS g,
  CAST(trunc(249 - 173*a) AS BIGINT) AS b, CAST(255 AS BIGINT) AS a FROM rounded_alpha"""))
def rgba_colors(spark, folder):
    packed = rounded(alphas(spark, folder), "alpha").withColumn(
        "c", scalars.alpha_color(F.col("alpha"))
    )
    channels = scalars.unpack_rgba(F.col("c"))
    return packed.select(*KEY, *[c.cast("bigint").alias(n) for n, c in channels.items()])


@query("center_surround_alpha", with_ctes(POINTS, EDGES, POINT_SIM, """per AS (
  SELECT line_id, pt_idx, COUNT(*) FILTER (dist < 0.25e0) AS near,
    abs(COALESCE(SUM(exp(-(dist**2)/0.5e0)*similarity) FILTER (dist < 0.5e0) / NULLIF(SUM(exp(-(dist**2)/0.5e0)) FILTER (dist < 0.5e0), 0), 0e0)
     - COALESCE(SUM(exp(-(dist**2)/0.125e0)*similarity) FILTER (dist < 0.25e0) / NULLIF(SUM(exp(-(dist**2)/0.125e0)) FILTER (dist < 0.25e0), 0), 0e0)) AS a
  FROM similars GROUP BY line_id, pt_idx)""", select=f"""
SELECT p.line_id, p.pt_idx, {s6('CASE WHEN COALESCE(near, 0) = 0 THEN -1e0 ELSE LEAST(1e0, GREATEST(0e0, a)) END', 'alpha')}
FROM points p LEFT JOIN per ON per.line_id = p.line_id AND per.pt_idx = p.pt_idx"""))
def center_surround_alpha(spark, folder):
    points = reliable(event_points(spark, folder))
    similar = M.point_similarity(N.Search(points, RADIUS, most=FRAMED), points, keep=["dist"])
    return rounded(M.center_surround(similar, points, 0.25), "alpha")


@query("saliency", with_ctes(POINTS, EDGES, VARIATION, select=f"""
SELECT line_id, pt_idx, {s6('1e0 - exp(-SUM(variation/(1e0 + 0.5e0*dist))/64e0)', 'saliency')}
FROM tbl GROUP BY line_id, pt_idx"""))
def saliency(spark, folder):
    return rounded(M.saliency(neighbour_table(reliable(event_points(spark, folder)))), "saliency")


@query("table_statistics", with_ctes(POINTS, EDGES, VARIATION, select=f"""
SELECT {s6('avg(variation)', 'mean_variation')}, {s6('max(variation)', 'max_variation')}, COUNT(*) AS entries
FROM tbl"""))
def table_statistics(spark, folder):
    stats = M.table_statistics(neighbour_table(reliable(event_points(spark, folder))))
    return rounded(stats, "mean_variation", "max_variation")


@query("alpha_calc", with_ctes(POINTS, EDGES, VARIATION, """stats AS (
  SELECT avg(variation) AS m, exp(-(max(variation)**2)/2e0) AS low FROM tbl)""", select=f"""
SELECT line_id, pt_idx, {s6('SUM((1e0 - m*0.5e0*(exp(-(variation**2)/2e0) - low)/(1e0 - low)) / dist**2) / SUM(1e0/dist**2)', 'alpha')}
FROM tbl, stats GROUP BY line_id, pt_idx"""))
def alpha_calc(spark, folder):
    return rounded(M.weighted_alpha(neighbour_table(reliable(event_points(spark, folder))), 0.5), "alpha")


@query("simple_opacity", with_ctes(POINTS, EDGES, VARIATION, select=f"""
SELECT line_id, pt_idx, {s6('variation / (SELECT max(variation) FROM tbl WHERE rank = 1) * 0.8e0', 'opacity')}
FROM tbl WHERE rank = 1"""))
def simple_opacity(spark, folder):
    table = neighbour_table(reliable(event_points(spark, folder)))
    return rounded(M.simple_opacity(table, 0.8), "opacity")


@query("neighbor_counts", with_ctes(POINTS, EDGES, select="""
SELECT p.line_id, p.pt_idx, COUNT(e.nbr_line) AS neighbours
FROM points p LEFT JOIN edges e ON e.line_id = p.line_id AND e.pt_idx = p.pt_idx
GROUP BY p.line_id, p.pt_idx"""))
def neighbor_counts(spark, folder):
    points = event_points(spark, folder)
    return M.neighbour_counts(edges(spark, folder), points)


@query("opacity_spread", with_ctes(POINTS, """opaque AS (
  SELECT *, y / 50e0 AS o FROM points),
tops AS (SELECT * FROM opaque QUALIFY row_number() OVER (ORDER BY o DESC, line_id, pt_idx) - 1
  < (SELECT COUNT(*) FROM points) * 0.14e0),
near AS (
  SELECT a.line_id, a.pt_idx, a.o, min(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)) AS d,
    arg_min(b.o, ((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2, b.line_id, b.pt_idx)) AS t
  FROM opaque a, tops b GROUP BY a.line_id, a.pt_idx, a.o)""", select=f"""
SELECT line_id, pt_idx, {s6('GREATEST((o + 1.8e0*t*exp(-d/0.72e0))/2e0, 0.2e0*exp(-d/0.72e0))', 'opacity')}
FROM near"""))
def opacity_spread(spark, folder):
    points = event_points(spark, folder).withColumn("opacity", F.col("y") / F.lit(50.0))
    return rounded(M.spread_opacity(points, start_radius=4.0), "opacity")


@query("critical_type_counts", with_ctes(CRITICAL, select="""
SELECT type, ['RepelNode','RepelNodeSaddle','AttractNode','AttractNodeSaddle','RepelFocus',
  'RepelFocusSaddle','AttractFocus','AttractFocusSaddle'][type+1] AS name, COUNT(*) AS n
FROM critical GROUP BY type"""))
def critical_type_counts(spark, folder):
    counts = supplier_critical_points(spark, folder).groupBy("type").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("name", scalars.critical_type_name(F.col("type")))


@query("critical_type_filter", with_ctes(CRITICAL, select="""
SELECT cp_id, x, y, z, type, scale FROM critical WHERE ((1 << type) & 38) <> 0"""))
def critical_type_filter(spark, folder):
    return supplier_critical_points(spark, folder).where(scalars.type_in_mask(F.col("type"), 38))


TWO_TERM = """two_edges AS (
  SELECT e.line_id, e.pt_idx, e.nbr_line, e.nbr_pt, i AS sample, a.x-b.x AS dx, a.y-b.y AS dy, a.z-b.z AS dz
  FROM edges e, range(0, 9) t(i)
  JOIN samples a ON a.line_id = e.line_id AND a.center = e.pt_idx AND a.sample = i
  JOIN samples b ON b.line_id = e.nbr_line AND b.center = e.nbr_pt AND b.sample = i),
scored AS (
  SELECT line_id, pt_idx, nbr_line, nbr_pt, list(sqrt(dx*dx+dy*dy+dz*dz) ORDER BY sample) AS d
  FROM two_edges GROUP BY line_id, pt_idx, nbr_line, nbr_pt)"""


def _two_term_sql() -> str:
    from skein.queries.geometry_queries import RESAMPLE

    samples = """samples AS (SELECT line_id, center, sample, arg_min(x+(x1-x)*t, pt_idx) AS x,
      arg_min(y+(y1-y)*t, pt_idx) AS y, arg_min(z+(z1-z)*t, pt_idx) AS z
      FROM hits GROUP BY line_id, center, sample)"""
    score = "d[5] + 0.2e0*list_avg(list_transform(d, lambda v: abs(v - d[5])))"
    return with_ctes(POINTS, EDGES, ARCS, RESAMPLE, samples, TWO_TERM, select=f"""
SELECT line_id, pt_idx, nbr_line, nbr_pt, {s6(score, 'score')}, {score} < 4e0 AS similar FROM scored""")


@query("two_term_similarity", _two_term_sql())
def two_term_similarity(spark, folder):
    points = reliable(event_points(spark, folder))
    found = M.two_term_similarity(
        N.Search(points, RADIUS, most=FRAMED), points, 40.0, 4, 0.2, separation=4.0
    )
    return rounded(found, "score")


@query("analysis_alpha")
def analysis_alpha(spark, folder):
    """The whole analysis on normalised lines: cuts, hashing, neighbours, opacity, colours."""
    settings = Settings(application=Application.ALPHA, radius=0.02)
    return rounded(analyze(event_points(spark, folder), settings), "x", "y", "z", "alpha")
