"""Opacity optimisation of the event lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import opacity as O
from skein.queries.base import ARCS, BOX, POINTS, query, r6, rounded, s6, with_ctes
from skein.queries.geometry_queries import KEY
from skein.session import reliable
from skein.sources.tables import event_dims, event_points, read

TOTAL, WIDTH, HEIGHT = 1000, 16, 16

CONTROL = f"""lens AS (SELECT line_id, COUNT(*) AS n, SUM(step) AS len FROM steps GROUP BY line_id),
tot AS (SELECT SUM(len) AS all_len, greatest({TOTAL}, 4*COUNT(*)) AS total FROM lens),
mark AS (SELECT l.*, len <= all_len/total::DOUBLE AS short FROM lens l, tot),
rest AS (SELECT (SELECT total FROM tot) - 2*COUNT(*) FILTER (short) AS cps, SUM(len) FILTER (NOT short) AS len FROM mark),
share AS (SELECT m.*, m.len/r.len*r.cps AS s FROM mark m, rest r),
dealt AS (
  SELECT line_id, n, len, CAST(CASE WHEN short THEN 2 ELSE floor(s) + CASE WHEN
      row_number() OVER (PARTITION BY short ORDER BY s - floor(s) DESC, line_id DESC)
      <= (SELECT cps FROM rest) - (SELECT SUM(floor(s)) FROM share WHERE NOT short) THEN 1 ELSE 0 END END AS BIGINT) AS n_cp
  FROM share),
cp_lines AS (SELECT *, CAST(SUM(n_cp) OVER (ORDER BY line_id) - n_cp AS BIGINT) AS cp_offset FROM dealt)"""

WEIGHTS = """weights AS (
  SELECT a.line_id, a.pt_idx, a.x, a.y, a.z, cp_offset + CASE WHEN pt_idx = 0 THEN 0e0
    ELSE LEAST(arc/len*(n_cp-1), n_cp - 1 - 1e-4) END AS alpha_weight
  FROM arcs a JOIN cp_lines c ON c.line_id = a.line_id)"""

FRAGS = BOX + f""",
frags AS (
  SELECT *, CAST(floor(y/bb*{HEIGHT})*{WIDTH} + floor(x/bx*{WIDTH}) AS BIGINT) AS pixel, z AS depth, y/bb AS importance,
    LEAST(0.999e0, GREATEST(0.001e0, y/bb))**2 AS g2, LEAST(0.999e0, GREATEST(0.001e0, y/bb)) AS g
  FROM weights, box WHERE x >= 0 AND x/bx < 1 AND y >= 0 AND y/bb < 1)"""

ALPHA = """shaded AS (
  SELECT *, LEAST(1e0, GREATEST(0e0, 1e0/(1e0 + (1e0-g)**3e0*(500e0*gf + 100e0*(gall-gf-g2))))) AS alpha
  FROM (SELECT *, SUM(g2) OVER (PARTITION BY pixel) AS gall,
    COALESCE(SUM(g2) OVER (PARTITION BY pixel ORDER BY depth, line_id, pt_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS gf FROM frags))"""

GATHER = """gathered AS (
  SELECT CAST(floor(alpha_weight + 0.5e0) AS BIGINT) AS cp_id, min(alpha) AS alpha FROM shaded GROUP BY 1),
cps AS (
  SELECT cp_offset + i AS cp_id, line_id, i AS k FROM cp_lines, LATERAL (SELECT unnest(range(0, n_cp)) AS i)),
cp_alpha AS (SELECT c.cp_id, c.line_id, c.k, g.alpha FROM cps c LEFT JOIN gathered g ON g.cp_id = c.cp_id)"""


def _smooth(passes: int) -> list[str]:
    out, prev = [], "cp_alpha"
    for p in range(passes):
        out.append(f"""sm{p} AS (
  SELECT cp_id, line_id, k, CASE WHEN m IS NULL THEN 1e0 ELSE 1e0 - (v + (m-v)*0.1e0) END AS alpha FROM (
    SELECT *, 1e0-alpha AS v, COALESCE((lag(1e0-alpha) OVER w + lead(1e0-alpha) OVER w)/2e0,
      lag(1e0-alpha) OVER w, lead(1e0-alpha) OVER w) AS m
    FROM {prev} WINDOW w AS (PARTITION BY line_id ORDER BY k)))""")
        prev = f"sm{p}"
    return out


SMOOTH = _smooth(10)
BASE = [POINTS, ARCS, CONTROL, WEIGHTS, FRAGS, ALPHA, GATHER, *SMOOTH]

VERTEX = """vertex AS (
  SELECT w.line_id, w.pt_idx, COALESCE(a.alpha, 0e0) + (COALESCE(b.alpha, 0e0) - COALESCE(a.alpha, 0e0))*t*t*(3e0-2e0*t) AS alpha
  FROM (SELECT *, alpha_weight - floor(alpha_weight) AS t FROM weights) w
  LEFT JOIN sm9 a ON a.cp_id = floor(alpha_weight) LEFT JOIN sm9 b ON b.cp_id = floor(alpha_weight) + 1)"""


def _total(spark, folder):
    """Control points of all lines together: TOTAL, or enough for four on each line."""
    return max(TOTAL, 4 * read(spark, folder, "events").agg(F.count_distinct("user_id")).first()[0])


def _weights(points, total):
    lines = O.control_points(points, total)
    return lines, O.alpha_weights(points, lines)


def _drawn(spark, folder):
    """Control points, weighted points and their fragments; the points are fixed, as all steps read them."""
    lines, weighted = _weights(event_points(spark, folder), _total(spark, folder))
    lines, weighted = reliable(lines), reliable(weighted)
    cols, rows, _ = event_dims(spark, folder)
    x, y = F.col("x") / F.lit(float(cols)), F.col("y") / F.lit(float(rows))
    frags = O.fragments(
        weighted.withColumns({"depth": F.col("z"), "importance": y}), WIDTH, HEIGHT, x, y
    )
    return lines, weighted, O.depth_order(frags)


def _smoothed(lines, frags):
    least = O.gather_minimum(O.fragment_opacity(frags))
    cps = O.control_point_lines(lines).join(least, "cp_id", "left")
    return O.smooth_alpha(cps)


@query("control_points", with_ctes(POINTS, ARCS, CONTROL, select=f"""
SELECT line_id, n, {s6('len', 'arc_length')}, n_cp, cp_offset FROM cp_lines"""))
def control_points(spark, folder):
    lines = O.control_points(event_points(spark, folder), _total(spark, folder))
    return rounded(lines.select("line_id", "n", "arc_length", "n_cp", "cp_offset"), "arc_length")


@query("control_point_lines", with_ctes(POINTS, ARCS, CONTROL, select="""
SELECT cp_offset + i AS cp_id, line_id, CAST(i AS INTEGER) AS cp_in_line
FROM cp_lines, LATERAL (SELECT unnest(range(0, n_cp)) AS i)"""))
def control_point_lines(spark, folder):
    return O.control_point_lines(O.control_points(event_points(spark, folder), _total(spark, folder)))


@query("alpha_weights", with_ctes(POINTS, ARCS, CONTROL, WEIGHTS, select=f"""
SELECT line_id, pt_idx, {s6('alpha_weight')} FROM weights"""))
def alpha_weights(spark, folder):
    _, weighted = _weights(event_points(spark, folder), _total(spark, folder))
    return rounded(weighted.select(*KEY, "alpha_weight"), "alpha_weight")


@query("fragments", with_ctes(POINTS, ARCS, CONTROL, WEIGHTS, FRAGS, select="""
SELECT line_id, pt_idx, pixel,
  CAST(row_number() OVER (PARTITION BY pixel ORDER BY depth, line_id, pt_idx) - 1 AS INTEGER) AS frag FROM frags"""))
def fragments(spark, folder):
    *_, frags = _drawn(spark, folder)
    return frags.select(*KEY, "pixel", "frag")


@query("pixel_importance", with_ctes(POINTS, ARCS, CONTROL, WEIGHTS, FRAGS, select=f"""
SELECT pixel, {s6('SUM(g2)', 'gall')}, COUNT(*) AS n FROM frags GROUP BY pixel"""))
def pixel_importance(spark, folder):
    *_, frags = _drawn(spark, folder)
    return rounded(O.pixel_importance(frags), "gall")


@query("pixel_alpha", with_ctes(POINTS, ARCS, CONTROL, WEIGHTS, FRAGS, ALPHA, select=f"""
SELECT line_id, pt_idx, pixel, {s6('alpha')} FROM shaded"""))
def pixel_alpha(spark, folder):
    *_, frags = _drawn(spark, folder)
    out = O.fragment_opacity(frags)
    return rounded(out.select(*KEY, "pixel", "alpha"), "alpha")


@query("min_gather", with_ctes(POINTS, ARCS, CONTROL, WEIGHTS, FRAGS, ALPHA, GATHER, select=f"""
SELECT cp_id, {s6('alpha')} FROM gathered"""))
def min_gather(spark, folder):
    *_, frags = _drawn(spark, folder)
    return rounded(O.gather_minimum(O.fragment_opacity(frags)), "alpha")


@query("laplace_smooth", with_ctes(*BASE, select=f"""
SELECT cp_id, line_id, {s6('alpha')} FROM sm9"""))
def laplace_smooth(spark, folder):
    lines, weighted, frags = _drawn(spark, folder)
    out = _smoothed(lines, frags)
    return rounded(out.select("cp_id", "line_id", "alpha"), "alpha")


@query("vertex_alpha", with_ctes(*BASE, VERTEX, select=f"""
SELECT line_id, pt_idx, {s6('alpha')} FROM vertex"""))
def vertex_alpha(spark, folder):
    lines, weighted, frags = _drawn(spark, folder)
    out = O.vertex_alpha(weighted, _smoothed(lines, frags))
    return rounded(out.select(*KEY, "alpha"), "alpha")


@query("fade_frames", with_ctes(POINTS, select=f"""
SELECT line_id, pt_idx, {s6('y/50e0 + (1e0 - y/50e0)*0.1e0', 'one')},
  {s6('y/50e0 + (1e0 - y/50e0)*0.1e0 + (1e0 - (y/50e0 + (1e0 - y/50e0)*0.1e0))*0.1e0', 'two')} FROM points"""))
def fade_frames(spark, folder):
    y, target = F.col("y") / F.lit(50.0), F.lit(1.0)
    return event_points(spark, folder).select(
        *KEY, r6(O.fade(y, target), "one"), r6(O.fade_frames(y, target, 2), "two")
    )


@query("composite", with_ctes(POINTS, ARCS, CONTROL, WEIGHTS, FRAGS, """front AS (
  SELECT pixel, 0.2e0 + 0.6e0*importance AS a, importance AS r, z/5e0 AS g_, 1e0 - importance AS b,
    COALESCE(exp(SUM(ln(0.2e0 + 0.6e0*importance)) OVER (PARTITION BY pixel ORDER BY depth, line_id, pt_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1e0) AS t FROM frags),
px AS (SELECT pixel, SUM(r*(1e0-a)*t) AS r, SUM(g_*(1e0-a)*t) AS g, SUM(b*(1e0-a)*t) AS b,
  1e0 - exp(SUM(ln(a))) AS alpha FROM front GROUP BY pixel)""", select=f"""
SELECT pixel, {s6('r/alpha', 'r')}, {s6('g/alpha', 'g')}, {s6('b/alpha', 'b')}, {s6('alpha')} FROM px"""))
def composite(spark, folder):
    *_, frags = _drawn(spark, folder)
    i = F.col("importance")
    colored = frags.withColumns(
        {"a": F.lit(0.2) + F.lit(0.6) * i, "r": i, "g": F.col("z") / F.lit(5.0), "b": F.lit(1.0) - i}
    )
    return rounded(O.composite(colored), "r", "g", "b", "alpha")
