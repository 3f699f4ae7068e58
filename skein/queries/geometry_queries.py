"""Geometry of the event and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars
from skein.functions.vec import Vec3
from skein.operators import geometry as G
from skein.queries.base import (
    ARCS, CURVATURE, ORDER_POINTS, POINTS, STEPS, TANGENTS, query, r6, rounded, s6, with_ctes,
)
from skein.sources.tables import event_points, order_points

KEY = ["line_id", "pt_idx"]


@query("bbox_normalize", with_ctes(POINTS, select=f"""
SELECT line_id, pt_idx, {s6('(x-a)/side', 'x')}, {s6('(y-b)/side', 'y')}, {s6('(z-c)/side', 'z')}
FROM points, (SELECT min(x) AS a, min(y) AS b, min(z) AS c,
  0.1e0 * GREATEST(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS side FROM points)"""))
def bbox_normalize(spark, folder):
    return rounded(G.normalize(event_points(spark, folder), 0.1), "x", "y", "z")


@query("centered_denormalize", with_ctes(POINTS, select=f"""
SELECT line_id, pt_idx, {s6('(x-a)*0.5e0', 'x')}, {s6('(y-b)*0.5e0', 'y')}, {s6('(z-c)*0.5e0', 'z')}
FROM points, (SELECT (min(x)+max(x))/2 AS a, (min(y)+max(y))/2 AS b, (min(z)+max(z))/2 AS c
  FROM points)"""))
def centered_denormalize(spark, folder):
    return rounded(G.denormalize(event_points(spark, folder), 0.25), "x", "y", "z")


@query("bounding_box", with_ctes(ORDER_POINTS, select=f"""
SELECT {', '.join(s6(f'{f}({c})', f'{f}_{c}') for c in 'xyz' for f in ('min', 'max'))},
  {', '.join(s6(f'max({c})-min({c})', f'ext_{c}') for c in 'xyz')},
  {s6('sqrt((max(x)-min(x))**2 + (max(y)-min(y))**2 + (max(z)-min(z))**2)', 'diagonal')}
FROM points"""))
def bounding_box(spark, folder):
    box = G.bounding_box(order_points(spark, folder))
    return rounded(box, *box.columns)


@query("line_offsets", with_ctes(ORDER_POINTS, select="""
SELECT line_id, n, CAST(SUM(n) OVER (ORDER BY line_id) - n AS BIGINT) AS first_gid
FROM (SELECT line_id, COUNT(*) AS n FROM points GROUP BY line_id)"""))
def line_offsets(spark, folder):
    return G.line_offsets(order_points(spark, folder))


@query("global_index", with_ctes(POINTS, select="""
SELECT line_id, pt_idx, row_number() OVER (ORDER BY line_id, pt_idx) - 1 AS gid FROM points"""))
def global_index(spark, folder):
    return G.global_index(event_points(spark, folder)).select(*KEY, "gid")


@query("largest_line", with_ctes(ORDER_POINTS, select="""
SELECT max(n) AS max_size FROM (SELECT COUNT(*) AS n FROM points GROUP BY line_id)"""))
def largest_line(spark, folder):
    return G.largest_line(order_points(spark, folder))


@query("downsample", with_ctes(POINTS, select="""
SELECT line_id, CAST(pt_idx // 3 AS INTEGER) AS pt_idx, x, y, z FROM points WHERE pt_idx % 3 = 0"""))
def downsample(spark, folder):
    return G.downsample(event_points(spark, folder), 3)


@query("min_length_lines", with_ctes(POINTS, STEPS, select="""
SELECT line_id, pt_idx, x, y, z FROM points WHERE line_id IN (
  SELECT line_id FROM steps GROUP BY line_id HAVING SUM(step) >= 500)"""))
def min_length_lines(spark, folder):
    return G.long_lines(event_points(spark, folder), 500.0).select(*KEY, "x", "y", "z")


@query("tangent", with_ctes(POINTS, TANGENTS, select=f"""
SELECT line_id, pt_idx, {s6('tx')}, {s6('ty')}, {s6('tz')} FROM tangents"""))
def tangent(spark, folder):
    t = G.tangents(event_points(spark, folder))
    return rounded(t.select(*KEY, "tx", "ty", "tz"), "tx", "ty", "tz")


@query("tangent_orders", with_ctes(ORDER_POINTS, TANGENTS, select=f"""
SELECT line_id, pt_idx, {s6('tx')}, {s6('ty')}, {s6('tz')} FROM tangents"""))
def tangent_orders(spark, folder):
    t = G.tangents(order_points(spark, folder))
    return rounded(t.select(*KEY, "tx", "ty", "tz"), "tx", "ty", "tz")


@query("arc_length", with_ctes(ORDER_POINTS, STEPS, select=f"""
SELECT line_id, COUNT(*) AS n, {s6('SUM(step)', 'arc_length')} FROM steps GROUP BY line_id"""))
def arc_length(spark, folder):
    lines = G.line_lengths(order_points(spark, folder))
    return rounded(lines.select("line_id", "n", "arc_length"), "arc_length")


@query("cum_arc_length", with_ctes(POINTS, ARCS, select=f"""
SELECT line_id, pt_idx, {s6('arc')} FROM arcs"""))
def cum_arc_length(spark, folder):
    return rounded(G.arc_positions(event_points(spark, folder)).select(*KEY, "arc"), "arc")


@query("tortuosity", with_ctes(POINTS, STEPS, select=f"""
SELECT line_id, {s6('CASE WHEN COUNT(*) = 1 THEN 1e0 ELSE SUM(step) / NULLIF(sqrt((arg_max(x,pt_idx)-arg_min(x,pt_idx))**2 + (arg_max(y,pt_idx)-arg_min(y,pt_idx))**2 + (arg_max(z,pt_idx)-arg_min(z,pt_idx))**2), 0) END', 'tortuosity')}
FROM steps GROUP BY line_id"""))
def tortuosity(spark, folder):
    lines = G.line_lengths(event_points(spark, folder))
    return rounded(lines.select("line_id", "tortuosity"), "tortuosity")


@query("curvature", with_ctes(POINTS, CURVATURE, select=f"""
SELECT line_id, pt_idx, {s6('kappa')} FROM curved"""))
def curvature(spark, folder):
    return rounded(G.curvature(event_points(spark, folder)).select(*KEY, "kappa"), "kappa")


CROSS = """rr AS (
  SELECT line_id, pt_idx, x - lag(x) OVER w AS rx, y - lag(y) OVER w AS ry, z - lag(z) OVER w AS rz,
    lead(x) OVER w - x AS sx, lead(y) OVER w - y AS sy, lead(z) OVER w - z AS sz
  FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
vv AS (SELECT *, (sx-rx)*rx AS vx, (sy-ry)*ry AS vy, (sz-rz)*rz AS vz, rx*rx+ry*ry+rz*rz AS q FROM rr)"""


@query("curvature_cross", with_ctes(POINTS, CROSS, select=f"""
SELECT line_id, pt_idx, {s6('sqrt((ry*vz-rz*vy)**2 + (rz*vx-rx*vz)**2 + (rx*vy-ry*vx)**2) / NULLIF(q*sqrt(q), 0)', 'kappa')}
FROM vv"""))
def curvature_cross(spark, folder):
    return rounded(G.cross_curvature(event_points(spark, folder)).select(*KEY, "kappa"), "kappa")


def _smooth_sql(passes: int, w: int) -> list[str]:
    g = repr(G.SMOOTH_WEIGHT)
    ctes, prev = [], "points"
    for k in range(passes):
        cols = ", ".join(
            f"({c}*(1e0-{g}::DOUBLE) + {g}::DOUBLE*SUM({c}) OVER w)"
            f"/(1e0+{g}::DOUBLE*(COUNT(*) OVER w - 1)) AS {c}" for c in "xyz"
        )
        ctes.append(
            f"smooth{k} AS (SELECT line_id, pt_idx, {cols} FROM {prev} WINDOW w AS (PARTITION BY"
            f" line_id ORDER BY pt_idx ROWS BETWEEN {w} PRECEDING AND {w - 1} FOLLOWING))"
        )
        prev = f"smooth{k}"
    return ctes


@query("gaussian_smooth", with_ctes(POINTS, *_smooth_sql(G.SMOOTH_PASSES, 4), select=f"""
SELECT line_id, pt_idx, {s6('x')}, {s6('y')}, {s6('z')} FROM smooth{G.SMOOTH_PASSES - 1}"""))
def gaussian_smooth(spark, folder):
    out = G.smooth(event_points(spark, folder), 4)
    return rounded(out.select(*KEY, "x", "y", "z"), "x", "y", "z")


@query("dedup_vertices", with_ctes(POINTS, """near AS (
  SELECT *, sqrt((x-lag(x) OVER w)**2 + (y-lag(y) OVER w)**2 + (z-lag(z) OVER w)**2) AS d
  FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx))""", select="""
SELECT line_id, pt_idx, x, y, z FROM near WHERE d IS NULL OR d > 2.0e0"""))
def dedup_vertices(spark, folder):
    return G.drop_near_previous(event_points(spark, folder), 2.0).select(*KEY, "x", "y", "z")


@query("dedup_kept_vertices", "WITH RECURSIVE " + POINTS + """,
walk AS (
  SELECT line_id, pt_idx, x, y, z, true AS keep FROM points WHERE pt_idx = 0
  UNION ALL
  SELECT p.line_id, p.pt_idx, CASE WHEN far THEN p.x ELSE w.x END,
    CASE WHEN far THEN p.y ELSE w.y END, CASE WHEN far THEN p.z ELSE w.z END, far
  FROM walk w JOIN points p ON p.line_id = w.line_id AND p.pt_idx = w.pt_idx + 1,
    LATERAL (SELECT sqrt((p.x-w.x)**2 + (p.y-w.y)**2 + (p.z-w.z)**2) > 5e0 AS far))
SELECT line_id, pt_idx, x, y, z FROM walk WHERE keep""")
def dedup_kept_vertices(spark, folder):
    return G.drop_near_kept(event_points(spark, folder), 5.0)


@query("index_window", with_ctes(POINTS, """win AS (
  SELECT line_id, pt_idx, COUNT(*) OVER w AS n, AVG(x) OVER w AS mx, AVG(y) OVER w AS my
  FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))""",
  select=f"SELECT line_id, pt_idx, {s6('mx')}, {s6('my')} FROM win WHERE n = 11"))
def index_window(spark, folder):
    out = G.index_window(event_points(spark, folder), 5)

    def mean(c):
        return F.aggregate("path", F.lit(0.0), lambda s, p: s + p[c]) / F.size("path")

    return out.select(*KEY, r6(mean("x"), "mx"), r6(mean("y"), "my"))


RESAMPLE = """ends AS (SELECT line_id, max(arc) AS total FROM arcs GROUP BY line_id),
at0 AS (SELECT a.line_id, a.pt_idx AS center, a.arc AS arc0,
    CAST(floor((total - a.arc)/5e0) AS INTEGER) AS fwd, CAST(floor(a.arc/5e0) AS INTEGER) AS back
  FROM arcs a JOIN ends e ON a.line_id = e.line_id),
at1 AS (SELECT *, LEAST(fwd, GREATEST(4, 8 - back)) AS ahead FROM at0 WHERE fwd + back >= 8),
wanted AS (SELECT line_id, center, arc0, CAST(i AS INTEGER) AS sample, CAST(ahead - 8 + i AS INTEGER) AS "offset",
    GREATEST(arc0 + (ahead - 8 + i)*5e0, 0e0) AS s FROM at1, range(0, 9) t(i)),
pieces AS (SELECT line_id, pt_idx, arc, x, y, z, lead(arc) OVER w AS a1, lead(x) OVER w AS x1,
    lead(y) OVER w AS y1, lead(z) OVER w AS z1
  FROM arcs WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
hits AS (SELECT q.line_id, center, sample, "offset", p.pt_idx,
    LEAST(1e0, GREATEST(0e0, (s-arc)/(a1-arc))) AS t, x, y, z, x1, y1, z1
  FROM wanted q JOIN pieces p ON p.line_id = q.line_id AND a1 > arc AND s >= arc - 1e-12 AND s <= a1 + 1e-12)"""


@query("arc_resample", with_ctes(POINTS, ARCS, RESAMPLE, select=f"""
SELECT line_id, center, sample, "offset", {s6('arg_min(x+(x1-x)*t, pt_idx)', 'x')},
  {s6('arg_min(y+(y1-y)*t, pt_idx)', 'y')}, {s6('arg_min(z+(z1-z)*t, pt_idx)', 'z')}
FROM hits GROUP BY line_id, center, sample, "offset" """))
def arc_resample(spark, folder):
    points = event_points(spark, folder)
    out = G.resample_around(points, points.select(*KEY), 40.0, 4)
    return rounded(out, "x", "y", "z")


@query("arc_index_range", with_ctes(POINTS, ARCS, """centre AS (
  SELECT line_id, avg(x) AS qx, avg(y) AS qy, avg(z) AS qz FROM points GROUP BY line_id),
pieces AS (SELECT line_id, pt_idx, arc, x, y, z, lead(arc) OVER w AS a1, lead(x) OVER w - x AS dx,
    lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz
  FROM arcs WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
proj AS (SELECT p.*, qx, qy, qz, COALESCE(LEAST(1e0, GREATEST(0e0,
    ((qx-x)*dx+(qy-y)*dy+(qz-z)*dz)/NULLIF(dx*dx+dy*dy+dz*dz, 0))), 0e0) AS t
  FROM pieces p JOIN centre c ON p.line_id = c.line_id WHERE a1 IS NOT NULL),
foot AS (SELECT line_id, pt_idx AS i, arc + t*(a1-arc) AS at0 FROM proj
  QUALIFY row_number() OVER (PARTITION BY line_id
    ORDER BY (qx-x-dx*t)**2+(qy-y-dy*t)**2+(qz-z-dz*t)**2, pt_idx) = 1)""", select="""
SELECT a.line_id,
  COALESCE(max(CASE WHEN pt_idx < i AND pt_idx > 0 AND at0 - arc >= 60e0 THEN pt_idx END), 0) AS low,
  COALESCE(min(CASE WHEN pt_idx > i + 1 AND arc - at0 >= 60e0 THEN pt_idx END), CAST(COUNT(*) AS INTEGER)) AS high
FROM arcs a JOIN foot f ON a.line_id = f.line_id GROUP BY a.line_id"""))
def arc_index_range(spark, folder):
    points = event_points(spark, folder)
    centers = points.groupBy("line_id").agg(*[F.avg(c).alias(f"q{c}") for c in "xyz"])
    return G.index_range_near(points, centers, 60.0).select("line_id", "low", "high")


@query("vector_algebra", with_ctes(POINTS, STEPS, """pair AS (
  SELECT line_id, pt_idx, x, y, z, lead(x) OVER w AS a, lead(y) OVER w AS b, lead(z) OVER w AS c
  FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
m AS (SELECT *, x*a+y*b+z*c AS dt, sqrt(x*x+y*y+z*z) AS n1, sqrt(a*a+b*b+c*c) AS n2 FROM pair WHERE a IS NOT NULL)""",
  select=f"""SELECT line_id, pt_idx, {s6('dt', 'dot')}, {s6('sqrt((y*c-z*b)**2+(z*a-x*c)**2+(x*b-y*a)**2)', 'cross_len')},
  {s6('dt/n2', 'projection')}, {s6('acos(LEAST(1e0, GREATEST(-1e0, dt/(n1*n2))))', 'angle')},
  {s6('abs(x)+abs(y)+abs(z)', 'l1')}, {s6('GREATEST(x,a)+GREATEST(y,b)+GREATEST(z,c)', 'max_sum')},
  x < a AND y < b AND z < c AS less, {s6('exp(-z*z/2e0)/sqrt(2*pi())', 'pdf')}
FROM m"""))
def vector_algebra(spark, folder):
    from skein.skew import halo_windows

    p, q = Vec3.of(), Vec3.of("a", "b", "c")
    pairs = halo_windows(
        event_points(spark, folder), lambda w: p.lead(w).columns("a", "b", "c"), 0, 1
    ).where("a is not null")
    return pairs.select(
        *KEY,
        r6(p.dot(q), "dot"),
        r6(p.cross(q).length(), "cross_len"),
        r6(p.project(q), "projection"),
        r6(p.angle(q), "angle"),
        r6(p.l1(), "l1"),
        r6(sum(p.max(q).parts[1:], p.max(q).x), "max_sum"),
        p.all_less(q).alias("less"),
        r6(scalars.gaussian_pdf(F.col("z")), "pdf"),
    )
