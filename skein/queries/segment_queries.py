"""Segmentation of the event lines."""

from __future__ import annotations

from skein.operators import segmentation as S
from skein.queries.base import ARCS, CURVATURE, POINTS, query, rounded, s6, with_ctes
from skein.queries.geometry_queries import CROSS
from skein.sources.tables import event_points

TAC, LEN = 1.5707963267948966, 60.0


def cut_sql(limit_t: float, limit_l: float, source: str) -> str:
    """Recursive walk over ``source`` (line_id, pt_idx, tac, len) that yields segments."""
    return f"""walk AS (
  SELECT line_id, 0 AS pt_idx, 0 AS beg, 0e0 AS t, 0e0 AS l, -1 AS done FROM {source} WHERE pt_idx = 0
  UNION ALL
  SELECT s.line_id, s.pt_idx,
    CASE WHEN cut THEN s.pt_idx ELSE w.beg END,
    CASE WHEN cut THEN 0e0 WHEN s.len IS NULL THEN w.t ELSE w.t + COALESCE(s.tac, 0e0) END,
    CASE WHEN cut THEN 0e0 WHEN s.len IS NULL THEN w.l ELSE w.l + s.len END,
    CASE WHEN cut THEN w.beg ELSE -1 END
  FROM walk w JOIN {source} s ON s.line_id = w.line_id AND s.pt_idx = w.pt_idx + 1,
    LATERAL (SELECT s.len IS NOT NULL AND (w.t + COALESCE(s.tac, 0e0) > {limit_t}::DOUBLE
      OR w.l + s.len > {limit_l}::DOUBLE) AS cut)),
cuts AS (
  SELECT line_id, done AS beg, pt_idx + 1 AS end_ FROM walk WHERE done >= 0
  UNION ALL
  SELECT line_id, arg_max(beg, pt_idx), max(pt_idx) + 1 FROM walk GROUP BY line_id),
sizes AS (SELECT line_id, COUNT(*) AS n FROM points GROUP BY line_id)"""


CURVE_STEPS = """stepped AS (
  SELECT line_id, pt_idx, len, kappa * len AS tac FROM (
    SELECT *, sqrt((lead(x) OVER w - lag(x) OVER w)**2 + (lead(y) OVER w - lag(y) OVER w)**2
      + (lead(z) OVER w - lag(z) OVER w)**2)/2e0 AS len
    FROM curved WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)))"""

SEGMENTS = (
    CURVATURE + ",\n" + CURVE_STEPS + ",\n" + cut_sql(TAC, LEN, "stepped") + """,
segments AS (
  SELECT c.line_id, CASE WHEN n < 5 THEN 0 ELSE beg END AS beg,
    CAST(CASE WHEN n < 5 THEN n ELSE end_ END AS INTEGER) AS end_
  FROM cuts c JOIN sizes s ON c.line_id = s.line_id
  GROUP BY ALL)"""
)

ATTRS = """member AS (
  SELECT s.line_id, s.beg, s.end_, p.pt_idx, x, y, z
  FROM segments s JOIN points p ON p.line_id = s.line_id AND p.pt_idx >= s.beg AND p.pt_idx < s.end_),
attr0 AS (
  SELECT line_id, beg, end_, CAST(COUNT(*) AS INTEGER) AS cnt, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz,
    (arg_max(x, pt_idx) - arg_min(x, pt_idx)) AS vx, (arg_max(y, pt_idx) - arg_min(y, pt_idx)) AS vy,
    (arg_max(z, pt_idx) - arg_min(z, pt_idx)) AS vz
  FROM member GROUP BY line_id, beg, end_),
attrs AS (
  SELECT *, cx-vx/2 AS sx, cy-vy/2 AS sy, cz-vz/2 AS sz, cx+vx/2 AS ex, cy+vy/2 AS ey, cz+vz/2 AS ez,
    CASE WHEN n > 0 THEN vx/n ELSE 0e0 END AS dx, CASE WHEN n > 0 THEN vy/n ELSE 0e0 END AS dy,
    CASE WHEN n > 0 THEN vz/n ELSE 0e0 END AS dz
  FROM (SELECT *, sqrt(vx*vx+vy*vy+vz*vz) AS n FROM attr0))"""


def recursive(*ctes: str, select: str) -> str:
    return with_ctes(*ctes, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


def curvature_segments(points):
    return S.cut_by_curvature(points, TAC, LEN)


@query("segments_curvature", recursive(POINTS, SEGMENTS, select="SELECT * FROM segments"))
def segments_curvature(spark, folder):
    return curvature_segments(event_points(spark, folder))


CROSS_STEPS = """stepped AS (
  SELECT line_id, pt_idx,
    sqrt((ry*vz-rz*vy)**2 + (rz*vx-rx*vz)**2 + (rx*vy-ry*vx)**2) / NULLIF(q*sqrt(q), 0) *
    sqrt((rx+sx)**2 + (ry+sy)**2 + (rz+sz)**2) AS tac,
    sqrt((rx+sx)**2 + (ry+sy)**2 + (rz+sz)**2) AS len
  FROM vv)"""


@query("segments_cross_curvature", recursive(
    POINTS, CROSS, CROSS_STEPS, cut_sql(40.0, 150.0, "stepped"), select="SELECT * FROM cuts"))
def segments_cross_curvature(spark, folder):
    return S.cut_by_cross_curvature(event_points(spark, folder), 40.0, 150.0)


@query("segments_ratio", recursive(POINTS, """nxt AS (
  SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz,
    sqrt((lead(x) OVER w - x)**2 + (lead(y) OVER w - y)**2 + (lead(z) OVER w - z)**2) AS len,
    pt_idx > 0 AND lead(x) OVER w IS NOT NULL AS inn
  FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
walk AS (
  SELECT line_id, 0 AS pt_idx, 0 AS beg, 0e0 AS l, x AS bx, y AS by_, z AS bz, -1 AS done FROM nxt WHERE pt_idx = 0
  UNION ALL
  SELECT s.line_id, s.pt_idx, CASE WHEN cut THEN s.pt_idx ELSE w.beg END,
    CASE WHEN cut THEN 0e0 WHEN s.inn THEN w.l + s.len ELSE w.l END,
    CASE WHEN cut THEN s.x ELSE bx END, CASE WHEN cut THEN s.y ELSE by_ END,
    CASE WHEN cut THEN s.z ELSE bz END, CASE WHEN cut THEN w.beg ELSE -1 END
  FROM walk w JOIN nxt s ON s.line_id = w.line_id AND s.pt_idx = w.pt_idx + 1,
    LATERAL (SELECT s.inn AND (w.l + s.len > 2e0 * sqrt((nx-bx)**2 + (ny-by_)**2 + (nz-bz)**2)
      OR w.l + s.len > 80e0) AS cut))""", select="""
SELECT line_id, done AS beg, pt_idx + 1 AS end_ FROM walk WHERE done >= 0
UNION ALL SELECT line_id, arg_max(beg, pt_idx), max(pt_idx) + 1 FROM walk GROUP BY line_id"""))
def segments_ratio(spark, folder):
    return S.cut_by_ratio(event_points(spark, folder), 2.0, 80.0)


@query("segments_tortuosity", recursive(POINTS, """flagged AS (
  SELECT *, lead(x) OVER w IS NULL AS tail FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
walk AS (
  SELECT line_id, 0 AS pt_idx, 0 AS beg, 0e0 AS arc, 0e0 AS ratio, x AS sx, y AS sy, z AS sz,
    x AS px, y AS py, z AS pz, -1 AS done FROM flagged WHERE pt_idx = 0
  UNION ALL
  SELECT s.line_id, s.pt_idx, CASE WHEN cut THEN s.pt_idx ELSE w.beg END,
    CASE WHEN cut THEN 0e0 ELSE a END,
    CASE WHEN cut OR s.pt_idx - w.beg < 2 OR (w.ratio >= 1.1e0 AND s.tail) THEN 0e0
      ELSE COALESCE(a / NULLIF(sqrt((s.x-w.sx)**2 + (s.y-w.sy)**2 + (s.z-w.sz)**2), 0), 0e0) END,
    CASE WHEN cut THEN s.x ELSE w.sx END, CASE WHEN cut THEN s.y ELSE w.sy END,
    CASE WHEN cut THEN s.z ELSE w.sz END, s.x, s.y, s.z, CASE WHEN cut THEN w.beg ELSE -1 END
  FROM walk w JOIN flagged s ON s.line_id = w.line_id AND s.pt_idx = w.pt_idx + 1,
    LATERAL (SELECT w.ratio >= 1.1e0 AND NOT s.tail AS cut,
      w.arc + sqrt((s.x-w.px)**2 + (s.y-w.py)**2 + (s.z-w.pz)**2) AS a))""", select="""
SELECT line_id, done AS beg, pt_idx AS end_ FROM walk WHERE done >= 0
UNION ALL SELECT line_id, arg_max(beg, pt_idx), max(pt_idx) + 1 FROM walk GROUP BY line_id
HAVING max(pt_idx) - arg_max(beg, pt_idx) >= 2"""))
def segments_tortuosity(spark, folder):
    return S.cut_by_tortuosity(event_points(spark, folder))


EVEN = """per AS (
  SELECT line_id, COUNT(*) AS n, GREATEST(1, CAST(floor(COUNT(*) / (SUM(step)/60e0)) AS BIGINT)) AS k
  FROM arcs GROUP BY line_id),
segments AS (
  SELECT line_id, CAST(i*k AS INTEGER) AS beg, CAST(LEAST(i*k + k + 1, n) AS INTEGER) AS end_
  FROM per, LATERAL (SELECT unnest(range(0, (n - 1) // k + 1)) AS i)
  WHERE LEAST(i*k + k + 1, n) - i*k > 1)"""


@query("segments_even", with_ctes(POINTS, ARCS, EVEN, select="SELECT * FROM segments"))
def segments_even(spark, folder):
    return S.cut_evenly(event_points(spark, folder), 60.0)


def _optimal_sql(penalty: str, close: int) -> str:
    return f"""sums AS (
  SELECT line_id, pt_idx, SUM(x) OVER w AS sx, SUM(y) OVER w AS sy, SUM(z) OVER w AS sz,
    SUM(x*x + y*y + z*z) OVER w AS q, {penalty} AS pen
  FROM bends WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
arrays AS (
  SELECT line_id, list(sx ORDER BY pt_idx) AS sx, list(sy ORDER BY pt_idx) AS sy,
    list(sz ORDER BY pt_idx) AS sz, list(q ORDER BY pt_idx) AS q, list(pen ORDER BY pt_idx) AS pen
  FROM sums GROUP BY line_id),
dp AS (
  SELECT line_id, 0 AS j, [0e0] AS f, [-1] AS prev FROM arrays
  UNION ALL
  SELECT d.line_id, d.j + 1, list_append(f, list_min(c)), list_append(prev, list_position(c, list_min(c)) - 1)
  FROM dp d JOIN arrays a ON a.line_id = d.line_id AND d.j + 1 < len(a.q),
    LATERAL (SELECT [GREATEST(0e0, (q[d.j+2]-q[k+1])/(d.j+1-k) - ((sx[d.j+2]-sx[k+1])/(d.j+1-k))**2
      - ((sy[d.j+2]-sy[k+1])/(d.j+1-k))**2 - ((sz[d.j+2]-sz[k+1])/(d.j+1-k))**2) + pen[k+1] + f[k+1]
      for k in range(0, d.j + 1)] AS c)),
best AS (SELECT line_id, arg_max(prev, j) AS prev, max(j) AS n FROM dp GROUP BY line_id),
back AS (
  SELECT line_id, n AS at FROM best
  UNION ALL
  SELECT b.line_id, prev[b.at + 1] FROM back b JOIN best t ON t.line_id = b.line_id WHERE prev[b.at + 1] >= 0)
SELECT b.line_id, CAST(prev[b.at + 1] AS INTEGER) AS beg, CAST(b.at + {close} AS INTEGER) AS end_
FROM back b JOIN best t ON t.line_id = b.line_id WHERE prev[b.at + 1] >= 0"""


@query("segments_global", recursive(POINTS, "bends AS (SELECT * FROM points)", select="").rstrip() + ",\n"
       + _optimal_sql("5e0", 0))
def segments_global(spark, folder):
    return S.cut_globally(event_points(spark, folder), 5.0)


BENDS = """raw AS (
  SELECT *, x-lag(x) OVER w AS rx, y-lag(y) OVER w AS ry, z-lag(z) OVER w AS rz,
    (x-2*lag(x) OVER w+lag(x,2) OVER w)**2 + (y-2*lag(y) OVER w+lag(y,2) OVER w)**2
      + (z-2*lag(z) OVER w+lag(z,2) OVER w)**2 AS rr
  FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
bent AS (SELECT *, rr / (rx*rx+ry*ry+rz*rz+1e0)**1.5e0 AS c FROM raw),
bends AS (
  SELECT *, CASE pt_idx WHEN 0 THEN lead(c,2) OVER w WHEN 1 THEN lead(c,1) OVER w ELSE c END AS bend
  FROM bent WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx))"""


@query("segments_global_curvature", recursive(POINTS, BENDS, select="").rstrip() + ",\n"
       + _optimal_sql("1e0 / COALESCE(NULLIF(bend, 0), 1e-6)", 1))
def segments_global_curvature(spark, folder):
    return S.cut_globally_by_curvature(event_points(spark, folder), 1.0)


NAMES = [a + c for a in "csed" for c in "xyz"]


@query("segment_attributes", recursive(POINTS, SEGMENTS, ATTRS, select=f"""
SELECT line_id, beg, end_, cnt, {', '.join(s6(n) for n in NAMES)} FROM attrs"""))
def segment_attributes(spark, folder):
    points = event_points(spark, folder)
    return rounded(S.attributes(points, curvature_segments(points)), *NAMES)


@query("segment_deviation", with_ctes(POINTS, ARCS, EVEN, ATTRS, select=f"""
SELECT m.line_id, m.beg, m.end_, {s6('SUM(sqrt((x-cx)**2 + (y-cy)**2 + (z-cz)**2))', 'deviation')}
FROM member m JOIN attrs a ON a.line_id = m.line_id AND a.beg = m.beg AND a.end_ = m.end_
GROUP BY m.line_id, m.beg, m.end_"""))
def segment_deviation(spark, folder):
    points = event_points(spark, folder)
    return rounded(S.deviation(points, S.cut_evenly(points, 60.0)), "deviation")


@query("point_segments", recursive(POINTS, SEGMENTS, ATTRS, select="""
SELECT line_id, pt_idx, max(beg) AS beg, arg_max(end_, beg) AS end_ FROM member GROUP BY line_id, pt_idx"""))
def point_segments(spark, folder):
    return S.owner_segments(curvature_segments(event_points(spark, folder)))


@query("trimmed_segments", recursive(POINTS, SEGMENTS, ATTRS, select="""
SELECT m.line_id, m.beg, max(m.pt_idx) + 1 AS end_
FROM member m JOIN points b ON b.line_id = m.line_id AND b.pt_idx = m.beg
WHERE sqrt((m.x-b.x)**2 + (m.y-b.y)**2 + (m.z-b.z)**2) >= 1e-14 GROUP BY m.line_id, m.beg"""))
def trimmed_segments(spark, folder):
    points = event_points(spark, folder)
    return S.trim(points, curvature_segments(points))
