"""Registry of queries and shared SQL fragments for their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# Added before rounding on both sides, so that exact decimal halves do not sit on the border.
NUDGE = 3.7e-8


def r6(c: Column | str, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c + F.lit(NUDGE), 6) + F.lit(0.0)).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n, n) for n in names})


def s6(expr: str, name: str | None = None) -> str:
    """SQL twin of ``r6``."""
    return f"ROUND({expr} + {NUDGE!r}::DOUBLE, 6) + 0e0 AS {name or expr}"


POINTS = """points AS (
  SELECT user_id AS line_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pt_idx,
    date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts)::DOUBLE / 86400000000e0 AS x,
    value / 10e0 AS y,
    CASE event_type WHEN 'click' THEN 1e0 WHEN 'error' THEN 2e0 WHEN 'purchase' THEN 3e0
      WHEN 'signup' THEN 4e0 WHEN 'view' THEN 5e0 ELSE 6e0 END AS z
  FROM events)"""

# Unit cells that hold all event points.
BOX = """box AS (SELECT floor(max(x)) + 1e0 AS bx, floor(max(y)) + 1e0 AS bb, max(z) AS bz FROM points)"""

ORDER_POINTS = """points AS (
  SELECT l_orderkey AS line_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1
      AS INTEGER) AS pt_idx,
    l_quantity / 10e0 AS x, l_extendedprice / 10000e0 AS y, l_discount AS z
  FROM lineitem)"""

STEPS = """steps AS (
  SELECT *, COALESCE(sqrt((x-lag(x) OVER w)**2 + (y-lag(y) OVER w)**2 + (z-lag(z) OVER w)**2), 0e0)
    AS step
  FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx))"""

ARCS = (
    STEPS
    + """,
arcs AS (
  SELECT *, SUM(step) OVER (PARTITION BY line_id ORDER BY pt_idx ROWS UNBOUNDED PRECEDING) AS arc
  FROM steps)"""
)

TANGENTS = """raw_tangents AS (
  SELECT *,
    COALESCE(lead(x) OVER w, x) - COALESCE(lag(x) OVER w, x) AS ux,
    COALESCE(lead(y) OVER w, y) - COALESCE(lag(y) OVER w, y) AS uy,
    COALESCE(lead(z) OVER w, z) - COALESCE(lag(z) OVER w, z) AS uz
  FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
tangents AS (
  SELECT *, CASE WHEN n > 0 THEN ux/n ELSE 0e0 END AS tx, CASE WHEN n > 0 THEN uy/n ELSE 0e0 END AS ty,
    CASE WHEN n > 0 THEN uz/n ELSE 0e0 END AS tz
  FROM (SELECT *, sqrt(ux*ux+uy*uy+uz*uz) AS n FROM raw_tangents))"""

CURVATURE = """five AS (
  SELECT line_id, pt_idx, x, y, z,
    [lag(x,1) OVER w - lag(x,2) OVER w, lag(y,1) OVER w - lag(y,2) OVER w, lag(z,1) OVER w - lag(z,2) OVER w] AS d0,
    [x - lag(x,1) OVER w, y - lag(y,1) OVER w, z - lag(z,1) OVER w] AS d1,
    [lead(x,1) OVER w - x, lead(y,1) OVER w - y, lead(z,1) OVER w - z] AS d2,
    [lead(x,2) OVER w - lead(x,1) OVER w, lead(y,2) OVER w - lead(y,1) OVER w, lead(z,2) OVER w - lead(z,1) OVER w] AS d3,
    lag(x,2) OVER w IS NOT NULL AND lead(x,2) OVER w IS NOT NULL AS inner_pt
  FROM points WINDOW w AS (PARTITION BY line_id ORDER BY pt_idx)),
lens AS (
  SELECT *, sqrt(d0[1]**2+d0[2]**2+d0[3]**2) AS n0, sqrt(d1[1]**2+d1[2]**2+d1[3]**2) AS n1,
    sqrt(d2[1]**2+d2[2]**2+d2[3]**2) AS n2, sqrt(d3[1]**2+d3[2]**2+d3[3]**2) AS n3
  FROM five),
inner_kappa AS (
  SELECT line_id, pt_idx, x, y, z, CASE WHEN inner_pt THEN sqrt(
    (((d2[1]+d3[1])/NULLIF(n2+n3,0) - (d0[1]+d1[1])/NULLIF(n0+n1,0))/NULLIF(n1+n2,0))**2 +
    (((d2[2]+d3[2])/NULLIF(n2+n3,0) - (d0[2]+d1[2])/NULLIF(n0+n1,0))/NULLIF(n1+n2,0))**2 +
    (((d2[3]+d3[3])/NULLIF(n2+n3,0) - (d0[3]+d1[3])/NULLIF(n0+n1,0))/NULLIF(n1+n2,0))**2) END AS k
  FROM lens),
curved AS (
  SELECT a.line_id, a.pt_idx, a.x, a.y, a.z, b.k AS kappa
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY line_id) AS n FROM inner_kappa) a
  LEFT JOIN inner_kappa b ON b.line_id = a.line_id
    AND b.pt_idx = GREATEST(2, LEAST(a.pt_idx, a.n - 3)))"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
