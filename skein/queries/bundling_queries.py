"""Contraction of the event lines."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from skein.operators import bundling as B
from skein.operators import geometry as G
from skein.operators import search as N
from skein.queries.base import POINTS, TANGENTS, query, rounded, s6, with_ctes
from skein.queries.geometry_queries import KEY
from skein.queries.search_queries import EDGES, MUTUAL, RADIUS
from skein.session import reliable
from skein.sources.tables import event_points

PULLS = """pulls AS (
  SELECT m.line_id, m.pt_idx, b.x-a.x AS vx, b.y-a.y AS vy, b.z-a.z AS vz,
    a.tx+b.tx AS sx, a.ty+b.ty AS sy, a.tz+b.tz AS sz
  FROM mutual m JOIN tangents a ON a.line_id = m.line_id AND a.pt_idx = m.pt_idx
    JOIN tangents b ON b.line_id = m.nbr_line AND b.pt_idx = m.nbr_pt),
across AS (
  SELECT *, CASE WHEN n > 0 THEN sx/n ELSE 0e0 END AS lx, CASE WHEN n > 0 THEN sy/n ELSE 0e0 END AS ly,
    CASE WHEN n > 0 THEN sz/n ELSE 0e0 END AS lz
  FROM (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS n FROM pulls)),
moved AS (
  SELECT t.line_id, t.pt_idx, t.x, t.y, t.z, t.tx, t.ty, t.tz, COALESCE(dx, 0e0) AS dx,
    COALESCE(dy, 0e0) AS dy, COALESCE(dz, 0e0) AS dz
  FROM tangents t LEFT JOIN (
    SELECT line_id, pt_idx, 0.5e0*avg(vx - lx*(vx*lx+vy*ly+vz*lz)) AS dx,
      0.5e0*avg(vy - ly*(vx*lx+vy*ly+vz*lz)) AS dy, 0.5e0*avg(vz - lz*(vx*lx+vy*ly+vz*lz)) AS dz
    FROM across GROUP BY line_id, pt_idx) d ON d.line_id = t.line_id AND d.pt_idx = t.pt_idx)"""

SHIFTED = """around AS (
  SELECT a.line_id, a.pt_idx, SUM(exp(-((b.pt_idx-a.pt_idx)**2)/64e0)) AS w,
    SUM(exp(-((b.pt_idx-a.pt_idx)**2)/64e0)*(b.dx - a.tx*(b.dx*a.tx+b.dy*a.ty+b.dz*a.tz))) AS sx,
    SUM(exp(-((b.pt_idx-a.pt_idx)**2)/64e0)*(b.dy - a.ty*(b.dx*a.tx+b.dy*a.ty+b.dz*a.tz))) AS sy,
    SUM(exp(-((b.pt_idx-a.pt_idx)**2)/64e0)*(b.dz - a.tz*(b.dx*a.tx+b.dy*a.ty+b.dz*a.tz))) AS sz
  FROM moved a JOIN moved b ON b.line_id = a.line_id AND b.pt_idx BETWEEN a.pt_idx - 8 AND a.pt_idx + 7
    AND b.pt_idx <> a.pt_idx
  GROUP BY a.line_id, a.pt_idx),
shifted AS (
  SELECT m.line_id, m.pt_idx, m.x + (1.1e0*dx + COALESCE(sx, 0e0))/(1.1e0+COALESCE(w, 0e0)) AS x,
    m.y + (1.1e0*dy + COALESCE(sy, 0e0))/(1.1e0+COALESCE(w, 0e0)) AS y,
    m.z + (1.1e0*dz + COALESCE(sz, 0e0))/(1.1e0+COALESCE(w, 0e0)) AS z
  FROM moved m LEFT JOIN around a ON a.line_id = m.line_id AND a.pt_idx = m.pt_idx)"""

BASE = [POINTS, TANGENTS, EDGES, MUTUAL, PULLS]


def _mutual(points):
    return N.mutual_neighbour_edges(points, RADIUS)


def _pulled(points):
    """Mutual edges that bring place and tangent of both vertices along; ``points`` has tangents."""
    return N.mutual_neighbour_edges(points, RADIUS, B.TAKEN, B.TAKEN)


def _carried(points, state, size):
    """Mutual edges of ``points`` that bring place and tangent of both vertices in ``state`` along."""
    moved = state.select(*KEY, *[F.col(c).alias(f"s{c}") for c in B.TAKEN])
    taken = [f"s{c}" for c in B.TAKEN]
    edges = N.mutual_neighbour_edges(points.join(moved, KEY), RADIUS, taken, taken, size=size)
    return edges.select(
        *KEY, "nbr_line", "nbr_pt", *[F.col(f"s{c}").alias(c) for c in B.TAKEN], *[F.col(f"n_s{c}").alias(f"n_{c}") for c in B.TAKEN])


@query("contraction_displacement", with_ctes(*BASE, select=f"""
SELECT line_id, pt_idx, {s6('dx', 'ddx')}, {s6('dy', 'ddy')}, {s6('dz', 'ddz')} FROM moved"""))
def contraction_displacement(spark, folder):
    points = event_points(spark, folder)
    points = G.tangents(points)
    out = B.displacement(points, _pulled(points))
    return rounded(out.select(*KEY, "ddx", "ddy", "ddz"), "ddx", "ddy", "ddz")


@query("contraction_regularize", with_ctes(*BASE, SHIFTED, select=f"""
SELECT line_id, pt_idx, {s6('x')}, {s6('y')}, {s6('z')} FROM shifted"""))
def contraction_regularize(spark, folder):
    points = event_points(spark, folder)
    points = G.tangents(points)
    moved = B.displacement(points, _pulled(points))
    return rounded(B.regularize(moved), "x", "y", "z")


_G = repr(math.exp(-1.0 / 16.0) / (16.0 * math.sqrt(math.pi)))


@query("contraction_step", with_ctes(*BASE, SHIFTED, select=f"""
SELECT s.line_id, s.pt_idx, {', '.join(s6(f'CASE WHEN b.line_id IS NULL THEN s.{c} ELSE (s.{c} + b.{c}*{_G}::DOUBLE)/(1e0+{_G}::DOUBLE) END', c) for c in 'xyz')}
FROM shifted s LEFT JOIN points b ON b.line_id = s.line_id AND b.pt_idx = s.pt_idx - 1"""))
def contraction_step(spark, folder):
    points = event_points(spark, folder)
    return rounded(B.contract_once(points, _pulled(G.tangents(points)), first=True), "x", "y", "z")


def _named(cte: str, k: int) -> str:
    """The CTE for iteration ``k``: its own names, its input the positions before it."""
    for name in ("raw_tangents", "tangents", "pulls", "across", "moved", "around", "shifted"):
        cte = re.sub(rf"\b{name}\b", f"{name}_{k}", cte)
    return re.sub(r"\bpoints\b", f"points_{k}", cte)


def _iterations(n: int) -> list[str]:
    out = [POINTS, EDGES, MUTUAL, "points_0 AS (SELECT * FROM points)"]
    for k in range(n):
        out += [_named(c, k) for c in (TANGENTS, PULLS, SHIFTED)]
        blend = ", ".join(
            f"CASE WHEN b.line_id IS NULL THEN s.{c} ELSE (s.{c} + b.{c}*{_G}::DOUBLE)/(1e0+{_G}::DOUBLE) END AS {c}"
            if k == 0 else f"s.{c}" for c in "xyz"
        )
        out.append(
            f"points_{k + 1} AS (SELECT s.line_id, s.pt_idx, {blend} FROM shifted_{k} s"
            f" LEFT JOIN points_{k} b ON b.line_id = s.line_id AND b.pt_idx = s.pt_idx - 1)"
        )
    return out


@query("contraction", with_ctes(*_iterations(3), select=f"""
SELECT line_id, pt_idx, {s6('x')}, {s6('y')}, {s6('z')} FROM points_3"""))
def contraction(spark, folder):
    points = reliable(event_points(spark, folder))
    size = N.mutual_cells(points, RADIUS)
    held = None if size is None else reliable(N.own_near(points, 2.0 * RADIUS))
    edges = _mutual(points) if held is None else lambda state: _carried(held, state, size)
    return rounded(B.contract(points, edges, iterations=3), "x", "y", "z")
