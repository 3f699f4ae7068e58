"""Steps that tell their result where rows meet: against plain computations, and without shuffles of pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import fields as V
from skein.operators import geometry as G
from skein.operators import lsh as L
from skein.operators import segmentation as S
from skein.operators import similarity as M
from skein.queries import QUERIES

SCHEMA = "line_id bigint, pt_idx int, x double, y double, z double"


def walks(spark, lines, n, missing=()):
    rng = random.Random(3)
    rows = []
    for line in range(lines):
        x, y = rng.uniform(0, 3), rng.uniform(0, 3)
        for i in range(n + line % 3):
            x, y = x + rng.gauss(0, 0.4), y + rng.gauss(0, 0.4)
            rows.append((line, i, x, None if (line, i) in missing else y, float(i % 2)))
    return spark.createDataFrame(rows, SCHEMA), rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ann_vertex", "ann_tangent_gated", "affinity_matrix", "gaussian_smooth", "segments_global"])
def test_nothing_is_shuffled_after_the_step_that_finds_rows(spark, folder, name):
    lines = plan(QUERIES[name](spark, folder)).splitlines()
    found = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert not any("Exchange" in line or "Join" in line for line in lines[:found])


def found_in(spark, edges):
    return {(r.line_id, r.pt_idx, r.nbr_line): (r.nbr_pt, None if r.dist is None else round(r.dist, 9)) for r in edges.collect()}


@pytest.mark.parametrize("missing", [(), ((1, 3), (4, 0), (5, 9))])
def test_vertices_in_blocks_equal_the_joins(spark, monkeypatch, missing):
    points = G.tangents(walks(spark, 7, 20, missing)[0])
    segments = S.attributes(points, S.cut_evenly(points, 2.0))
    index = L.LshIndex(L.fit(L.draw_functions(4, 2), segments), 2, 1)
    functions = L.fit_buckets(L.draw_functions(2, 5), segments, 3)

    def run():
        probed = L.multi_probe(functions, points, segments, 2, vertices=points)
        return [found_in(spark, e) for e in (
            L.vertex_edges(index, points, segments), L.ann_edges(index, points, segments, 2.0, 0.3), probed)]

    told = run()
    monkeypatch.setattr(L, "_short", lambda s: False)
    assert told == run() and all(told)


def test_probe_with_a_limit_keeps_the_nearest_lines(spark):
    points, _ = walks(spark, 9, 12)
    segments = S.attributes(points, S.cut_evenly(points, 2.0))
    functions = L.fit_buckets(L.draw_functions(2, 5), segments, 2)
    every = L.ranked(L.multi_probe(functions, points, segments, 4, vertices=points)).where("rank <= 2")
    few = L.ranked(L.multi_probe(functions, points, segments, 4, vertices=points, limit=2)).where("rank <= 2")
    assert found_in(spark, every) == found_in(spark, few) != {}


def test_smoothing_equals_plain_means_in_any_chunks(spark):
    points, rows = walks(spark, 4, 60, ((1, 5), (2, 0)))
    w, g, want = 3, G.SMOOTH_WEIGHT, {}
    for line in range(4):
        for k, c in enumerate("xyz"):
            v = [r[2 + k] for r in rows if r[0] == line]
            for _ in range(5):
                near = [v[max(0, i - w) : i + w] for i in range(len(v))]
                v = [None if a is None else (a * (1 - g) + g * sum(b for b in n if b is not None)) / (1 + g * (len(n) - 1))
                     for a, n in zip(v, near)]
            want |= {(line, i, c): a for i, a in enumerate(v)}
    for chunk in (1 << 15, 31):
        got = {(r.line_id, r.pt_idx, c): r[c] for r in G.smooth(points, w, 5, chunk).collect() for c in "xyz"}
        assert got.keys() == want.keys()
        assert all(got[k] is None if a is None else got[k] == pytest.approx(a, rel=1e-12) for k, a in want.items())


def test_optimal_cuts_of_many_lines_equal_those_by_blocks(spark, monkeypatch):
    points, _ = walks(spark, 12, 40, ((3, 4),))
    whole = sorted(map(tuple, S.cut_globally(points, 0.3).collect()))
    monkeypatch.setattr(S, "COSTS", 1)
    assert whole == sorted(map(tuple, S.cut_globally(points, 0.3).collect()))
    assert "FlatMapGroupsInPandas" not in plan(S.cut_globally(points, 0.3))
    assert whole == sorted(map(tuple, S.cut_globally(points, 0.3, block=16).collect()))


def test_a_tracing_task_gives_vertices_out_as_it_goes(spark, monkeypatch):
    grid = spark.range(8 * 8 * 4).select(
        *[c.cast("int").alias(a) for a, c in zip(V.AXES, (F.col("id") % 8, F.floor(F.col("id") / 8) % 8, F.floor(F.col("id") / 64)))],
        F.lit(0.2).alias("u"), F.lit(0.1).alias("v"), F.lit(0.01).alias("w"))
    seeds = spark.range(30).select(F.col("id").alias("seed"), *[(F.col("id") % 3 + 1.5).alias(c) for c in "xy"], F.lit(1.0).alias("z"))
    whole = sorted(map(tuple, V.trace(grid, seeds, 200, (8, 8, 4), block=4).collect()))
    monkeypatch.setattr(V, "MADE", 64)
    assert whole == sorted(map(tuple, V.trace(grid, seeds, 200, (8, 8, 4), block=4).collect())) and len(whole) > 500


def test_places_are_searched_once(spark, monkeypatch):
    """Copies of all points at the same places do not add to the search."""
    points, rows = walks(spark, 5, 12)
    points = points.withColumn("opacity", F.col("x"))
    copies = points.unionByName(points.withColumn("line_id", F.col("line_id") + 100))
    lost = points.limit(1).withColumn("line_id", F.lit(None).cast("bigint"))
    assert M.spread_opacity(points.unionByName(lost)).count() == len(rows)  # rows of no line have no row
    asked, search = [], M.nearest_lines

    def counted(queries, targets, *args, **more):
        asked.append((queries.count(), targets.count()))
        return search(queries, targets, *args, **more)

    monkeypatch.setattr(M, "nearest_lines", counted)
    one = {(r.line_id, r.pt_idx): r.opacity for r in M.spread_opacity(points).collect()}
    two = {(r.line_id, r.pt_idx): r.opacity for r in M.spread_opacity(copies).collect()}
    assert len(one) == len(rows) and len(two) == 2 * len(rows)
    assert asked[0] == asked[1]
    tops = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[: math.ceil(len(rows) * 0.14)]
    for r in rows:
        d, o = min((math.dist(r[2:], t[2:]), t[2]) for t in tops)
        e = math.exp(-d / 0.72)
        want = max((r[2] + 1.8 * o * e) / 2, 0.2 * e)
        assert one[r[:2]] == pytest.approx(want) and two[r[:2]] == pytest.approx(want) and two[r[0] + 100, r[1]] == pytest.approx(want)
