"""Measures that are taken where rows meet, against the joins; ranks, heaps and edges that are not shuffled."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from skein.operators import bundling as B
from skein.operators import ranking as R
from skein.operators import search as N
from skein.operators import similarity as M
from skein.queries import QUERIES, bundling_queries as Q
from skein.queries.similarity_queries import neighbour_table

SCHEMA = "line_id bigint, pt_idx int, x double, y double, z double"
KEY = ["line_id", "pt_idx", "nbr_line", "nbr_pt"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(7)
    rows = []
    for line in range(30):
        x, y = rng.uniform(0, 3), rng.uniform(0, 3)
        for i in range(1 + line % 14):
            x, y = x + rng.gauss(0, 0.3), y + rng.gauss(0, 0.3)
            rows.append((line, i, None if (line, i) in ((13, 4), (20, 2)) else x, math.nan if (line, i) == (27, 5) else y, float(i % 2)))
    return spark.createDataFrame(rows, SCHEMA)


def told(df, *columns):
    def plain(v):
        return None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(r[c] for c in KEY), tuple(plain(r[c]) for c in columns)) for r in df.collect())


def above(df):
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return lines[: next(i for i, line in enumerate(lines) if "MapInArrow" in line)]


@pytest.mark.parametrize("measure", [
    lambda e, p: M.point_similarity(e, p), lambda e, p: M.distance_variation(e, p, 3).withColumnRenamed("variation", "similarity"),
    lambda e, p: M.shape_variation(e, p, 4).withColumnRenamed("variation", "similarity"),
    lambda e, p: M.shape_variation(e, p, 3, "both").withColumnRenamed("variation", "similarity"),
])
def test_measures_in_blocks_equal_the_joins(points, measure):
    joined = told(measure(N.neighbour_edges(points, 0.7), points), "similarity")
    found = measure(N.Search(points, 0.7), points)
    assert joined and told(found, "similarity") == joined
    assert any(v[0] is None or v[0] == "nan" or v[0] == M.EMPTY_SIMILARITY for _, v in joined)
    assert not any("Exchange" in line or "Join" in line for line in above(found))


def test_two_terms_in_blocks_equal_the_joins(points):
    whole = points.where("x IS NOT NULL AND NOT isnan(y)")
    joined = M.two_term_similarity(N.neighbour_edges(points, 0.7), whole, 1.0, 2, 0.2, 0.6)
    found = M.two_term_similarity(N.Search(points, 0.7), whole, 1.0, 2, 0.2, 0.6)
    assert told(found, "score", "similar") == told(joined, "score", "similar") != []
    assert not any("Exchange" in line or "Join" in line for line in above(found))


@pytest.mark.parametrize("name", ["topk_neighbors", "two_term_similarity"])
def test_edges_are_not_shuffled_to_be_ranked_or_scored(spark, folder, name):
    assert not any("Exchange" in line or "Join" in line for line in above(QUERIES[name](spark, folder)))


def test_the_neighbour_table_is_not_shuffled(points):
    table = neighbour_table(points)
    assert not any("Exchange" in line or "Join" in line or "Window" in line for line in above(table))


@pytest.mark.parametrize("most", [1 << 16, 16])
def test_few_nearest_lines_of_many(spark, most):
    """Radii grow for the queries that lack lines; places repeat, so that distances tie."""
    rng = random.Random(5)
    rows = [(i, 0, round(rng.uniform(0, 1) ** 3, 2), round(rng.uniform(0, 1) ** 3, 2), 0.0) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r.line_id, r["rank"]): r.nbr_line for r in N.neighbour_edges(frame, 0.5, limit=4, most=most).collect()}
    want = {}
    for a in rows:
        near = sorted((math.sqrt(d), b[0]) for b in rows if b[0] != a[0] and (d := (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) <= 0.25)
        want |= {(a[0], k + 1): line for k, (_, line) in enumerate(near[:4])}
    assert got == want


def test_wide_cells_find_the_same_edges(points, monkeypatch):
    narrow = told(N.neighbour_edges(points, 0.2), "dist")
    monkeypatch.setattr(N, "FEW", 0)
    monkeypatch.setattr(N, "CELLS", 1)
    assert max(N.wide_cells(N.as_targets(points), 0.2, 1 << 16)) > 0.4
    assert told(N.neighbour_edges(points, 0.2), "dist") == narrow != []


def test_heaps_of_rows_that_come_together(spark, points):
    table = neighbour_table(points).localCheckpoint()
    plain = {(r.line_id, r.pt_idx): str(r.heap) for r in R.heaps(table).collect()}
    assert {(r.line_id, r.pt_idx): str(r.heap) for r in R.heaps(table, together=True).collect()} == plain != {}
    rows = [pa.record_batch({"a": [1, 1], "b": [0, 0], "v": [1.0, 2.0]}), pa.record_batch({"a": [1, 2], "b": [0, 0], "v": [3.0, 4.0]})]
    runs = [r for b in R._in_runs(iter(rows)) for r in b.to_pylist()]
    assert [(r["a"], [e["v"] for e in r["heap"]]) for r in runs] == [(1, [1.0, 2.0, 3.0]), (2, [4.0])]


def test_weighted_alpha_takes_one_pass(spark):
    rows = [(1, 0, 0.5, 2.0), (1, 0, 1.0, None), (1, 0, 2.0, 0.3), (2, 0, 0.0, 1.0), (2, 1, 1.0, None)]
    table = spark.createDataFrame(rows, "line_id bigint, pt_idx int, dist double, variation double")
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    got = {(r.line_id, r.pt_idx): r.alpha for r in M.weighted_alpha(table.mapInArrow(count, table.schema), 0.5).collect()}
    assert reads.value == len(rows)
    mean, low = 1.1, math.exp(-2.0)
    parts = [(1 / d**2, None if s is None else 1 - mean * 0.5 * (math.exp(-s * s / 2) - low) / (1 - low)) for _, _, d, s in rows[:3]]
    assert got[1, 0] == pytest.approx(sum(w * p for w, p in parts if p is not None) / sum(w for w, _ in parts))
    assert got[2, 0] is None and got[2, 1] is None


def test_contraction_holds_no_edges(points):
    whole = points.where("x IS NOT NULL AND NOT isnan(y)").withColumn(
        "pt_idx", (F.row_number().over(Window.partitionBy("line_id").orderBy("pt_idx")) - 1).cast("int")).localCheckpoint()
    size = N.mutual_cells(whole, Q.RADIUS)
    held = N.own_near(whole, 2.0 * Q.RADIUS).localCheckpoint()
    asked = []

    def edges(state):
        asked.append(Q._carried(held, state, size))
        return asked[-1]

    one = {(r.line_id, r.pt_idx): (r.x, r.y, r.z) for r in B.contract(whole, N.mutual_neighbour_edges(whole, Q.RADIUS), 2).collect()}
    two = {(r.line_id, r.pt_idx): (r.x, r.y, r.z) for r in B.contract(whole, edges, 2).collect()}
    assert len(asked) == 2 and one.keys() == two.keys()
    assert all(two[k] == pytest.approx(v, abs=1e-12) for k, v in one.items())
