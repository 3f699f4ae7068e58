"""Searches in blocks against brute force, and that no edge is shuffled before it is summed."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import blocks
from skein.operators import lsh as L
from skein.operators import ranking as R
from skein.operators import search as N
from skein.queries import QUERIES

SCHEMA = "line_id bigint, pt_idx int, x double, y double, z double"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    rows = [(i % 23, i // 23, round(rng.uniform(-2, 2), 1), round(rng.uniform(-2, 2), 1), float(rng.randint(0, 1))) for i in range(460)]
    # a line that crowds a place, places that repeat, rows that lie nowhere
    rows += [(50, i, rng.gauss(0, 0.1), rng.gauss(0, 0.1), 0.0) for i in range(90)]
    return rows + [(51, 0, 0.0, 0.0, 0.0), (52, 0, None, 0.0, 0.0), (53, 0, math.nan, 0.0, 0.0), (None, 0, 0.0, 0.0, 0.0)]


def brute(data, radius):
    out = {}
    rows = [r for r in data if None not in r and not math.isnan(r[2])]
    for a in rows:
        for b in rows:
            d2 = sum((p - q) ** 2 for p, q in zip(a[2:], b[2:]))
            if a[0] != b[0] and d2 <= radius * radius:
                k = (a[0], a[1], b[0])
                out[k] = min(out.get(k, (9.0, 0)), (d2, b[1]))
    return out


@pytest.mark.parametrize("size", [(1 << 10, 1 << 16), (16, 64)])
def test_blocks_equal_brute_force(spark, data, monkeypatch, size):
    monkeypatch.setattr(blocks, "QUERIES", size[0])
    monkeypatch.setattr(blocks, "BLOCKS", 2)
    points = spark.createDataFrame(data, SCHEMA)
    want = brute(data, 0.6)
    targets = N.as_targets(points)
    for crowded in (4, 64):
        found = N.nearest_in_blocks(points, targets, 0.6, crowded=crowded, most=size[1]).collect()
        assert len(found) == len(want)
        assert {(r.line_id, r.pt_idx, r.nbr_line): r.nbr_id for r in found} == {k: v[1] for k, v in want.items()}
    near = N.neighbour_edges(points, 0.6, limit=3, most=size[1] * 2).collect()
    per = {}
    for k, v in want.items():
        per.setdefault(k[:2], []).append((math.sqrt(v[0]), k[2]))
    assert {(r.line_id, r.pt_idx, r.rank, r.nbr_line) for r in near} == {
        (*k, i + 1, line) for k, v in per.items() for i, (_, line) in enumerate(sorted(v)[:3])}


def test_mutual_edges_in_place_equal_the_join(spark, data):
    points = spark.createDataFrame([r for r in data if r[0] != 50], SCHEMA)
    joined = N.mutual_edges(N.neighbour_edges(points, 0.6))
    key = ["line_id", "pt_idx", "nbr_line", "nbr_pt"]
    want = {tuple(r) for r in joined.select(key).collect()}
    assert want and {tuple(r) for r in N.mutual_neighbour_edges(points, 0.6).select(key).collect()} == want


def test_keys_that_repeat_give_one_edge(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 0, 0.3, 0.0, 0.0), (2, 0, 0.4, 0.0, 0.0)], SCHEMA)
    got = N.neighbour_edges(points, 0.5).where("line_id = 1").collect()
    assert [(r.nbr_line, round(r.dist, 9)) for r in got] == [(2, 0.1)]


@pytest.mark.parametrize("name", ["range_edges", "range_edges_refined", "aligned_edges", "mutual_edges", "point_similarity",
                                  "distance_variation", "ann_centroid", "ann_seeding", "ann_multiprobe"])
def test_edges_are_not_shuffled(spark, folder, name):
    """Above the step that finds edges there is no exchange."""
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString().splitlines()
    found = next(i for i, line in enumerate(plan) if "MapInArrow" in line)
    assert not any("Exchange" in line or "Join" in line for line in plan[:found])


@pytest.mark.parametrize("name", ["neighbor_counts", "transparency_alpha", "contraction_step", "rgba_colors"])
def test_edges_are_summed_before_they_are_shuffled(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString().splitlines()
    found = next(i for i, line in enumerate(plan) if "MapInArrow" in line)
    above = [line for line in plan[:found] if "Exchange" in line or "Join" in line or "Aggregate" in line]
    assert "Aggregate" in above[-1]


def test_dumps_repeat_points_after_the_join(spark):
    points = spark.range(90).select(
        F.col("id").alias("line_id"), F.lit(0).alias("pt_idx"), *[F.lit(0.0).alias(c) for c in "xyz"])
    order = spark.range(90).select(F.col("id").alias("rank"), F.col("id").alias("line_id"))
    out = R.survivors(order, points, 20)
    assert {r[0]: r[1] for r in out.groupBy("kept").count().collect()} == {20: 20, 40: 40, 60: 60, 80: 80}
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert any("Generate" in line for line in plan[:join]) and not any("Generate" in line for line in plan[join:])


def test_survivor_dump_takes_every_40_lines(spark, tmp_path):
    import datetime

    rows = [(i, datetime.datetime(2024, 1, 1 + i // 130, i % 24, i % 60), i % 130, "click", float(i)) for i in range(260)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").write.parquet(
        str(tmp_path / "events.parquet"))
    got = QUERIES["survivor_dump"](spark, str(tmp_path)).groupBy("kept").agg(F.countDistinct("line_id")).collect()
    assert {r[0]: r[1] for r in got} == {40: 40, 80: 80, 120: 120}


def test_probed_segments_of_rows_without_a_place(spark):
    """A point that lacks a coordinate still gets its bucket's lines, without a distance."""
    segments = spark.createDataFrame([(i, 0, 2, float(i), 0.0, 0.0) for i in range(6)], "line_id bigint, beg int, end_ int, cx double, cy double, cz double")
    points = spark.createDataFrame([(9, 0, 1.0, 0.0, 0.0), (9, 1, None, 0.0, 0.0)], SCHEMA)
    functions = L.fit_buckets(L.draw_functions(2, seed=3), segments, 3)
    whole = L.multi_probe(functions, points.where("x IS NOT NULL"), segments, 2).collect()
    both = L.multi_probe(functions, points, segments, 2).collect()
    assert sorted(map(str, whole)) == sorted(str(r) for r in both if r.pt_idx == 0)
    assert any(r.pt_idx == 1 for r in both) and all(r.dist is None for r in both if r.pt_idx == 1)
