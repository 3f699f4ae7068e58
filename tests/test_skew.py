"""Chunked, range-partitioned and salted routes give what the plain ones give."""

import math
import random

import pytest
from pyspark.sql import Window, functions as F

from skein.operators import geometry as G
from skein.operators import opacity as O
from skein.operators import search as N
from skein.operators import segmentation as S
from skein.skew import (
    attach_line, halo_windows, line_running_sums, rank_within, running_sums, salted_join,
)


def rows(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                  for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def walk(spark):
    """One line holds most of the points."""
    rng = random.Random(3)
    data = []
    for line, n in ((0, 400), (1, 30), (2, 4), (3, 1), (4, 7)):
        x = y = z = 0.0
        for i in range(n):
            x, y, z = x + rng.uniform(0, 1), y + rng.uniform(-1, 1), z + rng.uniform(-1, 1)
            data.append((line, i, x, y, z))
    return spark.createDataFrame(data, "line_id bigint, pt_idx int, x double, y double, z double")


def test_halo_windows_match_plain_windows(walk):
    def cols(w):
        frame = w.rowsBetween(-3, 2)
        return {"a": F.lag("x", 2).over(w), "b": F.lead("y").over(w), "c": F.sum("z").over(frame)}

    plain = walk.withColumns(cols(Window.partitionBy("line_id").orderBy("pt_idx")))
    cut = halo_windows(walk, cols, 3, 2, chunk=7)
    names = ["line_id", "pt_idx", "a", "b", "c"]
    assert rows(plain.fillna(-9), *names) == rows(cut.fillna(-9), *names)


def test_ranks_of_a_hot_group(walk):
    order = [F.col("x"), F.col("pt_idx")]
    plain = rank_within(walk, ["line_id"], order, "r")
    hot = rank_within(walk, ["line_id"], order, "r", hot_rows=50, parts=5)
    assert rows(plain, "line_id", "pt_idx", "r") == rows(hot, "line_id", "pt_idx", "r")


def test_running_sums_over_everything(walk):
    got = running_sums(walk, [], ["line_id", "pt_idx"], {"n": F.lit(1).cast("bigint")}, hot_rows=50, parts=6)
    assert [r[2] for r in rows(got, "line_id", "pt_idx", "n")] == list(range(1, 443))


def test_line_sums_over_chunks(walk):
    plain = line_running_sums(walk, {"s": F.col("x")})
    cut = line_running_sums(walk, {"s": F.col("x")}, chunk=9)
    for a, b in zip(rows(plain, "line_id", "pt_idx", "s"), rows(cut, "line_id", "pt_idx", "s")):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])


def test_attach_line_spreads_over_chunks(walk):
    got = attach_line(walk, G.line_sizes(walk), chunk=16)
    assert got.count() == walk.count()
    assert rows(got.groupBy("line_id").agg(F.max("n").alias("n")), "line_id", "n") == [
        (0, 400), (1, 30), (2, 4), (3, 1), (4, 7)
    ]


def test_salted_join_keeps_all_pairs(spark):
    left = spark.range(1000).select(
        F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a")
    )
    right = spark.range(100).select((F.col("id") % 50).alias("k"), F.col("id").alias("b"))
    plain = left.join(right, "k")
    dealt = salted_join(left, right, ["k"], spread=["a"], hot_rows=20)
    assert rows(plain, "k", "a", "b") == rows(dealt, "k", "a", "b")


@pytest.mark.parametrize("cut", [
    lambda p, c: S.cut_by_curvature(p, 1.5, 4.0, chunk=c),
    lambda p, c: S.cut_by_cross_curvature(p, 3.0, 9.0, chunk=c),
    lambda p, c: S.cut_by_ratio(p, 1.4, 6.0, chunk=c),
    lambda p, c: S.cut_by_tortuosity(p, 1.3, chunk=c),
])
def test_cuts_do_not_depend_on_chunks(walk, cut):
    whole = rows(cut(walk, 1 << 12), "line_id", "beg", "end_")
    assert len(whole) > 20
    assert whole == rows(cut(walk, 16), "line_id", "beg", "end_")


def test_kept_vertices_do_not_depend_on_chunks(walk):
    whole = rows(G.drop_near_kept(walk, 1.5), "line_id", "pt_idx")
    assert whole == rows(G.drop_near_kept(walk, 1.5, chunk=8), "line_id", "pt_idx")


def test_optimal_cuts_do_not_depend_on_blocks(walk):
    whole = rows(S.cut_globally(walk, 2.0), "line_id", "beg", "end_")
    assert len(whole) > 10
    assert whole == rows(S.cut_globally(walk, 2.0, block=150), "line_id", "beg", "end_")


def test_refined_search_equals_brute_force(spark):
    rng = random.Random(5)
    data = [(0, i, rng.gauss(0, 0.01), rng.gauss(0, 0.01), 0.0) for i in range(300)]
    data += [(1, i, 0.4 + rng.gauss(0, 0.02), rng.gauss(0, 0.02), 0.0) for i in range(200)]
    data += [(2 + i % 9, i // 9, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1))
             for i in range(180)]
    points = spark.createDataFrame(
        data, "line_id bigint, pt_idx int, x double, y double, z double"
    )
    radius, want = 0.6, {}
    for a in data:
        for b in data:
            d = math.dist(a[2:], b[2:])
            if a[0] != b[0] and d <= radius:
                k = (a[0], a[1], b[0])
                want[k] = min(want.get(k, (9.0, 0)), (round(d, 9), b[1]))
    for args in ({"crowded": 4}, {"crowded": 4, "hot_rows": 40}, {}):
        found = N.neighbour_edges(points, radius, **args).collect()
        got = {(r.line_id, r.pt_idx, r.nbr_line): (round(r.dist, 9), r.nbr_pt) for r in found}
        assert got == want


def test_pixel_of_any_depth(spark):
    data = [(7, i, 0, i, ((i * 37) % 100) / 100.0, float(i % 13)) for i in range(200)]
    frags = spark.createDataFrame(
        data, "pixel bigint, pt_idx int, line_id bigint, k int, importance double, depth double"
    )
    plain = O.fragment_opacity(O.depth_order(frags))
    cut = O.fragment_opacity(O.depth_order(frags, hot_rows=20, parts=4), chunk=16)
    for a, b in zip(rows(plain, "pt_idx", "alpha"), rows(cut, "pt_idx", "alpha")):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1])
    tint = O.depth_order(frags).withColumns(
        {"r": F.col("importance"), "g": F.lit(0.5), "b": F.lit(0.1), "a": F.lit(0.97)}
    )
    one, two = O.composite(tint).first(), O.composite(tint, chunk=16).first()
    for c in ("r", "g", "b", "alpha"):
        assert one[c] == pytest.approx(two[c])


def test_rows_of_a_large_folder_keep_the_order_of_its_files(spark, tmp_path, monkeypatch):
    from skein import skew
    from skein.sources import text

    for name, first in (("b", 100), ("a", 0), ("c", 200)):
        (tmp_path / name).write_text("".join(f"{first + i}\n" for i in range(50)))
    plain = [r.value for r in text.numbered_rows(spark, str(tmp_path), as_one=True).orderBy("row").collect()]
    monkeypatch.setattr(skew.rank_within, "__defaults__", tuple(10 if x == skew.HOT_ROWS else x for x in skew.rank_within.__defaults__))
    large = [r.value for r in text.numbered_rows(spark, str(tmp_path), as_one=True).orderBy("row").collect()]
    assert plain == large == [str(f + i) for f in (0, 100, 200) for i in range(50)]
