"""Closed forms: lines, circles and helices; constant, linear and circular fields."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.functions import scalars
from skein.functions.vec import Vec3
from skein.operators import bundling as B
from skein.operators import fields as V
from skein.operators import geometry as G
from skein.operators import opacity as O
from skein.operators import ranking as R
from skein.operators import search as N
from skein.operators import similarity as M
from skein.operators import segmentation as S
from skein.operators.components import components
from skein.operators.seeding import grow_lines

POINTS = "line_id bigint, pt_idx int, x double, y double, z double"


def lines(spark, *paths):
    rows = [(k, i, float(x), float(y), float(z))
            for k, path in enumerate(paths) for i, (x, y, z) in enumerate(path)]
    return spark.createDataFrame(rows, POINTS)


STRAIGHT = [(i, 0, 0) for i in range(20)]
CIRCLE = [(2 * math.cos(i * math.pi / 180), 2 * math.sin(i * math.pi / 180), 0) for i in range(360)]
HELIX = [(math.cos(i / 50), math.sin(i / 50), 0.5 * i / 50) for i in range(400)]


def test_straight_circle_helix(spark):
    points = lines(spark, STRAIGHT, CIRCLE, HELIX, STRAIGHT[:3], STRAIGHT[:1])
    kappa = G.curvature(points).groupBy("line_id").agg(
        F.min("kappa").alias("lo"), F.max("kappa").alias("hi")
    )
    got = {r.line_id: (r.lo, r.hi) for r in kappa.collect()}
    assert got[0] == pytest.approx((0, 0), abs=1e-12)
    assert got[1] == pytest.approx((0.5, 0.5), rel=1e-3)
    assert got[2] == pytest.approx((0.8, 0.8), rel=1e-3)
    assert got[3] == (None, None) and got[4] == (None, None)
    stats = {r.line_id: r for r in G.line_lengths(points).collect()}
    assert stats[0].arc_length == 19 and stats[0].tortuosity == 1
    assert stats[1].arc_length == pytest.approx(4 * math.pi * 359 / 360, rel=1e-4)
    assert stats[4].tortuosity == 1
    t = G.tangents(points).where("line_id = 0").collect()
    assert all((r.tx, r.ty, r.tz) == (1, 0, 0) for r in t)


def test_duplicates_have_zero_tangent(spark):
    points = lines(spark, [(1, 1, 1)] * 6)
    assert {(r.tx, r.ty, r.tz) for r in G.tangents(points).collect()} == {(0, 0, 0)}
    assert G.drop_near_kept(points).count() == 1
    assert {r.kappa for r in G.curvature(points).collect()} == {None}


def test_parallel_pair(spark):
    points = lines(spark, STRAIGHT, [(x, 0.4, z) for x, _, z in STRAIGHT])
    edges = N.neighbour_edges(points, 0.5)
    assert {round(r.dist, 12) for r in edges.collect()} == {0.4} and edges.count() == 40
    assert N.mutual_edges(edges).count() == 40
    assert all(abs(r.similarity) < 1e-12 for r in M.point_similarity(edges, points).collect())
    moved = B.displacement(G.tangents(points), edges)
    assert {round(abs(r.ddy), 12) for r in moved.collect()} == {0.2}
    close = B.contract(points, edges, iterations=3)
    assert close.select(B.mean_gap(close, edges)).first()[0] < 0.05


def test_segments_cover_each_line(spark):
    points = lines(spark, CIRCLE, HELIX, STRAIGHT[:4], STRAIGHT[:2])
    spans = S.cut_by_curvature(points, 0.7, 2.0).orderBy("line_id", "beg").collect()
    sizes = {0: 360, 1: 400, 2: 4, 3: 2}
    for k, n in sizes.items():
        own = [r for r in spans if r.line_id == k]
        assert own[0].beg == 0 and own[-1].end_ == n
        assert all(a.end_ == b.beg + 1 for a, b in zip(own, own[1:]))
    attrs = S.attributes(points, S.cut_by_curvature(points, 0.7, 2.0)).first()
    mid = ((attrs.sx + attrs.ex) / 2, (attrs.sy + attrs.ey) / 2)
    assert mid == pytest.approx((attrs.cx, attrs.cy))


def field(spark, v, n=8):
    grid = V.lattice(spark, n, n, n)
    return grid.withColumns(dict(zip("uvw", v)))


def test_trilinear_is_exact_on_linear_fields(spark):
    grid = field(spark, (F.col("col") * 2.0 + F.col("row"), F.col("layer") * 1.0, F.lit(3.0)))
    points = lines(spark, [(1.25, 2.5, 3.75), (0, 0, 0), (7.5, 7.0, 1.5), (8.1, 0, 0)])
    got = {r.pt_idx: (r.u, r.v, r.w) for r in V.sample(points, grid, (8, 8, 8)).collect()}
    assert got == {0: (5.0, 3.75, 3.0), 1: (0, 0, 3), 2: (21.0, 1.5, 3.0)}


@pytest.mark.parametrize("block", [64, 4])
def test_constant_field_gives_straight_lines(spark, block):
    grid = V.constant_field(V.lattice(spark, 12, 6, 6), (1.0, 0.0, 0.0))
    seeds = spark.createDataFrame([(0, 5.0, 2.5, 2.5), (1, 1.0, 1.0, 1.0)], "seed int, x double, y double, z double")
    path = V.trace(grid, seeds, dims=(12, 6, 6), block=block).orderBy("line_id", "pt_idx").collect()
    own = [r for r in path if r.line_id == 0]
    assert [r.pt_idx for r in own] == list(range(len(own)))
    assert all((r.y, r.z) == (2.5, 2.5) for r in own)
    assert own[0].x < 1.5 and own[-1].x > 10.5
    assert all(a.x < b.x for a, b in zip(own, own[1:]))


def test_blocks_do_not_change_a_circle(spark):
    n = 24
    grid = V.circular_field(V.lattice(spark, n, n, 3), (n, n, 2))
    flat = grid.withColumn("w", F.lit(0.0))
    seeds = spark.createDataFrame([(0, 18.0, 12.0, 1.0)], "seed int, x double, y double, z double")
    whole = V.trace(flat, seeds, 300, (n, n, 3), block=64).orderBy("pt_idx").collect()
    parts = V.trace(flat, seeds, 300, (n, n, 3), block=6).orderBy("pt_idx").collect()
    assert [(r.pt_idx, r.x, r.y) for r in whole] == [(r.pt_idx, r.x, r.y) for r in parts]
    assert all(abs(math.hypot(r.x - 12, r.y - 12) - 6) < 0.15 for r in whole)


def plain_growth(paths, starts, separation, alpha, half, min_length, max_size):
    """Lines grown one after the other, each end tested as it is made."""
    far = math.dist
    done = {}

    def similar(path, c):
        for other, (lo, hi) in done.items():
            own = paths[other]
            d, q = min((far(path[c], own[q]), q) for q in range(lo, hi + 1))
            h = min(half, q - lo, hi - q)
            if d < separation and h > 0:
                off = [abs(far(path[c + o], own[q + o]) - d) for o in range(-h, h + 1)]
                if d + alpha * sum(off) / len(off) < separation:
                    return True
        return False

    for i, path in paths.items():
        lo = hi = starts[i]
        ahead = back = True
        while (ahead or back) and hi - lo + 1 < max_size:
            if ahead:
                ahead = hi + 1 < len(path) and not (hi + 2 - lo > 2 * half and similar(path, hi + 1 - half))
                hi += ahead
            if back:
                back = lo > 0 and not (hi - lo + 2 > 2 * half and similar(path, lo - 1 + half))
                lo -= back
        if sum(far(path[k], path[k + 1]) for k in range(lo, hi)) > min_length:
            done[i] = lo, hi
    return {i: paths[i][lo : hi + 1] for i, (lo, hi) in done.items()}


@pytest.mark.parametrize("max_size", [5000, 25])
def test_lines_stop_growing_as_one_after_the_other(spark, max_size):
    rng = random.Random(6)
    paths, starts = {}, {}
    for i in range(30):
        x, y, a = rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 7)
        path = []
        for _ in range(rng.randint(3, 70)):
            path.append((x, y, 0.0))
            a += rng.uniform(-0.3, 0.3)
            x, y = x + 0.2 * math.cos(a), y + 0.2 * math.sin(a)
        paths[i], starts[i] = path, rng.randrange(len(path))
    paths[30], starts[30] = list(paths[3]), starts[3]  # a whole copy of an earlier line
    paths[31], starts[31] = [(50.0, 50.0, 0.0)], 0
    df = lines(spark, *paths.values())
    begin = spark.createDataFrame(list(starts.items()), "line_id bigint, seed_at int")
    got = {}
    for r in grow_lines(df, begin, 0.5, 0.2, 3, 1.5, max_size).orderBy("line_id", "pt_idx").collect():
        got.setdefault(r.line_id, []).append((r.x, r.y, r.z))
    want = plain_growth(paths, starts, 0.5, 0.2, 3, 1.5, max_size)
    assert got == want and any(len(want[i]) < len(paths[i]) for i in want) and len(want) < 31 - (max_size < 50)
    assert grow_lines(df.where("false"), begin, 0.5).count() == 0


def plain_order(table, sizes):
    """Lines by repeated removal of the one with the lowest score, all scores made anew each time."""
    heaps = {}
    for line, pt, nbr, _, var in sorted(table, key=lambda r: (r[3], r[2])):
        heaps.setdefault((line, pt), []).append((nbr, var))
    want = []
    while True:
        scores = {}
        for (line, pt), heap in sorted(heaps.items()):
            if heap:
                first = line not in scores
                s, c = scores.get(line, (0.0, 0))
                scores[line] = (s + heap[0][1] * (1 if first else (64 - len(heap)) ** 0.1), c + 1)
        if not scores:
            break
        total = {k: (s + sizes[k] - c) / c + 0.1 * (sizes[k] - c) for k, (s, c) in scores.items()}
        gone = min(total, key=lambda k: (total[k], k))
        want.append(gone)
        heaps = {k: [e for e in h if e[0] != gone] for k, h in heaps.items() if k[0] != gone}
    return want + [k for k in sorted(sizes) if k not in want]


def ordered(spark, table, sizes, **args):
    points = spark.createDataFrame([(k, i, 0.0, 0.0, 0.0) for k, n in sizes.items() for i in range(n)], POINTS)
    frame = spark.createDataFrame(table, "line_id bigint, pt_idx int, nbr_line bigint, dist double, variation double")
    got = R.greedy_order(points, N.top_neighbours(frame), **args).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(len(sizes)))
    return [r.line_id for r in got]


def test_greedy_order_against_plain_loop(spark):
    table = [
        (0, 0, 1, 0.1, 3.0), (0, 0, 2, 0.2, 1.0), (0, 1, 1, 0.3, 2.0), (1, 0, 0, 0.1, 0.5),
        (1, 1, 2, 0.2, 4.0), (2, 0, 0, 0.4, 2.5), (2, 1, 1, 0.1, 0.2), (2, 2, 0, 0.3, 1.0),
    ]
    sizes = {0: 2, 1: 3, 2: 3, 3: 2}
    want = plain_order(table, sizes)
    assert ordered(spark, table, sizes) == want
    assert ordered(spark, table, sizes, batch=2, local_entries=0) == want


def test_greedy_order_merges_groups(spark):
    """Groups of lines of many sizes, ties between them, one-way links, and one group ordered by all tasks."""
    rng = random.Random(4)
    sizes, table = {}, []
    for g in range(12):
        ids = [100 * (g % 5) + 7 * g + i for i in range(rng.randint(2, 7))]
        sizes |= {i: rng.randint(1, 6) for i in ids}
        for i in ids:
            for p in range(sizes[i]):
                near = rng.sample([j for j in ids if j != i], rng.randint(0, len(ids) - 1))
                table += [(i, p, j, rng.choice([0.1, 0.2, 0.3]) + j / 1e6, rng.choice([0.5, 1.0, 2.5, rng.random()])) for j in near]
    want = plain_order(table, sizes)
    assert ordered(spark, table, sizes) == want
    largest = max(Counter(line // 1 for line, *_ in table).values())
    assert ordered(spark, table, sizes, local_entries=2 * largest) == want


def test_components_of_paths_and_stars(spark):
    rng = random.Random(8)
    path = list(range(0, 400))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000, 1000 + i) for i in range(1, 300)] + [(2001, 2000), (2001, 2001)]
    nodes = path + list(range(1000, 1300)) + [2000, 2001, 2002]
    frame = spark.createDataFrame(edges, "a bigint, b bigint"), spark.createDataFrame([(n,) for n in nodes], "node bigint")
    got = dict(components(frame[1], frame[0]).collect())
    assert got == {n: 0 if n < 400 else 1000 if n < 2000 else 2000 if n < 2002 else 2002 for n in nodes}


def test_control_points_add_up(spark):
    points = lines(spark, CIRCLE, HELIX, STRAIGHT, STRAIGHT[:2])
    dealt = O.control_points(points, 40).orderBy("line_id").collect()
    assert sum(r.n_cp for r in dealt) == 40 and min(r.n_cp for r in dealt) >= 2
    assert [r.cp_offset for r in dealt] == [sum(d.n_cp for d in dealt[:i]) for i in range(4)]


def test_two_fragments_in_a_pixel(spark):
    frags = spark.createDataFrame(
        [(0, 0, 0, 0.1, 0.5), (0, 1, 0, 0.9, 0.8)],
        "pixel bigint, line_id bigint, pt_idx int, depth double, importance double",
    )
    got = {r.line_id: r.alpha for r in O.fragment_opacity(O.depth_order(frags), 2.0, 3.0, 1.0).collect()}
    assert got[0] == pytest.approx(1 / (1 + 0.25 * 2 * 0.64))
    assert got[1] == pytest.approx(1 / (1 + 0.04 * 3 * 0.25))


def test_scalars(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first().v

    assert value(scalars.unpack_rgba(scalars.pack_rgba(*[F.lit(i) for i in (1, 200, 3, 255)]))["g"]) == 200
    assert value(scalars.parse_number(F.lit("-1.5e3"))) == -1500
    assert value(scalars.parse_number(F.lit("x"))) is None
    assert value(scalars.line_width(F.lit(300))) == 2.2
    assert value(scalars.critical_type_name(F.lit(6))) == "AttractFocus"
    assert value(scalars.smoothstep(F.lit(0.25))) == pytest.approx(0.15625)
    assert value(scalars.type_in_mask(F.lit(2), 0b100)) and not value(scalars.type_in_mask(F.lit(1), 0b100))
    assert value(scalars.finite_or(F.lit(float("inf")))) == 0
    lo, hi = scalars.interval_intersect(F.lit(0), F.lit(5), F.lit(3), F.lit(9))
    assert (value(lo), value(hi), value(scalars.interval_length(lo, hi, True))) == (3, 5, 3)
    assert value(Vec3.lit(0, 0, 0).unit0().x) == 0 and value(Vec3.lit(0, 0, 0).unit().x) is None
    assert value(Vec3.lit(1, 0, 0).angle(Vec3.lit(0, 2, 0))) == pytest.approx(math.pi / 2)
