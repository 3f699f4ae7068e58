"""Walks over occupied buckets against a plain breadth-first search."""

import random
from itertools import product

import pytest

from skein.operators import lsh as L

FUNCTIONS = [L.HashFunction(tuple(float(i == j) for j in range(3)), 0.0, 1.0, 0.0, 9) for i in range(3)]


def segment_rows(rng, n):
    return [(rng.randrange(12), i, i + 1, *[float(rng.choice((0, 1, 4, 8))) + 0.5 for _ in range(3)]) for i in range(n)]


def code(place):
    return tuple(min(max(int(v), 0), 8) for v in place)


def plain_walk(points, segments, k, width):
    held = {}
    for line, _, _, *c in segments:
        held.setdefault(code(c), []).append((line, c))
    used = [sorted({b[i] for b in held}) for i in range(3)]

    def ends(i, v):
        return {max([u for u in used[i] if u < v], default=None), min([u for u in used[i] if u > v], default=None)} - {None}

    def common(a, b):
        return sum(b[i] in ends(i, a[i]) for i in range(3))

    links = {a: sorted((b for b in held if common(a, b)), key=lambda b: (-common(a, b), b))[:width] for a in held}
    out = {}
    for line, idx, *p in points:
        at = code(p)
        front = {at} if at in held else {b for b in held if common(at, b)}
        seen, step, steps = set(front), 0, dict.fromkeys(front, 0)
        while len({x for b in seen for x, _ in held[b]}) < k + 1:
            front = {b for a in front for b in links[a]} - seen
            if not front:
                break
            step += 1
            seen |= front
            steps |= dict.fromkeys(front, step)
        walked, met = [], set()
        for b in sorted(seen, key=lambda b: (steps[b], sum(abs(u - v) for u, v in zip(at, b)), b)):
            walked.append(b)
            met |= {x for x, _ in held[b]}
            if len(met) > k:
                break
        step = steps[walked[-1]] if walked else 0
        for b in walked:
            for other, c in held[b]:
                if other != line:
                    d = sum((u - v) ** 2 for u, v in zip(p, c)) ** 0.5
                    key = (line, idx, other)
                    out[key] = (step, min(d, out.get(key, (0, d))[1]))
    return out


def tables(spark, points, segments):
    return (
        spark.createDataFrame(points, "line_id int, pt_idx int, x double, y double, z double"),
        spark.createDataFrame(segments, "line_id int, beg int, end_ int, cx double, cy double, cz double"),
    )


@pytest.mark.parametrize("n, k, width", [(40, 4, 20), (40, 11, 2), (6, 9, 20)])
def test_walk_matches_plain_search(spark, n, k, width):
    rng = random.Random(n + k)
    segments = segment_rows(rng, n)
    points = [(i % 12, i, *[rng.uniform(0, 9) for _ in range(3)]) for i in range(30)]
    got = L.occupied_probe(FUNCTIONS, *tables(spark, points, segments), k, width).collect()
    want = plain_walk(points, segments, k, width)
    assert {(r.line_id, r.pt_idx, r.nbr_line): r.reach for r in got} == {key: v[0] for key, v in want.items()}
    assert all(abs(r.dist - want[r.line_id, r.pt_idx, r.nbr_line][1]) < 1e-12 for r in got)


def test_graph_keeps_the_best_links_of_a_full_slab(spark):
    """All buckets of two slabs are adjacent; each keeps those that agree in most functions, then by codes."""
    buckets = [(a, b, c) for a, b, c in product((0, 1), range(9), range(9))]
    codes = ["_h0", "_h1", "_h2"]
    df = spark.createDataFrame(buckets, "_h0 int, _h1 int, _h2 int")
    got = {}
    for r in L.bucket_graph(FUNCTIONS, df, codes, 5).collect():
        got.setdefault((r.q_h0, r.q_h1, r.q_h2), []).append((r._h0, r._h1, r._h2))

    def common(a, b):
        return sum(abs(u - v) == 1 for u, v in zip(a, b))

    for a in buckets:
        want = sorted((b for b in buckets if common(a, b)), key=lambda b: (-common(a, b), b))[:5]
        assert sorted(got[a]) == sorted(want)


@pytest.mark.parametrize("some_points, some_segments", [(True, False), (False, True), (False, False)])
def test_empty_tables(spark, some_points, some_segments):
    points, segments = tables(spark, [(0, 0, 1.0, 1.0, 1.0)], [(1, 0, 1, 1.0, 1.0, 1.0)])
    found = L.occupied_probe(FUNCTIONS, points if some_points else points.limit(0), segments if some_segments else segments.limit(0), 3)
    assert found.count() == 0
