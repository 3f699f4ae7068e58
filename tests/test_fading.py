"""Opacities held as keyed state, against the closed form and the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators.opacity import FADE, fade_frames
from skein.streaming import lines as live

TARGETS = "line_id bigint, pt_idx int, alpha double"


def send(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, TARGETS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i:02}"))
    return spark.readStream.schema(TARGETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def plain(batches):
    held = {}
    for rows in batches:
        best = {}
        for line, at, a in rows:
            if None not in (line, at, a):
                best[line, at] = max(a, best.get((line, at), a))
        for key, a in best.items():
            old = held.get(key, 0.0)
            held[key] = old + (a - old) * FADE
    return held


def test_keyed_state_against_plain_loop(spark, tmp_path):
    """Vertices on both sides of a chunk border, repeated targets, nulls, and batches that miss vertices."""
    rng = random.Random(4)
    spots = [(1, k) for k in (0, 1, live.STATE_CHUNK - 1, live.STATE_CHUNK, 3 * live.STATE_CHUNK + 5)] + [(2, k) for k in range(6)]
    batches = [[(*s, round(rng.random(), 3)) for s in rng.choices(spots, k=9)] + [(None, 1, 0.5), (1, None, 0.5), (2, 0, None)] for _ in range(6)]
    stream = send(spark, tmp_path, batches)
    live.fade_changes(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.line_id, r.pt_idx): r.alpha for r in live.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = plain(batches)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_state_stays_as_large_as_the_vertices(spark, tmp_path):
    """Equal targets again and again: the closed form of a fade, a step for each batch, and no more states."""
    batches = [[(line, k, 0.75) for line in (1, 2) for k in range(50)] for _ in range(5)]
    query = live.fade_changes(send(spark, tmp_path, batches), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    totals = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
    assert len(totals) == 5 and set(totals) == {2}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.agg(F.max("step")).first()[0] == 5 and out.count() == 500
    want = spark.range(1).select(fade_frames(F.lit(0.0), F.lit(0.75), 5)).first()[0]
    assert all(r.alpha == pytest.approx(want, abs=1e-12) for r in live.latest(out).collect())
