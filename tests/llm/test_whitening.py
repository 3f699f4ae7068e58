"""Spectral splitting against known spectra, and whitening against whole-matrix numpy."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import spectral, whitening
from skein.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("kind", range(6))
def test_components_of_known_spectra(kind):
    rng = np.random.default_rng(kind)
    for n in (1, 2, 3, 5, 8, 20, 64, 100):
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        e = [
            rng.random(n) * 100, np.r_[np.full(n // 2, 3.0), np.full(n - n // 2, 7.0)], 10.0 ** rng.uniform(-8, 8, n), np.zeros(n),
            np.r_[rng.random(n // 2), np.zeros(n - n // 2)], 5 + 1e-9 * rng.random(n),
        ][kind]
        a = (q * e) @ q.T
        values, vectors = spectral.largest(a, 8)
        scale = max(e.max(), 1e-300)
        assert vectors.shape == (n, min(n, 8)) and np.abs(values - np.sort(e)[::-1][:8]).max() < 1e-12 * scale
        assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_polar_factor_is_the_sign_of_the_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    e = np.r_[rng.uniform(1e-9, 4, 12), -rng.uniform(1e-9, 4, 18)]
    assert np.abs(spectral.polar((q * e) @ q.T) - (q * np.sign(e)) @ q.T).max() < 1e-5


def brute(rows):
    """Values, vectors and counts by whole matrices and Python integers."""
    kept = [(i, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    x = [x + [100_000] * (width - len(x)) for _, x in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array(x, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    return [i for i, _ in kept], deviation, y, values[::-1], vectors[:, ::-1]


def test_query_matches_numpy(spark, folder):
    got = QUERIES["op13_embedding_whitening"](spark, folder).toPandas()
    ids, deviation, y, values, vectors = brute(duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet' order by 1").fetchall())
    assert len(got) == 8 * len(ids) and set(got.n) == {len(ids)} and got.identity_error.nunique() == 1
    assert got.identity_error.max() < 1e-10
    table = got.pivot(index="vec_id", columns="component", values="whitened").sort_index()
    assert list(table.index) == ids and list(table.columns) == list(range(1, 9))
    want = y @ vectors[:, :8] / np.sqrt(values[:8])
    for k in range(8):
        assert min(np.abs(table[k + 1] - s * want[:, k]).max() for s in (1, -1)) < 1e-9
    first = got.groupby("vec_id").first().sort_index()
    assert first.deviation.tolist() == deviation
    assert np.allclose(got.groupby("component").explained.first(), values[:8] / values.sum(), rtol=1e-9)


def test_unusable_rows_short_vectors_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.standard_normal(3)], "x", "x", "x") for i in range(40)]
    odd = [(None, None), (101, None), (102, [1.0, None, 2.0]), (103, [NAN, 0.0, 0.0]), (104, [INF, 0.0, 0.0]), (105, [0.5]), (106, []), (None, [0.1, 0.2, 0.3]), (0, good[0][1])]
    rows = good + [(i, v, "x", "x", "x") for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, whitening string, w string, x string").repartition(5)
    model = whitening.fit(df)
    done = whitening.whiten(df, model, out="white", deviation="off")
    got = done.collect()
    assert done.columns == [*df.columns, "white", "off"] and len(got) == len(rows) and {r.whitening for r in got} == {"x"}
    assert sum(r.white is None for r in got) == 5 == sum(r.off is None for r in got)
    _, deviation, _, values, _ = brute([r[:2] for r in rows])
    assert sorted(r.off for r in got if r.off is not None) == sorted(deviation)
    assert model.n == 44 and np.allclose(model.values, values)
    assert whitening.identity_error(df, model) < 1e-10
    assert whitening.digest(df, model).count() == 44 * 3


def test_no_components_where_nothing_varies(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, [])], [(1, None)]):
        df = spark.createDataFrame(rows, kind)
        model = whitening.fit(df)
        assert model.n == sum(v is not None for _, v in rows) and len(model.values) == 0
        assert whitening.identity_error(df, model) is None and whitening.digest(df, model).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], kind)
    assert len(whitening.fit(line).values) == 1


def test_deviation_beyond_64_bits_is_null_and_huge_entries_are_refused(spark):
    rows = [(i, [float(2**31) * (i % 2), 1.0]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert whitening.whiten(df, whitening.fit(df)).where(F.col("deviation").isNotNull()).count() == 0
    near = [(i, [float(2**30) + i % 3, 1.0]) for i in range(2000)]
    close = spark.createDataFrame(near, "vec_id bigint, embedding array<double>")
    got = whitening.whiten(close, whitening.fit(close)).orderBy("vec_id").collect()
    assert [r.deviation for r in got] == brute(near)[1]
    with pytest.raises(Exception, match="cannot be summed exactly"):
        whitening.fit(spark.createDataFrame([(1, [1e30])], "vec_id bigint, embedding array<double>"))
