"""Repeated passages of any number of sentences against brute force over repeated windows of words."""

import random

import pytest

from skein.llm import span_dedup

WINDOW = 50


def brute_kept(rows):
    """Words of each text that no window of 50 words covers which begins earlier, by id and position."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        words = t.split()
        gone = set()
        for k in range(len(words) - WINDOW + 1):
            if seen.setdefault(tuple(words[k : k + WINDOW]), (i, k)) != (i, k):
                gone |= set(range(k, k + WINDOW))
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


@pytest.mark.parametrize("longest", [1, 3, 8, 40, 90])
def test_passages_of_short_and_long_sentences(spark, longest):
    """Passages of whole sentences of up to so many words, anywhere between sentences of a document's own."""
    rng = random.Random(longest)
    count = iter(range(10**6))

    def sentences(n, most):
        out = []
        while n > 0:
            size = min(rng.randint(1, most), n)
            out.append(" ".join(f"w{next(count)}" for _ in range(size)) + rng.choice([". ", "! ", "?\n", ".!! "]))
            n -= size
        return "".join(out)

    passages = [sentences(rng.randint(WINDOW, 200), longest) for _ in range(12)]
    rows = [(i, "".join(sentences(rng.randint(20, 60), 9) + rng.choice(passages) for _ in range(3)) + sentences(5, 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.text.split() for r in span_dedup.drop_repeats(df).collect()}
    want = brute_kept(rows)
    assert got == want and sum(map(len, want.values())) < sum(len(t.split()) for _, t in rows)


def test_one_sentence_of_fifty_words_is_a_passage(spark):
    long = " ".join(f"w{k}" for k in range(50)) + ". "
    rows = [(1, f"One. {long}Two."), (2, f"Three. {long}Four."), (3, f"Five. {long[4:]}Six."), (4, f"Seven. {long[4:]}Eight.")]
    got = {r.doc_id: r.text for r in span_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {**dict(rows), 2: "Three. Four."}


def test_runs_cover_every_run_that_is_long_enough():
    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.choice([1, 1, 2, 5, 9, 16, 50]) for _ in range(rng.randint(0, 30))]
        text = "".join("w " * (n - 1) + f"v{k}. " for k, n in enumerate(sizes))
        found = {(i, j) for _, i, j in span_dedup.runs(text)}
        for i in range(len(sizes)):
            for j in range(i + 1, len(sizes) + 1):
                long = sum(sizes[i:j]) >= 15 and j - i >= 2 or sizes[i:j] and j - i == 1 and sizes[i] >= 50
                assert long or (i, j) not in found
                if long:
                    assert set(range(i, j)) == {k for a, b in found if i <= a and b <= j for k in range(a, b)}


def test_frequent_passages_go_like_rare_ones(spark, monkeypatch):
    """Hashes of many rows are told from others, and lose the same occurrences without a shuffle of their rows."""
    monkeypatch.setattr(span_dedup, "FREQUENT", 8)
    monkeypatch.setattr(span_dedup, "HOT_ROWS", 20)
    common = "This passage stands in each and every one of these many documents. It has two sentences of words. "
    rows = [(i, f"Own {i} words come here. {common}And {'x' * (i % 7)} more of {i}. " + (f"{common}Last {i}." if i % 5 == 0 else "")) for i in range(60)]
    rows.append((None, common))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = span_dedup.all_runs(df, "doc_id", "text", 2, 15, 50)
    hot = span_dedup.frequent(found, found.count())
    counts = {r.a: r["count"] for r in found.groupBy("a").count().collect()}
    most = max(20, sum(counts.values()) // 8)
    assert {a for a, n in counts.items() if n > most} <= {r.a for r in hot.collect()} and hot.count() > 0
    plain = span_dedup.later_ones(found, hot.limit(0))
    key = ["id", "first", "last", "origin"]
    assert sorted(map(str, span_dedup.later_ones(found, hot).select(key).collect())) == sorted(map(str, plain.select(key).collect()))
    got = {r.doc_id: r.text for r in span_dedup.drop_repeats(df).collect()}
    assert [i for i, t in got.items() if common.strip() in (t or "")] == [0] and got[0].count(common.strip()) == 1
    assert all(f"Own {i} words" in got[i] for i in range(60))


def test_frequent_hashes_with_partitions_that_hold_no_sketch(spark):
    """More shuffle partitions than sketches, and none merged: the list is found all the same."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("64", "false")):
            spark.conf.set(k, v)
        found = spark.range(0, 60_000, 1, 8).selectExpr("if(id % 3 = 0, -7, id) AS a")
        assert [r.a for r in span_dedup.frequent(found, found.count()).collect()] == [-7]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
