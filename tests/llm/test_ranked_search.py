"""Ranked search against a plain count of every document, on odd input, and past its bounds for sending."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import ranking


def words(t):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    cut = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in cut), sum(c.total() for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in cut:
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + (50 * c.total() * n_docs) // total
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def drawn():
    """Zipf-like words, copies, ties, and documents that share one very frequent word."""
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(["The", *(word() for _ in range(rng.randint(0, 60)))])) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)] + [(7, docs[7][1]), (2000, None), (2001, ""), (2002, "?!"), (2003, "word " * 50_000)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30))) + ", the WORD") for i in range(25)]
    return docs, items + [(25, None), (26, "..."), (27, "absent"), (None, "the"), (3, "the second row of an item w1"), (4, items[4][1])]


@pytest.mark.parametrize("bounds", [{}, {"sent_terms": 0}, {"sent_items": 0}, {"sent_terms": 0, "sent_items": 0}])
def test_matches_a_count_of_every_document(spark, drawn, monkeypatch, bounds):
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 64)
    monkeypatch.setattr(ranking, "ITEM_ROWS", 4)
    docs, items = tables(spark, *drawn)
    want = brute(*drawn, 10)
    assert rows(ranking.search(docs, items, 10, **bounds)) == want and len(want) > 200


def test_a_block_ends_at_its_postings(spark, drawn, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_POSTINGS", 20)
    assert rows(ranking.search(*tables(spark, *drawn), 3)) == brute(*drawn, 3)


def test_accumulators_stop_and_stay_exact():
    """Random lists: the k best agree with full sums, though late terms open no accumulator."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        size, k = int(rng.integers(1, 200)), int(rng.integers(1, 12))
        lists, full = [], np.zeros(size, np.int64)
        for t in range(int(rng.integers(1, 9))):
            docs = np.flatnonzero(rng.random(size) < min(1.0, 0.03 * 2**t))
            s = rng.integers(0, 1 << max(1, 12 - 2 * t), len(docs))
            lists.append((docs, s))
            full[docs] += s
        found, scores = ranking.best_of_block(lists, size, k)
        assert (full[found] == scores).all() and (scores > 0).all()
        order = [int(i) for i in np.lexsort((np.arange(size), -full)) if full[i] > 0][:k]
        assert [int(found[i]) for i in np.lexsort((found, -scores))][:k] == order


def test_late_common_terms_make_no_accumulators():
    rare, common = (np.arange(3), np.array([100, 90, 80])), (np.arange(1000), np.full(1000, 5))
    found, scores = ranking.best_of_block([rare, common], 1000, 3)
    assert found.tolist() == [0, 1, 2] and scores.tolist() == [105, 95, 85]
    # A tie with the k-th is still possible, so all are made.
    found, _ = ranking.best_of_block([(np.arange(1), np.array([5])), common], 1000, 1)
    assert found.tolist() == [0]
    found, _ = ranking.best_of_block([(np.array([9]), np.array([5])), (np.arange(9), np.full(9, 5))], 10, 1)
    assert found.tolist() == list(range(10))


def test_nulls_empty_tables_and_clashing_columns(spark):
    docs = [(None, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (0, None)]
    items = [(0, "Alpha")]
    d, i = tables(spark, docs + [(5, "gamma"), (6, "delta")], items)
    clash = [F.lit("x").alias(c) for c in ("key", "block", "score", "rank", "number", "term", "first")]
    got = ranking.search(d.select("*", *clash), i.select("*", *clash), 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, None, None] and len({r.score for r in got}) == 1
    assert ranking.search(d, i.where("false")).count() == 0 and ranking.search(d.where("false"), i).count() == 0
    assert ranking.search(d, i).columns == ["item_id", "rank", "doc_id", "score"]
