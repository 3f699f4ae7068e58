"""Each text operator against brute force, and on nulls, empties, repeats, ties and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from check import connect, differences
from skein.llm import (
    decontaminate, language_id, line_dedup, mixing, revisits, secrets, simhash, span_dedup, topk, toxicity,
)
from skein.llm.common import drawn, table
from skein.llm.components import components
from skein.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 50_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t ", "en", "a", 4), (None, "One two three. Four!", None, "a", 1),
    (4, "same text here\nand more", "en", "a", 5), (4, "same text here\nand more", "en", "a", 5), (5, LONG, "de", None, len(LONG)),
]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def corpus(folder):
    return duckdb.sql(f"select doc_id, text, lang, source from '{folder}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that operators use as names."""
    names = ["score", "fp", "component_id", "size", "passages", "language", "taken", "key", "h", "kept_lines", "span_cut"]
    return spark.createDataFrame(ODD, DOCS).withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, folder):
    got = QUERIES[name](spark, folder).toPandas()
    assert differences(got, connect(folder).execute(ORACLES[name]).df()) is None


# ------------------------------------------------------------------ toxicity


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity"](spark, folder).toPandas()
    labels = duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").df()
    assert len(got) == duckdb.sql(f"select count(*) from '{folder}/documents.parquet'").fetchall()[0][0]
    seen = got[got.held_out].merge(labels, on="doc_id")
    rank = seen.score.rank()
    pos = seen.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / pos.sum() / (~pos).sum()
    assert auc > 0.9
    assert seen[seen.predicted == 1].toxic.mean() > 0.9 and seen[pos].predicted.mean() > 0.6


def test_risk_climbs_back_where_positives_are_overfitted():
    rng = np.random.default_rng(0)
    pos, every = rng.normal(1, 1, (50, 30)), rng.normal(0, 1, (500, 30))
    w = toxicity._risk_steps(pos, every, 0.3)
    g = np.hstack([every, np.ones((500, 1))]) @ w
    p = np.hstack([pos, np.ones((50, 1))]) @ w
    assert np.logaddexp(0, g).mean() - 0.3 * np.logaddexp(0, p).mean() > -0.05
    assert np.isfinite(w).all() and p.mean() > g.mean()


def test_stems_belong_to_longer_words():
    data = b"abcde abcdef xabcdefgh abcdefz abcdefgh"
    hashed, start, end = decontaminate.Hasher()(data)
    found, word = toxicity.features(data, hashed, start, end)
    words = data.split()
    want = Counter((i, w[:n]) for i, w in enumerate(words) for n in toxicity.STEMS if len(w) > n)
    assert len(found) == len(words) + sum(want.values())
    groups = defaultdict(set)
    for h, i, key in zip(found[len(words):].tolist(), word[len(words):].tolist(), [w[:n] for n in toxicity.STEMS for w in words if len(w) > n]):
        assert words[i].startswith(key)
        groups[key].add(h)
    assert all(len(h) == 1 for h in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (None, 1), (6, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model, "tox").select("doc_id", "tox").collect()
    assert len(got) == len(ODD) and all(0 <= r.tox <= 1 for r in got)
    nothing = toxicity.fit(empty, labels)
    assert {r.tox for r in toxicity.score(odd, nothing, "tox").collect()} == {0.0}
    assert toxicity.score(empty, model, "tox").count() == 0


# ------------------------------------------------------------------ mixing


def test_apportion_gives_seats_by_highest_quotients():
    rng = random.Random(1)
    for _ in range(50):
        votes, seats = [rng.choice([0, 1, 5, rng.random() * 100]) for _ in range(rng.randint(1, 8))], rng.randint(0, 60)
        want = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.apportion(votes, seats) == want


def test_mix_meets_targets_over_shards(spark, corpus):
    docs = spark.createDataFrame([(i, len(t.split()), s) for i, t, _, s in corpus], "doc_id bigint, size bigint, source string")
    got = mixing.take(docs, "size", shard_tokens=2_000).toPandas()
    assert len(got) == len(corpus)
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), n=("size", "sum"), own=("source_size", "first"))
    assert (by.n == by.own).all() and ((by.taken - by.target).abs() <= 40 + 0.02 * by.target).all()
    assert (got.taken <= 3 * got["size"]).all()
    runs = got.blocks.map(lambda b: sum(x["last"] - x["first"] for x in b))
    assert (got.taken == got.epochs * got["size"] + runs).all()
    again = mixing.take(docs.repartition(7), "size", shard_tokens=2_000).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))


def test_targets_stop_at_three_times_the_source():
    assert mixing.fill([1, 100, 100], [1, 2, 3]) == [3.0, 79.2, 118.8]
    assert mixing.fill([0, 10], [1, 2]) == [0.0, 10.0] and mixing.fill([], []) == []


def test_mixing_edges(spark, odd, empty):
    sized = odd.drop("size").withColumn("words", mixing.word_count(F.col("text")))
    got = mixing.take(sized, "words", names=["a", "b", "c", "d", "e"]).collect()
    assert len(got) == len(ODD) and all(r.c <= 3 * r.words for r in got)
    assert mixing.take(empty.withColumn("words", F.lit(1).cast("long")), "words").count() == 0


# ------------------------------------------------------------------ decontamination


def brute_passages(texts, items, window=10):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for i, t in items:
        w = split(low(t))
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes, out = {len(k) for k in windows}, []
    for t in texts:
        w, hit, found = split(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), digest, bool(hit)))
    return out


def test_decontamination_matches_brute_force(spark, folder, corpus):
    items = duckdb.sql(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op3_decontamination"](spark, folder).collect()}
    want = brute_passages([t for _, t, _, _ in corpus], items)
    assert [got[i] for i, *_ in corpus] == want and any(w[4] for w in want)


def test_decontamination_in_passes_and_edges(spark, odd, empty):
    rng = random.Random(2)
    words = ["a", "b", "é", "C", "7"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", LONG]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 12, 0])] + [(3, "b-b"), (9, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, passages int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (5, 1000):
        found = decontaminate.find_passages(docs.drop("passages"), bench, "passages", pass_windows=limit)
        got = [tuple(r[1:]) for r in sorted(decontaminate.digest(found, "passages").collect())]
        assert got == brute_passages(texts, items)
    assert decontaminate.keep_clean(odd, bench.where("item_id = 7")).columns == odd.columns
    assert decontaminate.keep_clean(odd, bench.limit(0)).count() == len(ODD)
    assert decontaminate.keep_clean(empty, bench).count() == 0


def test_word_hashes_do_not_depend_on_pieces():
    text = " ".join(random.Random(4).choices(["ab", "c", "x" * 300_000, "dé"], k=60)).encode().translate(decontaminate._WORDS)
    h, s, e = decontaminate.Hasher()(text)
    words = text.split()
    assert [text[a:b] for a, b in zip(s, e)] == words
    assert len(dict(zip(words, h.tolist()))) == len(set(h.tolist())) == len(set(words))


# ------------------------------------------------------------------ languages


def test_language_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op4_language_id"](spark, folder).toPandas()
    known = duckdb.sql(f"select doc_id, lang from '{folder}/documents.parquet'").df()
    seen = got[got.held_out].merge(known, on="doc_id")
    assert len(got) == len(known) and (seen.lang == seen.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.02


def test_language_edges(spark, odd, empty):
    model = language_id.fit(odd, F.lit(True))
    got = {(r.doc_id, r.who.lang_pred, r.who.rejected) for r in language_id.identify(odd, model, out="who").select("doc_id", "who").collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True)} <= got and (5, "de", False) in got
    assert language_id.keep_identified(odd).columns == odd.columns
    nothing = language_id.fit(empty, F.lit(True))
    assert {r.who.lang_pred for r in language_id.identify(odd, nothing, out="who").select("who").collect()} == {"und"}
    assert language_id.keep_identified(empty).count() == 0


# ------------------------------------------------------------------ near duplicates


def brute_classes(rows):
    prints = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(t)) if x]
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(len(w) - 2, 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    fp = np.array(prints, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    comp = np.array([i for i, _ in rows])
    while (new := np.array([comp[n].min() for n in near])).tolist() != comp.tolist():
        comp = new
    return {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, prints, comp.tolist())}


def test_near_duplicates_match_brute_force(spark, folder, corpus):
    got = {r[0]: (r[1], r[2]) for r in QUERIES["op5_simhash_near_dedup"](spark, folder).collect()}
    assert got == brute_classes([(i, t) for i, t, _, _ in corpus])


@pytest.mark.parametrize("shard_rows,task_rows,sample,leaf_pairs", [
    (8192, 16384, 20_000, 1 << 16), (20, 10, 20_000, 1 << 16), (10, 20, 64, 16), (5, 5, 1, 1),
])
def test_links_connect_what_is_near(spark, monkeypatch, shard_rows, task_rows, sample, leaf_pairs):
    """Dense clusters, chains and equal halves, with whole and split shards, trees deeper than their sample and tiny leaves."""
    monkeypatch.setattr(simhash, "LEAF_PAIRS", leaf_pairs)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(300)}
    for base in list(values)[:20]:
        for _ in range(15):
            for _ in range(rng.randint(1, 4)):
                base ^= 1 << rng.randrange(64)
            values.add(base)
    values |= {(7 << 32) | rng.getrandbits(6) for _ in range(60)} | {0, 2**64 - 1}
    fp = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    want = np.arange(len(fp))
    while (new := np.array([want[n].min() for n in near])).tolist() != want.tolist():
        want = new
    signed = fp.view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(3)
    roots = dict(components(simhash.links(df, shard_rows=shard_rows, task_rows=task_rows, sample=sample)).collect())
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(roots.get(x, x), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.tolist()))


def test_trees_go_on_below_their_sample():
    """Every fingerprint has one shard of its own, shards shrink with depth, and near halves are met."""
    rng = np.random.default_rng(3)
    halves = rng.integers(0, 2**32, 20_000, dtype=np.uint32)
    tree = simhash.grow(halves[:64], 4)
    leaves = [leaf for leaf, _, _ in simhash.visits(tree, halves, 0)]
    deeper = {leaf: 5 for leaf in leaves[1:]}
    at, shard, own = simhash.places(tree, deeper, halves, 0)
    assert own.all() and sorted(at.tolist()) == list(range(len(halves)))
    home = dict(zip(at.tolist(), shard.tolist()))
    sizes = Counter(s for s in home.values() if s >> simhash._BELOW != leaves[0])
    assert len(sizes) == 32 * len(deeper) and max(sizes.values()) < 1000
    moved = halves ^ (np.uint32(1) << rng.integers(0, 32, len(halves), dtype=np.uint32))
    at, shard, own = simhash.places(tree, deeper, moved, 1)
    assert np.bincount(at[own], minlength=len(halves)).tolist() == [1] * len(halves)
    met = set(zip(at.tolist(), shard.tolist()))
    assert all(x in met for x in home.items())


def test_draw_is_the_smallest_hashes(spark):
    rows = spark.range(5_000).withColumnRenamed("id", "x")
    deal = F.xxhash64("x")
    want = [r.x for r in rows.orderBy(deal, "x").limit(50).collect()]
    assert [r.x for r in drawn(rows, deal, 50, 5_000).collect()] == want
    assert drawn(rows, deal, 10_000, 5_000).count() == 5_000 and drawn(rows.limit(0), deal, 5, 0).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 150)}}


def test_near_duplicate_edges(spark, odd, empty):
    got = [(r.doc_id, r.component_id) for r in simhash.classes(odd).collect()]
    assert len(got) == len(ODD) and {(1, 1), (2, 1), (3, 1), (None, None)} <= set(got) and Counter(got)[(4, 4)] == 2
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5]
    assert simhash.classes(empty).count() == 0 and simhash.keep_first(empty).count() == 0


# ------------------------------------------------------------------ top k


def brute_top(rows, k):
    out = []
    for q, qv in rows:
        if q % 50:
            continue
        best = sorted(((-sum(int(a) * int(b) for a, b in zip(qv, v)), i) for i, v in rows if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bins", [2, 64, 1024])
def test_top_k_with_ties_and_blocks(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "QUERY_BLOCKS", 2)
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(rng.choice([2, 3]))]) for i in range(300)] + [(i, [1.0, 1.0]) for i in range(300, 420)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.search(df, F.pmod("vec_id", F.lit(50)) == 0, bins=bins, query_rows=3, candidate_rows=37).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, 5)


def test_top_k_edges(spark):
    rows = [(0, [1.5, None]), (50, None), (100, [1.0, 2.0]), (150, [float("nan")]), (None, [1.0]), (3, [1e18, 1e18]), (4, []), (4, [0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(9))
    whole = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.scaled(F.col("embedding")).alias("embedding"))
    got = topk.search(whole, F.pmod("vec_id", F.lit(50)) == 0).collect()
    assert [tuple(r)[:3] for r in sorted(got)] == [(100, 1, 3), (100, 2, 4), (100, 3, 4)]
    assert topk.search(whole.limit(0), F.lit(True)).count() == 0
    top = topk.scores(np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 1.0]]))
    assert top[0, 0] == 2**63 - 1


# ------------------------------------------------------------------ secrets


def brute_base(t):
    t = t or ""
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_base_spans_match_brute_force(spark, folder, corpus):
    rng = random.Random(7)
    made = ["".join(rng.choice(["password", "Api_Key", "ſecret", "toKen", "=", ": ", '"', "AKIA", "A1", "deadbeef", "0f", "é", " ", "\n", "x.y-"]) for _ in range(40)) for _ in range(300)]
    for t in [t for _, t, _, _ in corpus] + made:
        assert [s for s in secrets.find(t) if s[0] in secrets.KINDS[:3]] == brute_base(t)
    got = {r.doc_id: r for r in QUERIES["op7_secret_scan"](spark, folder).collect()}
    for i, t, _, _ in corpus:
        base = brute_base(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(b[0] == k for b in base) for k in secrets.KINDS[:3])


def test_weak_parts_need_their_complement():
    ident, key, end = "ASIAX7EXAMPLE42Q", "wJalrXUtnFEMIk7MDENGbPxRfiCYEX0MPLEKEY12", "https://store.example.org/bucket"
    kinds = lambda t: [s[0] for s in secrets.find(t)]
    assert kinds(f"{ident} then {key} at {end}") == ["weak_id", "weak_secret", "endpoint"]
    assert kinds(f"{ident} and {end}") == kinds(f"{key} and {end}") == kinds(end) == []
    assert kinds(f"{ident} " + "pad " * 100 + key) == []
    assert kinds(f"{ident} token={'a' * 12}") == ["weak_id", "assign"]
    spans = [(a, a + 1 + a % 7) for a in range(0, 300, 11)]
    near = secrets.Near(spans)
    for a in range(0, 320, 3):
        for gap in (-1, 0, 4):
            assert near.within(a, a + 2, gap) == any(s <= a + 2 + gap and e >= a - gap for s, e in spans)


def test_secret_edges(odd, empty):
    got = secrets.digest(secrets.scan(odd, "found"), "found").collect()
    assert len(got) == len(ODD) and {r.n_hex for r in got} == {0} and {r.spans for r in got} == {""}
    assert secrets.scan(empty, "found").count() == 0


# ------------------------------------------------------------------ repeated passages


def brute_cut(rows, min_words=span_dedup.MIN_WORDS, lone_words=span_dedup.LONE_WORDS):
    """Every run of sentences that is long enough, in order of document and position, whatever its length.

    A run is two sentences or more with ``min_words`` words, or one with ``lone_words``. Runs are told
    apart by a tree of sentences.
    """
    tree, first, out = {}, {}, {}
    for i, t in sorted(rows):
        parts = span_dedup.sentences(t or "")
        bare, gone = [t[a:b].strip() for a, b in parts], set()
        for k in range(len(bare)):
            node, words, end = 0, 0, k
            for j in range(k, len(bare)):
                node = tree.setdefault((node, bare[j]), len(tree) + 1)
                words += len(bare[j].split())
                if words >= (lone_words if j == k else min_words) and first.setdefault(node, (i, k)) != (i, k):
                    end = j + 1
            gone |= set(range(k, end))
        out[i] = "".join(t[a:b] for j, (a, b) in enumerate(parts) if j not in gone) if t is not None else None
    return out


def test_span_dedup_matches_brute_force(spark, folder, corpus):
    got = {r.doc_id: r.text for r in QUERIES["op8_span_dedup"](spark, folder).collect()}
    want = brute_cut([(i, t) for i, t, _, _ in corpus])
    assert got == want and any(want[i] != t for i, t, _, _ in corpus)


def test_span_dedup_edges(spark, odd, empty):
    passage = "".join(f"Sentence {k} has a few words of its own. " for k in range(8))
    rows = [(1, f"Intro. {passage}End."), (2, f"Other start! {passage}Other end."), (3, f"{passage}Mid.\n{passage}"), (4, "A. B. C. D. A. B. C. D.")]
    got = {r.doc_id: r for r in span_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "Other start! Other end." and got[3].text == "Mid.\n" and got[4].text == rows[3][1]
    assert got[2].first_doc_ids == [1] and got[1].n_removed == 0 and got[3].n_removed == 16
    back = span_dedup.drop_repeats(odd)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(r[:2] for r in ODD)
    assert span_dedup.drop_repeats(empty).count() == 0
    assert "".join("a. b!\n\nc? d"[x:y] for x, y in span_dedup.sentences("a. b!\n\nc? d")) == "a. b!\n\nc? d"


# ------------------------------------------------------------------ lines


@pytest.mark.parametrize("limit", [0, 200_000])
def test_lines_by_share_of_a_site(spark, limit):
    rows = [(i, f"own {i}\nfooter \n\nfooter\nrare {i % 40}", None, "a", 0) for i in range(100)]
    rows += [(1000 + i, f"footer\nhere {i}", None, None, 0) for i in range(4)] + [(2000 + i, "null site", None, None, 0) for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOCS), broadcast_lines=limit).collect()}
    assert got[5].text == "own 5\n\nrare 5" and (got[5].n_lines, got[5].n_dropped) == (5, 2)
    assert got[1001].text == "footer\nhere 1" and got[2003].text == "null site"


def test_copies_of_a_page_keep_their_lines(spark):
    """Six whole copies among a hundred pages: their body stays, the line of the template goes."""
    rows = [(i, f"own {i}\nfooter", "en", "a", 0) for i in range(94)] + [(500 + i, "body one\nbody two\nfooter", "en", "a", 0) for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOCS)).collect()}
    assert {got[500 + i].text for i in range(6)} == {"body one\nbody two"} and got[3].text == "own 3"
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.dedup_documents(spark, corpus_pipeline.dedup_lines(spark, docs, ""), "").collect()
    assert [r.doc_id for r in kept if r.text == "body one\nbody two"] == [500]


def test_line_edges(odd, empty):
    got = line_dedup.drop_boilerplate(odd, n_lines="a", n_dropped="b")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(r[:2] for r in ODD)
    assert line_dedup.drop_boilerplate(empty).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------------ revisits


def brute_found(rows):
    out = {}
    for i, key, ts, full in rows:
        if not full:
            before = [(t, j) for j, k, t, f in rows if f and k == key and t < ts]
            out[i] = max(before)[1] if before else None
    return out


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_latest_earlier_response_over_partitions(spark, parts):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "c", "d"]), rng.randint(0, 40), rng.random() < 0.15) for i in range(400)]
    df = spark.createDataFrame([(i, k, t, f, "e", None) for i, k, t, f in rows], "record_id bigint, key string, ts bigint, full boolean, etag string, modified string")
    got = {r.record_id: r.found and r.found["record_id"] for r in revisits.latest_earlier(df, parts).collect()}
    assert got == brute_found(rows)


def test_revisit_states_and_headers(spark):
    kind = "record_id bigint, url string, ts bigint, kind string, headers map<string,string>, payload string, state string"
    full = {"ETag": '"v1"', "Content-Length": "5", "X": "old", "Last-Modified": "mon"}
    rows = [
        (1, "http://A.org:80", 10, "response", full, "body", ""), (1, "http://A.org:80", 10, "response", full, "body", ""),
        (2, "http://a.org/#x", 20, "revisit", {"etag": 'W/"v1"', "x": "new", "Content-Length": "0", "Y": "z"}, None, ""),
        (3, "http://a.org/", 20, "revisit", {"ETag": '"v2"'}, None, ""), (4, "http://a.org/", 20, "revisit", None, None, ""),
        (5, "http://a.org/", 20, "revisit", {"last-modified": "mon"}, None, ""), (6, "http://a.org/", 10, "revisit", {"ETag": '"v1"'}, None, ""),
        (7, None, 20, "revisit", {}, None, ""), (None, "http://a.org/", None, "revisit", {}, None, ""), (8, "HTTPS://B.org:443/p?q#f", 1, "metadata", {}, "m", ""),
    ]
    got = [r for r in revisits.resolve(spark.createDataFrame(rows, kind)).collect()]
    by = {r.record_id: r for r in got}
    assert len(got) == len(rows)
    assert {k: r.state for k, r in by.items()} == {1: "full", 2: "resolved", 3: "mismatch", 4: "no_validator", 5: "resolved", 6: "no_response", 7: "no_response", None: "no_response", 8: "no_response"}
    assert dict(by[2].headers) == {"content-length": "5", "etag": 'W/"v1"', "last-modified": "mon", "x": "new", "y": "z"} and by[2].payload == "body"
    assert by[5].response_id == 1 and by[3].payload is None and by[8].url == "https://b.org/p?q"
    assert revisits.resolve(spark.createDataFrame([], kind)).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_matches_brute_force(spark, folder, corpus):
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs, ~language_id.held_out("doc_id"))
    coders = language_id._coders(model)
    kept = [r for r in corpus if not language_id.decide(r[1], model, coders, language_id.MIN_MARGIN)[2]]
    bodies = {(s, t) for _, t, _, s in kept}
    pages, lines = Counter(s for s, _ in bodies), Counter()
    for s, t in bodies:
        lines.update({(s, x.strip(" ")) for x in t.split("\n")} - {(s, "")})
    bad = {k for k, n in lines.items() if n >= line_dedup.MIN_PAGES and n / pages[k[0]] > line_dedup.MAX_RATIO}
    kept = [(i, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad), s) for i, t, _, s in kept]
    classes = brute_classes([(i, t) for i, t, _ in kept])
    kept = [r for r in kept if classes[r[0]][1] == r[0]]
    items = duckdb.sql(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()
    kept = [r for r, d in zip(kept, brute_passages([t for _, t, _ in kept], items)) if not d[4]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    texts = {i: t for i, t, _ in kept}
    assert set(got) <= set(texts) and all(r.text == texts[i] and r.n_chars == len(r.text) for i, r in got.items())
    words = Counter()
    for i, t, s in kept:
        words[s] += len(t.split())
    for s in words:
        mine = [r for r in got.values() if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * mixing.BLOCK_TOKENS and mine[0].source_size == words[s]


def test_pipeline_stages_keep_columns(spark, odd, empty, folder):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() <= docs.count()
