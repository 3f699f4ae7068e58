"""Encoding and decoding against the library, on texts, random pieces, and ids of any kind."""

import hashlib
import random
from array import array

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from skein.llm import pieces
from skein.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def ours():
    return pieces.Pieces(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(names):
    rng = random.Random(1)
    out = [" ", "   ", "a\x00b<s>☃𝔘", "▁▁▁ ▁a", "\n\n \n", "a" * 400, "<0x0A>", "é" * 30, "👩‍👩‍👧", "\t\r\n", "ab" * 3000, "=" * 999, "𝔘" * 50, "﷐﻿�", " " * 500]
    for _ in range(3000):
        parts = [rng.choice(names) if rng.random() < 0.6 else rng.choice([" ", "▁", "\n", "x", "𝔘", "̀", "==", " a"]) for _ in range(rng.randint(1, 14))]
        out.append("".join(parts).replace("▁", rng.choice(["▁", " "])))
    return out + ["".join(rng.choice("ab  =-_/*.\t") for _ in range(rng.randint(1, 40))) for _ in range(2000)]


def test_encodes_like_the_library(ours, library):
    for t in texts(ours.names):
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert list(array("I", ours.encode(t))) == ids, repr(t)
        assert ours.decode(array("I", ids)) == library.decode(ids), repr(t)


def test_small_memories_change_nothing(ours, library, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNKS", 8)
    monkeypatch.setattr(pieces, "PAIRS", 8)
    fresh = pieces.Pieces(MODEL)
    for t in texts(ours.names)[::7]:
        assert list(array("I", fresh.encode(t, False, False))) == library.encode(t)
    assert len(fresh.chunks) <= 8 and len(fresh.pairs) <= 8


def test_decodes_any_ids_like_the_library(ours, library):
    rng = random.Random(2)
    some = [0xE2 + 3, 0x98 + 3, 0x83 + 3, 0xF0 + 3, 0xED + 3, 0xA0 + 3, 0x80 + 3]
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 259, 29871, rng.choice(some)]) for _ in range(rng.randint(0, 8))]
        assert ours.decode(array("I", ids)) == library.decode(ids), ids


def test_pairs_go_together_as_the_library_parts_them(ours, library):
    """A pair of pieces goes together just if their joint text yields them alone (texts without a space in front)."""
    rng = random.Random(3)
    names = [n for n, p in enumerate(ours.names) if not p.startswith("▁")]
    seen = set()
    for _ in range(4000):
        a, b = rng.choice(names), rng.choice(names)
        parts = library.encode("\n" + ours.names[a] + ours.names[b], out_type=str)[2:]  # after the first space and line break
        fits = ours.together(a, b)
        assert fits == (parts == [ours.names[a], ours.names[b]])
        seen.add(fits)
    assert seen == {True, False}


def test_query_matches_the_library(spark, folder, library):
    want = {}
    for i, t in duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        raw = b"".join(n.to_bytes(4, "little") for n in ids)
        want[i] = len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_sentencepiece_codec"](spark, folder).collect()} == want


def test_nulls_empty_tables_and_clashing_columns(spark, library):
    long = "Ein langer Text, " * 20_000
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (None, " a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    done = pieces.decode(pieces.encode(df, MODEL, out="codes"), MODEL, out="back", ids="codes")
    got = done.collect()
    assert done.columns == ["doc_id", "text", "ids", "codes", "back"] and [r.ids for r in got] == ["x"] * 5
    assert sorted(r.back for r in got) == sorted(["", "", long, long, " a"])
    assert {len(r.codes) for r in got if not r.text} == {8}
    replaced = pieces.encode(df, MODEL)
    assert replaced.columns == df.columns and dict(replaced.dtypes)["ids"] == "binary"
    assert pieces.encode(df.where("false"), MODEL).count() == 0
    bare = pieces.encode(df.where("doc_id = 2"), MODEL, out="codes", begin=False, end=False)
    assert bytes(bare.first().codes) == b"" and pieces.decode(bare, MODEL, ids="codes").first().decoded == ""
    assert pieces.decode(bare.withColumn("codes", F.lit(None).cast("binary")), MODEL, ids="codes").first().decoded is None
