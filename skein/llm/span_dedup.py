"""Repeated passages by sliding runs of sentences.

A passage is 2 sentences or more with at least ``MIN_WORDS`` words together, or one sentence of at
least ``LONE_WORDS``. From every sentence the shortest such run is hashed, and up to every sentence the
shortest one that ends there, however many sentences it takes; a longer passage is covered by these, and
repeated where they all are. All runs meet by hash; the first occurrence, by document id and position,
stays, and sentences under any later one go.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from skein.llm.common import fresh, quoted, small_batches
from skein.session import ensure_checkpoint_dir, reliable

MIN_RUN, MIN_WORDS, LONE_WORDS = 2, 15, 50
#: Hashes of more than this share of all runs, and of more than HOT_ROWS of them, are joined without a shuffle.
FREQUENT, HOT_ROWS = 1 << 12, 1 << 14
_NO_ID = (1 << 63) - 1
#: A sentence ends with its marks and the space after them, or with its line.
_END = re.compile(r"[.!?]+\s+|\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, the mark and space that end it included; all of the text together."""
    cuts = [m.end() for m in _END.finditer(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    out = [(a, b) for a, b in zip([0, *cuts], cuts)]
    return [x for x in out if x[0] < x[1]]


def runs(text: str, min_run: int = MIN_RUN, min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS) -> Iterator[tuple[bytes, int, int]]:
    """(hash, first sentence, last sentence exclusive) of each run."""
    bare = [text[a:b].strip() for a, b in sentences(text)]
    keys = [xxhash.xxh3_128_digest(s.encode("utf-8", "replace")) for s in bare]
    total = [0]
    for s in bare:
        total.append(total[-1] + len(s.split()))
    i = shortest = 0
    for j in range(1, len(bare) + 1):
        if total[j] - total[j - 1] >= lone_words:
            yield xxhash.xxh3_128_digest(keys[j - 1]), j - 1, j
        # the shortest runs from the sentences for which j is the first end that is long enough
        while i + min_run <= j and total[j] - total[i] >= min_words:
            yield xxhash.xxh3_128_digest(b"".join(keys[i:j])), i, j
            i += 1
            shortest = j
        # the shortest run up to j, unless it was among them
        if i and shortest < j:
            yield xxhash.xxh3_128_digest(b"".join(keys[i - 1 : j])), i - 1, j


def all_runs(docs: DataFrame, doc_id: str, text: str, min_run: int, min_words: int, lone_words: int) -> DataFrame:
    """(id, text_key, a, b, first, last): a row for each run of each document; a and b are its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (c.to_pylist() for c in batch.columns)
            lo = 0
            while lo < len(texts):
                out: list[list] = [[] for _ in range(6)]
                while lo < len(texts) and len(out[0]) < 1 << 16:
                    for h, i, j in runs(texts[lo] or "", min_run, min_words, lone_words):
                        for column, x in zip(out, (ids[lo], keys[lo], int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), i, j)):
                            column.append(x)
                    lo += 1
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "text_key", "a", "b", "first", "last"])

    rows = small_batches(docs).select(F.coalesce(quoted(doc_id), F.lit(_NO_ID)), F.xxhash64(quoted(text)), quoted(text))
    return rows.mapInArrow(run, "id bigint, text_key bigint, a bigint, b bigint, first int, last int")


def frequent(found: DataFrame, rows: int) -> DataFrame:
    """(a): first halves of hashes that may hold more than 1/FREQUENT of all rows; at most FREQUENT of them.

    From a sketch of FREQUENT * 16 counters, whose error is a fourth of that share: what is more frequent is
    never missing. A rare one among them does no harm, since the list decides only where rows meet. Sketches
    (1 MB at most) are merged in two steps, so that no task reads those of all tasks. The second step has a
    constant key: without keys, a task without sketches would have to write one of no type, and fails.
    """
    if rows <= FREQUENT:  # no task could be given too much
        return found.select("a").limit(0)
    teams = math.isqrt(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    size = FREQUENT * 16
    teamed = found.select("a", F.spark_partition_id().alias("part")).select("a", F.pmod("part", F.lit(teams)).alias("team"))
    sketches = teamed.groupBy("team").agg(F.expr(f"approx_top_k_accumulate(a, {size})").alias("sketch"))
    whole = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {size})").alias("sketch"))
    top = whole.select(F.expr(f"approx_top_k_estimate(sketch, {FREQUENT})").alias("top"))
    return top.select(F.explode("top").alias("top")).where(F.col("top")["count"] > max(HOT_ROWS, rows // FREQUENT)).select(F.col("top")["item"].alias("a"))


def later_ones(found: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of ``found`` that are not the first of their hash, with the ``origin`` that is.

    Rows of ordinary hashes are shuffled once and see their first in a window, which spills. Rows of frequent
    hashes stay where they are: their first, a minimum combined before the shuffle, is sent to all tasks, as
    there are at most FREQUENT of them (times the hashes that agree in their first 64 bits).
    """
    place = F.struct("id", "text_key", "first")
    own = Window.partitionBy("a", "b")
    cold = found.join(F.broadcast(hot), "a", "left_anti").withColumn("origin", F.min(place).over(own))
    often = found.join(F.broadcast(hot), "a", "left_semi")
    first = often.groupBy("a", "b").agg(F.min(place).alias("origin"))
    return cold.unionByName(often.join(F.broadcast(first), ["a", "b"])).where(F.col("origin") != place)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN, min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """(id, text_key, spans, first_ids): per document the runs that are not the first of their kind.

    Texts are cut once; their runs are written to the checkpoint folder as Parquet, where their hashes can
    be counted without the rest. A document's spans are no more than its runs.
    """
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/spans-{uuid.uuid4().hex}"
    all_runs(docs, doc_id, text, min_run, min_words, lone_words).write.parquet(path)
    found = spark.read.parquet(path)
    return later_ones(found, reliable(frequent(found, found.count()))).groupBy("id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("origin")["id"])).alias("first_ids"),
    )


def cut_spans(text: str | None, spans: list | None) -> tuple[str | None, int]:
    """The text without the sentences of the spans, and how many those are."""
    if text is None or not spans:
        return text, 0
    gone = {k for s in spans for k in range(s["first"], s["last"])}
    parts = [text[a:b] for i, (a, b) in enumerate(sentences(text)) if i not in gone]
    return "".join(parts), len(gone)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_removed: str = "n_removed", first_ids: str = "first_doc_ids", **rules) -> DataFrame:
    """Remove from every text the sentences under a run that occurs earlier.

    Earlier is by ``doc_id`` (null last), then the hash of the text, then position. Rows that agree
    in id and text are one document and come back alike, so a repeated row loses nothing to its
    twin. Null texts stay null; a text may become empty; an empty table gives an empty one. Adds the number of sentences removed and
    the ids of the documents that keep them. Other columns pass through.
    """
    i, k, spans, cut = fresh(docs, "span_id", "span_text", "span_list", "span_cut")
    found = repeats(docs, doc_id, text, **rules).select(
        F.col("id").alias(i), F.col("text_key").alias(k), F.col("spans").alias(spans), F.col("first_ids").alias(first_ids)
    )

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = [cut_spans(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())]
        kept, n = zip(*rows) if rows else ((), ())
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64())], ["text", "n"])

    run.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    edit = F.arrow_udf(run, "text string, n bigint").asNondeterministic()
    whole = docs.join(
        found, (F.coalesce(quoted(doc_id), F.lit(_NO_ID)) == F.col(i)) & (F.xxhash64(quoted(text)) == F.col(k)), "left"
    ).withColumn(cut, edit(quoted(text), F.col(spans)))
    own = [F.col(cut)["text"].alias(text) if c == text else quoted(c) for c in docs.columns]
    ids = F.transform(F.coalesce(F.col(first_ids), F.expr("cast(array() as array<bigint>)")), lambda x: F.when(x != _NO_ID, x))
    return whole.select(*own, F.col(cut)["n"].alias(n_removed), ids.alias(first_ids))
