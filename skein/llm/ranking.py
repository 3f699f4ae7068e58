"""Ranked lexical search, term at a time with limited accumulators.

Documents are cut into terms once. What is kept of them are blocks: some thousand documents with the
occurrences of those terms that some query item has. Term statistics come from these blocks. Items are
packed into blocks as well, and each block of items meets each block of documents.

Where two blocks meet, an item's terms are taken rarest first. Each term adds its score to the
accumulators of the documents that hold it. New accumulators are made only while the terms still to come
could lift a document that has none yet to the k-th partial score; from then on only the accumulators
there are go on, to their exact scores. So the k best of a block are exact, and those of all blocks are
merged by score and id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.llm.common import LOWER_ASCII, as_bytes, quoted, small_batches
from skein.session import reliable
from skein.skew import salted_join

K = 50
#: A block of documents ends at either bound; one longer document is a block of its own.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 1 << 20
#: Items of a block.
ITEM_ROWS = 512
#: The terms of all items are sent to every task up to this many and this many bytes, else joined by shuffle.
SENT_TERMS, SENT_BYTES = 1_000_000, 32 << 20
#: Blocks of items are sent to every task up to this many bytes, else dealt.
SENT_ITEMS = 32 << 20
#: Tasks that share a block of items where these are dealt.
DEAL = 64

# ASCII letters and digits, and every byte of a longer UTF-8 sequence.
_TERM = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall

_DOCS = "first bigint, keys array<bigint>, lengths binary, terms binary, docs binary, counts binary"
_NO_COUNT = 0


def terms(text: bytes) -> list[bytes]:
    return _TERM(text.translate(LOWER_ASCII))


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term), each pair once; items without an id have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                own = sorted(set(terms(t)))
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])

    rows = items.where(quoted(item_id).isNotNull()).select(quoted(item_id).cast("long").alias("item_id"), quoted(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id bigint, term binary").distinct()


class _Block:
    """Documents on their way into a block of arrays."""

    def __init__(self):
        self.keys, self.lengths, self.terms, self.docs, self.counts = [], [], [], [], []

    def add(self, key: int | None, length: int, found: list[int], counts: list[int]) -> None:
        self.docs += [len(self.keys)] * len(found)
        self.terms += found
        self.counts += counts
        self.keys.append(key)
        self.lengths.append(length)

    def full(self) -> bool:
        return len(self.keys) >= BLOCK_DOCS or len(self.terms) >= BLOCK_POSTINGS

    def batch(self) -> pa.RecordBatch:
        """One row: postings by term, then document."""
        t, d, c = np.array(self.terms, np.int64), np.array(self.docs, np.int32), np.array(self.counts, np.int64)
        order = np.argsort(t, kind="stable")
        first = next((k for k in self.keys if k is not None), 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([first], pa.int64()), pa.array([self.keys], pa.list_(pa.int64())), pa.array([np.array(self.lengths, np.int64).tobytes()]),
                pa.array([t[order].tobytes()]), pa.array([d[order].tobytes()]), pa.array([c[order].tobytes()]),
            ],
            ["first", "keys", "lengths", "terms", "docs", "counts"],
        )


def _blocks(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """Blocks of documents with the terms in ``known``; one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = sent.value.get, _Block()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = terms(text)
                pairs = [(n, c) for t, c in Counter(words).items() if (n := number(t)) is not None]
                block.add(key, len(words), [n for n, _ in pairs], [c for _, c in pairs])
                if block.full():
                    yield block.batch()
                    block = _Block()
        if block.keys:
            yield block.batch()

    return small_batches(docs).mapInArrow(run, _DOCS)


def _joined_blocks(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """The same for any number of terms: occurrences meet their terms by a join that deals common terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for key, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                words = terms(text)
                # A term that stands for the document itself keeps those without any term of an item.
                for t, c in [(b"", _NO_COUNT), *Counter(words).items()]:
                    for column, value in zip(out, (row, key, len(words), t, c)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["row", "key", "length", "term", "tf"])

    held = reliable(docs.withColumn("row", F.monotonically_increasing_id()).select("key", "row", "text"))
    found = small_batches(held).mapInArrow(cut, "row bigint, key bigint, length bigint, term binary, tf bigint")
    own = found.where(F.octet_length("term") == 0).withColumn("number", F.lit(-1).cast("long"))
    held_by = salted_join(found.where(F.octet_length("term") > 0), numbered, ["term"], spread=["row"])
    rows = held_by.select("row", "key", "length", "number", "tf").unionByName(own.select("row", "key", "length", "number", "tf"))
    packed = rows.groupBy("row").agg(F.first("key").alias("key"), F.first("length").alias("length"), F.collect_list(F.struct("number", "tf")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for r in batch.to_pylist():
                pairs = [(p["number"], p["tf"]) for p in r["found"] if p["number"] >= 0]
                block.add(r["key"], r["length"], [n for n, _ in pairs], [c for _, c in pairs])
                if block.full():
                    yield block.batch()
                    block = _Block()
        if block.keys:
            yield block.batch()

    return packed.mapInArrow(run, _DOCS)


def _statistics(blocks: DataFrame) -> tuple[DataFrame, int, int]:
    """(number, df) of the terms of items, documents that have terms, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lengths, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.frombuffer(lengths, np.int64)
                number, df = np.unique(np.frombuffer(found, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[-2, -1, number].astype(np.int64)), pa.array(np.r_[(n > 0).sum(), n.sum(), df].astype(np.int64))], ["number", "df"]
                )

    counts = reliable(blocks.select("lengths", "terms").mapInArrow(run, "number bigint, df bigint").groupBy("number").agg(F.sum("df").alias("df")))
    totals = {r.number: r.df for r in counts.where("number < 0").collect()}
    return counts.where("number >= 0"), totals.get(-2, 0), totals.get(-1, 0)


def weight(df: Column, n: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (F.lit(2.0) * df + F.lit(1.0)))).cast("long")


def _pack_items(pairs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, ids, item, number, w): terms of a block's items, of each item by falling weight."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        ids, item = np.unique(part.column("item_id").to_numpy(), return_inverse=True)
        number, w = part.column("number").to_numpy(), part.column("w").to_numpy()
        order = np.lexsort((number, -w, item))
        return pa.table({
            "block": pa.array([part.column("block")[0].as_py()], pa.int64()), "ids": pa.array([ids.astype(np.int64).tobytes()]),
            "item": pa.array([item[order].astype(np.int64).tobytes()]), "number": pa.array([number[order].astype(np.int64).tobytes()]),
            "w": pa.array([w[order].astype(np.int64).tobytes()]),
        })

    rows = pairs.withColumn("block", F.expr(f"pmod(xxhash64(item_id), {n_blocks})"))
    return rows.groupBy("block").applyInArrow(run, "block bigint, ids binary, item binary, number binary, w binary")


def term_scores(tf: np.ndarray, m: np.ndarray, w: int) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def best_of_block(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the k best, with exact scores, from (documents, scores) of terms, rarest first.

    ``size`` is the number of documents of the block. All with a score of the k-th best are returned.
    """
    bounds = [int(s.max(initial=0)) for _, s in lists]
    rest = sum(bounds)
    total = np.zeros(size, np.int64)
    has = np.zeros(size, bool)
    made, open_ = 0, True
    for (docs, s), bound in zip(lists, bounds):
        # A document without an accumulator can reach ``rest`` at most.
        if open_ and made >= k:
            partial = total[has]
            open_ = rest >= np.partition(partial, made - k)[made - k]
        if open_:
            total[docs] += s
            has[docs] = True
            made = int(has.sum())
        else:
            held = has[docs]
            total[docs[held]] += s[held]
        rest -= bound
    found = np.flatnonzero(has & (total > 0))
    scores = total[found]
    if len(found) > k:
        kept = scores >= np.partition(scores, len(found) - k)[len(found) - k]
        found, scores = found[kept], scores[kept]
    return found, scores


def _rank_blocks(met: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): of each pair of blocks each item's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = np.int64
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                lengths, posted, docs, counts, ids, item, number, w = (
                    np.frombuffer(column[c][r].as_py(), t)
                    for c, t in (("lengths", long), ("terms", long), ("docs", np.int32), ("counts", long), ("ids", long), ("item", long), ("number", long), ("w", long))
                )
                keys = column["keys"][r].values
                missing = keys.is_null().to_numpy(zero_copy_only=False)
                order_by = keys.fill_null(0).to_numpy()
                m = 50 + (50 * lengths * n) // total
                begin, end = np.searchsorted(posted, number), np.searchsorted(posted, number, side="right")
                starts = np.searchsorted(item, np.arange(len(ids) + 1))
                items, picked, scores = [], [], []
                for i in range(len(ids)):
                    lists = []
                    for t in range(starts[i], starts[i + 1]):
                        if begin[t] < end[t]:
                            d = docs[begin[t] : end[t]]
                            lists.append((d, term_scores(counts[begin[t] : end[t]], m[d], w[t])))
                    found, s = best_of_block(lists, len(lengths), k)
                    best = np.lexsort((order_by[found], missing[found], -s))[:k]
                    items.append(np.full(len(best), ids[i]))
                    picked.append(found[best])
                    scores.append(s[best])
                at = np.concatenate(picked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(items)), keys.take(pa.array(at)), pa.array(np.concatenate(scores))], ["item_id", "doc_id", "score"]
                )

    return met.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", sent_terms: int = SENT_TERMS, sent_items: int = SENT_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, ties by ascending id.

    Every row of ``docs`` is a document; rows without an id count like others and come last among equals.
    Null and empty texts have no terms. Rows of ``items`` with one id are one item of all their terms, and
    rows without an id are none. Items without terms that documents hold, and empty tables, give no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(doc_id).cast("long").alias("key"), quoted(text).cast("string").alias("text"))
    pairs = reliable(item_terms(items, item_id, item_text))
    numbered = reliable(pairs.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    size = numbered.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
    if not size[0]:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if size[0] <= sent_terms and size[1] <= SENT_BYTES:
        blocks = _blocks(rows, {bytes(r.term): r.number for r in numbered.collect()})
    else:
        blocks = _joined_blocks(rows, numbered)
    blocks = reliable(blocks)
    df, n, total = _statistics(blocks)
    weighted = pairs.join(numbered, "term").join(df, "number").select("item_id", "number", weight(F.col("df"), n).alias("w"))
    n_items = pairs.agg(F.count_distinct("item_id")).first()[0]
    n_blocks = -(-n_items // ITEM_ROWS)
    packed = reliable(_pack_items(weighted, n_blocks))
    held = packed.agg(F.sum(F.octet_length("ids") + 3 * F.octet_length("item"))).first()[0] or 0
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>"))
    if held <= sent_items:
        met = blocks.withColumn("block", numbers).join(F.broadcast(packed), "block")
    else:
        # A task holds the rows of one block of items and the blocks of documents dealt to it, sorted by key.
        dealt = blocks.withColumn("share", F.pmod(F.xxhash64("first"), F.lit(DEAL))).withColumn("block", numbers)
        copies = packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)).cast("array<bigint>")))
        met = dealt.join(copies.hint("merge"), ["block", "share"])
    best = _rank_blocks(met, n, max(total, 1), k)
    last = F.col("doc_id").asc_nulls_last()
    for keys in (["item_id", F.pmod(F.xxhash64("doc_id"), F.lit(DEAL))], ["item_id"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), last)
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
