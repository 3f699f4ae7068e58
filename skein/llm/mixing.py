"""Mixing sources to target weights with integer quotas of equal-token blocks (Sainte-Lague)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.llm.common import fresh, quoted

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK_TOKENS = 16
#: Tokens of a shard, at least; all sources together have at most MAX_SHARDS shards besides one each.
SHARD_TOKENS, MAX_SHARDS = 1 << 20, 20_000
#: Sources are names that a person weighs; a column with more values than this is no source.
MAX_SOURCES = 100_000
_STRIDE = 2654435761  # prime


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _strided(i: Column, total: Column) -> Column:
    """i * _STRIDE modulo ``total``, by 20 bits of ``i`` at a time, so that up to 2^42 blocks nothing overflows."""
    high = F.pmod(F.shiftright(i, 20) * F.lit(_STRIDE), total)
    return F.pmod(high * F.lit(1 << 20) + i.bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(_STRIDE), total)


def fill(sizes: Sequence[int], weights: Sequence[int], most: int = MAX_EPOCHS) -> list[float]:
    """Shares of the total size by weight, none above ``most`` times its size, the excess reshared."""
    full: set[int] = set()
    while True:
        left = sum(sizes) - sum(most * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        over = {i for i, w in enumerate(weights) if i not in full and left * w > most * sizes[i] * weight}
        if not over:
            return [float(most * s) if i in full else left * w / weight for i, (s, w) in enumerate(zip(sizes, weights))]
        full |= over


def apportion(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients vote / (2 * seats so far + 1); ties go to the earlier one.

    A divisor found by bisection gives nearly all seats at once, the heap only the last few.
    """
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    low, high = total / (seats + len(votes) + 1) / 4, total * 4
    for _ in range(80):
        mid = (low + high) / 2
        if sum(math.floor(v / mid + 0.5) for v in votes) <= seats:
            high = mid
        else:
            low = mid
    out = [math.floor(v / high + 0.5) for v in votes]
    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, out)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


@dataclass(frozen=True)
class Seed:
    """Draws that depend on the seed and the id alone (SQL can state them as well)."""

    value: int = 7

    def text(self, use: str, *parts: Column) -> Column:
        given = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
        return F.md5(F.concat_ws(":", F.lit(str(self.value)), F.lit(use), *given))

    def number(self, use: str, *parts: Column) -> Column:
        return F.conv(F.substring(self.text(use, *parts), 1, 8), 16, 10).cast("long")


def shards(words: int, shard_tokens: int, per_shard_at_least: int) -> int:
    return max(1, -(-words // max(shard_tokens, per_shard_at_least)))


def take(
    docs: DataFrame,
    size: str,
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    seed: Seed = Seed(),
    names: Sequence[str] = ("source_size", "target", "taken", "epochs", "blocks"),
) -> DataFrame:
    """Add what the mix takes of every document, whose words the column ``size`` counts.

    Sources in code-point order, null last, weigh ``weights`` in turn and share as many tokens as
    there are. A source's target (``fill``) becomes blocks of ``block_tokens`` tokens by highest
    quotients among sources. A source of more than ``shard_tokens`` tokens is dealt to shards by seeded
    draws from id and size, and its blocks are apportioned among them by highest quotients of their
    sizes, so each shard has an integer quota. A shard lays its documents end to end in seeded order
    and cuts them into blocks; its quota is whole passes over all of them and a seeded choice of blocks
    for the rest, never more than 3 passes. A hot source has more shards, not larger ones; rows of one
    id, or of none, are spread by their sizes.

    Adds, under ``names``: the source's size and target, the tokens taken of the document (repeats
    counted), the passes over all its words, and the runs of words (first, last exclusive) taken once
    more. Documents without words are taken 0 times. Repeated rows are documents of their own; rows
    that agree in id and size may swap what is taken of them. An empty table gives an empty one. Nothing but the sizes of sources and
    shards passes through the driver, at most ``MAX_SOURCES`` + ``MAX_SHARDS`` rows. ``docs`` is read three
    times. Other columns pass through.
    """
    spark = docs.sparkSession
    src, n_shards, shard_src, held_shard, shard, held, quota, start, epochs, rest, total = fresh(
        docs.select("*", *[F.lit(0).alias(x) for x in names]),
        "src", "n_shards", "shard_src", "held_shard", "shard", "shard_size", "quota", "start", "passes", "rest", "total_blocks",
    )
    found = docs.groupBy(quoted(source).alias("s")).agg(F.sum(size).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.s is None, (r.s or "").encode("utf-8", "surrogatepass")))
    sizes = [r.n or 0 for r in found]
    targets = fill(sizes, [weights[i % len(weights)] for i in range(len(found))])
    seats = apportion(targets, math.floor(sum(sizes) / block_tokens + 0.5))
    least = -(-sum(sizes) // MAX_SHARDS)
    kinds = spark.createDataFrame(
        [(r.s, s, t, shards(s, shard_tokens, least)) for r, s, t in zip(found, sizes, targets)],
        "s string, n bigint, t double, shards bigint",
    ).select(F.col("s").alias(src), F.col("n").alias(names[0]), F.col("t").alias(names[1]), F.col("shards").alias(n_shards))
    # the first 32 bits of the text that the order goes by, so shards are ranges of the order
    drawn = ("order", quoted(doc_id), F.col(size))
    dealt = docs.join(F.broadcast(kinds), quoted(source).eqNullSafe(F.col(src)), "left").withColumn(
        shard, F.shiftright(seed.number(*drawn) * F.col(n_shards), 32)
    )

    sized: dict = {}
    for r in dealt.groupBy(quoted(source).alias("s"), F.col(shard).alias("k")).agg(F.sum(size).alias("n")).collect():
        sized.setdefault(r.s, []).append((r.k, r.n or 0))
    rows = []
    for r, blocks in zip(found, seats):
        mine = sorted(sized.get(r.s, []))
        for (k, n), b in zip(mine, apportion([n for _, n in mine], blocks)):
            rows.append((r.s, k, n, min(b * block_tokens, n * MAX_EPOCHS)))
    quotas = spark.createDataFrame(rows, "s string, k bigint, n bigint, q bigint").select(
        F.col("s").alias(shard_src), F.col("k").alias(held_shard), F.col("n").alias(held), F.col("q").alias(quota)
    )
    dealt = dealt.join(F.broadcast(quotas), F.col(src).eqNullSafe(F.col(shard_src)) & (F.col(shard) == F.col(held_shard)), "left")

    tokens = F.col(held)
    w = Window.partitionBy(src, shard).orderBy(seed.text(*drawn), quoted(doc_id), F.col(size))
    laid = (
        dealt.withColumn(start, F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
        .withColumn(epochs, F.when(tokens > 0, F.floor(F.col(quota) / F.greatest(tokens, F.lit(1)))).otherwise(0).cast("long"))
        .withColumn(rest, F.floor((F.col(quota) - F.col(epochs) * tokens) / block_tokens + 0.5).cast("long"))
        .withColumn(total, F.ceil(tokens / block_tokens).cast("long"))
    )
    first = F.floor(F.col(start) / block_tokens).cast("long")
    last = F.floor((F.col(start) + F.col(size) - 1) / block_tokens).cast("long")
    chosen = F.when((F.col(size) > 0) & (F.col(rest) > 0), F.filter(
        F.sequence(first, F.greatest(first, last)), lambda i: _strided(i, F.col(total)) < F.col(rest)
    ))
    runs = F.transform(chosen, lambda i: F.struct(
        F.greatest(i * block_tokens - F.col(start), F.lit(0)).cast("long").alias("first"),
        F.least((i + 1) * block_tokens - F.col(start), F.col(size)).cast("long").alias("last"),
    ))
    laid = laid.withColumn(names[4], F.coalesce(runs, F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)")))
    once = F.aggregate(names[4], F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return laid.withColumn(names[3], F.col(epochs)).withColumn(
        names[2], (F.col(epochs) * F.col(size) + once).cast("long")
    ).select(*[quoted(c) for c in docs.columns], *names)
