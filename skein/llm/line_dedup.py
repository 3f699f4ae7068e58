"""Boilerplate lines by their share of a site's pages, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.common import fresh, quoted
from skein.session import reliable

MAX_RATIO = 0.05
MIN_PAGES = 5
#: Boilerplate lines of all hosts that may be broadcast together; more are joined by shuffle.
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """96 bits that stand for a line without the spaces around it."""
    return _bits(F.trim(line))


def _bits(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): per host the keys of lines on more than ``max_ratio`` of its pages.

    A page counts a line once, and pages of one text count once, so that whole copies of a page do not
    make its lines boilerplate. Counts are combined before the shuffle. A host has at most (mean
    lines of a page) / ``max_ratio`` such lines, however many pages it has, so its list is bounded.
    """
    rows = docs.select(
        host.alias("host"), _bits(F.coalesce(text, F.lit(""))).alias("body"),
        F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _key)).alias("keys"),
    )
    pages = rows.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (
        rows.select("host", "body", F.explode("keys").alias("key"))
        .distinct()
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
        .withColumnRenamed("host", "h")
    )
    return (
        counts.join(pages, F.col("h").eqNullSafe(F.col("host")))
        .where(F.col("n") / F.col("pages") > max_ratio)
        .groupBy("host")
        .agg(F.collect_list("key").alias("lines"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """Take from every text the lines on more than ``max_ratio`` of its host's pages.

    Pages of one text count once. Only lines on ``min_pages`` pages or more count, so that small hosts keep theirs. Blank lines
    stay. Lines are compared without the spaces around them. Null hosts form one host. A null text
    stays null and has no lines; a text of boilerplate alone becomes empty. Repeated rows all
    come back, each cut alike. Other columns pass through; ``text`` is replaced and the two
    counts are added under the given names.
    """
    found = reliable(boilerplate(docs, quoted(host), quoted(text), max_ratio, min_pages))
    lines = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    h, bad, all_lines, kept = fresh(docs, "bad_host", "bad_lines", "all_lines", "kept_lines")
    found = found.select(F.col("host").alias(h), F.col("lines").alias(bad))
    if lines <= broadcast_lines:
        found = F.broadcast(found)
    marked = docs.join(found, quoted(host).eqNullSafe(F.col(h)), "left").withColumn(all_lines, _lines(quoted(text)))
    marked = marked.withColumn(
        kept,
        F.when(F.col(bad).isNull(), F.col(all_lines)).otherwise(
            F.filter(all_lines, lambda x: ~F.array_contains(F.col(bad), _key(x)))
        ),
    )
    clean = F.when(F.size(kept) == F.size(all_lines), quoted(text)).otherwise(F.array_join(kept, "\n"))
    own = [clean.alias(text) if c == text else quoted(c) for c in docs.columns]
    total = F.coalesce(F.array_size(all_lines), F.lit(0))
    return marked.select(
        *own, total.cast("long").alias(n_lines), (total - F.coalesce(F.array_size(kept), F.lit(0))).cast("long").alias(n_dropped)
    )
