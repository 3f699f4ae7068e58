"""Polylines, critical points and grids taken from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.skew import rank_within

# Position of an event type on the third axis.
EVENT_LEVELS = {"click": 1.0, "error": 2.0, "purchase": 3.0, "signup": 4.0, "view": 5.0}
OTHER_LEVEL = 6.0
DAY_US = 86_400_000_000.0


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    level = F
    for kind, value in EVENT_LEVELS.items():
        level = level.when(F.col("event_type") == kind, F.lit(value))
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return read(spark, folder, "events").select(
        F.col("user_id").alias("line_id"),
        "ts",
        "event_id",
        (us / F.lit(DAY_US)).alias("x"),
        (F.col("value") / F.lit(10.0)).alias("y"),
        level.otherwise(OTHER_LEVEL).alias("z"),
    )


def event_points(spark: SparkSession, folder: str) -> DataFrame:
    """One line per user: days since 2024-01-01, value / 10, and the level of the event type."""
    return rank_within(_events(spark, folder), ["line_id"], ["ts", "event_id"]).select(
        "line_id", "pt_idx", "x", "y", "z"
    )


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    """One line per order: quantity / 10, price / 10000 and discount of its items."""
    cols = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    raw = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("line_id"), *cols)
    return rank_within(raw, ["line_id"], cols).select(
        "line_id",
        "pt_idx",
        (F.col("l_quantity") / F.lit(10.0)).alias("x"),
        (F.col("l_extendedprice") / F.lit(10000.0)).alias("y"),
        F.col("l_discount").alias("z"),
    )


def supplier_critical_points(spark: SparkSession, folder: str) -> DataFrame:
    """Critical points in the box of the event lines, one per supplier."""
    s = F.col("s_suppkey")
    return read(spark, folder, "supplier").select(
        s.alias("cp_id"),
        (F.pmod(s * 7, F.lit(31)).cast("double")).alias("x"),
        (F.abs("s_acctbal") / F.lit(250.0)).alias("y"),
        (F.col("s_nationkey") % 5 + 1).cast("double").alias("z"),
        (F.col("s_nationkey") % 8).cast("int").alias("type"),
        (F.lit(1.0) + s % 3).cast("double").alias("scale"),
    )


def event_dims(spark: SparkSession, folder: str) -> tuple[int, int, int]:
    """Unit cells from 0 that hold all event points: columns, rows, layers (at least one each)."""
    top = _events(spark, folder).agg(F.floor(F.max("x")) + 1, F.floor(F.max("y")) + 1, F.max("z")).first()
    return tuple(max(int(t or 1), 1) for t in top)


def event_grid(points: DataFrame) -> DataFrame:
    """Mean tangent of the event lines per unit cell; cells without an event are holes.

    ``points`` carries tx, ty, tz; the layers are the levels of the event types from 0.
    """
    return points.groupBy(
        F.floor("x").cast("int").alias("col"),
        F.floor("y").cast("int").alias("row"),
        F.floor(F.col("z") - 1).cast("int").alias("layer"),
    ).agg(F.avg("tx").alias("u"), F.avg("ty").alias("v"), F.avg("tz").alias("w"))
