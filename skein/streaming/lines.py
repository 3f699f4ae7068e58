"""Lines that arrive over time: growing bucket tables, neighbours of new points, fading opacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions.vec import Vec3
from skein.operators.lsh import BUCKET, LshIndex
from skein.operators.opacity import FADE, fade
from skein.operators.search import as_targets, nearest_per_line


def append_buckets(
    segments: DataFrame, index: LshIndex, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Hash a stream of segments (with cx, cy, cz) and add it to the bucket table at ``path``.

    Each batch has a folder of its own, so a batch that runs again replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        index.buckets(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        segments.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def bucket_mates(points: DataFrame, index: LshIndex, buckets: DataFrame) -> DataFrame:
    """Bucket of each arriving point with its numbers of segments and lines; stream-static."""
    filed = buckets.groupBy(*BUCKET).agg(
        F.count(F.lit(1)).alias("segments"), F.count_distinct("line_id").alias("lines")
    )
    return index.place(points, Vec3.of()).join(filed, BUCKET, "left")




def neighbours_of_stream(
    points: DataFrame, known: DataFrame, radius: float, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Edges from arriving points to the known lines within ``radius``, written batch by batch."""

    def search(batch: DataFrame, number: int) -> None:
        edges = nearest_per_line(batch, as_targets(known), radius)
        edges.withColumnRenamed("nbr_id", "nbr_pt").write.mode("overwrite").parquet(
            f"{path}/batch={number}"
        )

    return (
        points.writeStream.foreachBatch(search)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def fade_stream(
    targets: DataFrame,
    path: str,
    checkpoint: str,
    rate: float = FADE,
    **trigger,
) -> StreamingQuery:
    """Fade the opacity of every vertex a step towards the targets of each batch.

    ``targets`` has line_id, pt_idx and alpha, one row per vertex and batch. The state after batch
    n is the table ``path/state=n``; vertices without a target in a batch keep their value.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        key = ["line_id", "pt_idx"]
        wanted = batch.groupBy(*key).agg(F.max("alpha").alias("target"))
        if number == 0:
            state = wanted.select(*key, F.lit(0.0).alias("alpha"))
        else:
            state = spark.read.parquet(f"{path}/state={number - 1}")
        both = state.join(wanted, key, "full_outer")
        current = F.coalesce("alpha", F.lit(0.0))
        value = F.when(F.col("target").isNull(), current).otherwise(
            fade(current, F.col("target"), rate)
        )
        both.select(*key, value.alias("alpha")).write.mode("overwrite").parquet(
            f"{path}/state={number}"
        )

    return (
        targets.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


#: Vertices of a line whose opacities make one state.
STATE_CHUNK = 1 << 12


def faded(targets: DataFrame, rate: float = FADE, chunk: int = STATE_CHUNK) -> DataFrame:
    """(line_id, pt_idx, alpha, step) of the vertices that a batch has targets for; for streams.

    The opacities of ``chunk`` neighbouring vertices of a line are one keyed state, so the state is as large as
    the vertices seen and no larger after many batches, and a long line is spread over tasks. Of several
    targets of a vertex in one batch the highest counts; rows with a null target or place take no part. ``step``
    counts the batches that had targets for the vertex; its last row is its opacity now.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wanted = np.full(chunk, -np.inf)
        for pdf in frames:
            np.maximum.at(wanted, pdf["pt_idx"].to_numpy() % chunk, pdf["alpha"].to_numpy())
        hit = np.flatnonzero(wanted > -np.inf)
        alpha, steps = np.zeros(chunk), np.zeros(chunk, np.int64)
        if state.exists:
            at, held, count = (np.asarray(x) for x in state.get)
            alpha[at], steps[at] = held, count
        alpha[hit] += (wanted[hit] - alpha[hit]) * rate
        steps[hit] += 1
        at = np.flatnonzero(steps)
        state.update((at.tolist(), alpha[at].tolist(), steps[at].tolist()))
        yield pd.DataFrame({"line_id": key[0], "pt_idx": key[1] * chunk + hit, "alpha": alpha[hit], "step": steps[hit]})

    whole = targets.where(F.col("line_id").isNotNull() & F.col("pt_idx").isNotNull() & F.col("alpha").isNotNull())
    keyed = whole.select(
        F.col("line_id").cast("bigint"), F.floor(F.col("pt_idx") / F.lit(chunk)).cast("bigint").alias("part"),
        F.col("pt_idx").cast("bigint"), F.col("alpha").cast("double"),
    )
    return keyed.groupBy("line_id", "part").applyInPandasWithState(
        step, "line_id bigint, pt_idx bigint, alpha double, step bigint",
        "at array<int>, alpha array<double>, steps array<bigint>", "append", GroupStateTimeout.NoTimeout,
    )


def fade_changes(targets: DataFrame, path: str, checkpoint: str, rate: float = FADE, **trigger) -> StreamingQuery:
    """Write what ``faded`` yields to the table at ``path``, batch by batch; ``latest`` reads it."""
    return (
        faded(targets, rate).writeStream.format("parquet").outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest(changes: DataFrame) -> DataFrame:
    """(line_id, pt_idx, alpha): the last opacity of every vertex."""
    return changes.groupBy("line_id", "pt_idx").agg(F.max_by("alpha", "step").alias("alpha"))
