"""Ordered and keyed work on groups of any size.

A line (or pixel, or bucket) may hold a large share of all rows, so no operator here places a
whole group in one task:

* positions in a group are cut into chunks of fixed length; window frames of fixed reach are
  evaluated per chunk, with copies of the few rows next to its borders (``halo``),
* running sums are a sum inside the chunk plus the sum of the earlier chunks,
* order-dependent folds run per chunk and hand their state on until nothing changes,
* positions themselves come from a range partitioning when a group is too large to sort at once,
* joins spread the rows of hot keys over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.session import reliable

CHUNK = 1 << 15          # rows of a group that one window sees
HOT_ROWS = 1 << 20       # a group above this size is split before it is sorted
HOT_KEYS = 4096          # at most this many keys can hold 1/HOT_KEYS of the rows each
MAX_FAN = 64

# Helper columns; no caller has columns of these names.
PART, CHUNK_OF, SHARE, FAN, BLOCK = "__skew_part", "_chunk", "__skew_share", "__skew_fan", "__skew_block"


def hottest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group (partial counts are combined before the shuffle)."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


# ------------------------------------------------------------------ positions and running sums


def _asc(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, Column],
    hot_rows: int = HOT_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Inclusive running sums of expressions over ``order`` inside each group of ``keys``.

    ``order`` has to be total. Without keys all rows are one group. Groups of up to ``hot_rows`` rows
    use one window. Otherwise the rows are
    range-partitioned on the full order, fixed in the checkpoint folder, summed per partition and
    shifted by the sums of the earlier partitions of the same group. Only groups that cross a
    partition border need a shift, so the shifts are fewer than the partitions and are broadcast.
    """
    keys, order = list(keys), _asc(order)
    if hottest(df, keys) <= hot_rows:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})

    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = reliable(
        df.withColumns({f"__skew_v_{n}": c for n, c in sums.items()})
        .repartitionByRange(parts, *[F.col(k) for k in keys], *order)
        .withColumn(PART, F.spark_partition_id())
    )
    local = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PART).rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = (
        ranged.groupBy(PART, *keys)
        .agg(*[F.sum(f"__skew_v_{n}").alias(f"__skew_t_{n}") for n in sums])
        .withColumns({f"__skew_s_{n}": F.sum(f"__skew_t_{n}").over(earlier) for n in sums})
        .where(F.coalesce(*[F.col(f"__skew_s_{n}") for n in sums]).isNotNull())
        .select(PART, *keys, *[f"__skew_s_{n}" for n in sums])
    )
    out = ranged.withColumns({n: F.sum(f"__skew_v_{n}").over(local) for n in sums})
    out = out.join(F.broadcast(shifts), [PART, *keys], "left")
    return out.withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"__skew_s_{n}"), F.lit(0)) for n in sums}
    ).select(*df.columns, *sums)


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: str = "pt_idx",
    hot_rows: int = HOT_ROWS,
    parts: int | None = None,
    dtype: str = "int",
) -> DataFrame:
    """0-based position of every row in its group."""
    ranked = running_sums(df, keys, order, {out: F.lit(1).cast("bigint")}, hot_rows, parts)
    return ranked.withColumn(out, (F.col(out) - 1).cast(dtype))


# ------------------------------------------------------------------ bounded frames


def halo_windows(
    df: DataFrame,
    columns,
    before: int,
    after: int,
    chunk: int = CHUNK,
    line: str | Sequence[str] = "line_id",
    idx: str = "pt_idx",
) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` rows ahead.

    Rows near a chunk border are copied into the next chunk, the window runs per (line, chunk),
    and the copies are dropped. ``idx`` has to be dense from 0 in each line. ``columns`` is a
    dict of functions of the window, one function that returns such a dict of columns, or a list
    of these, evaluated one after the other; the reach then covers all of them together.
    """
    lines = [line] if isinstance(line, str) else list(line)
    chunk = max(chunk, before + after + 1)
    size = F.lit(chunk)
    own = F.floor(F.col(idx) / size)
    spots = F.array_distinct(
        F.array(
            F.floor((F.col(idx) - F.lit(after)) / size),
            own,
            F.floor((F.col(idx) + F.lit(before)) / size),
        )
    )
    spread = df.withColumn(CHUNK_OF, F.explode(spots)).where(F.col(CHUNK_OF) >= 0)
    w = Window.partitionBy(*lines, CHUNK_OF).orderBy(idx)
    for stage in columns if isinstance(columns, list) else [columns]:
        cols = stage(w) if callable(stage) else {n: f(w) for n, f in stage.items()}
        spread = spread.withColumns(cols)
    return spread.where(F.col(CHUNK_OF) == own).drop(CHUNK_OF)


def line_running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    chunk: int = CHUNK,
    line: str = "line_id",
    idx: str = "pt_idx",
) -> DataFrame:
    """Inclusive running sums along each line, for rows that already carry a dense ``idx``."""
    w = Window.partitionBy(line, CHUNK_OF).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    base = df.withColumn(CHUNK_OF, F.floor(F.col(idx) / F.lit(chunk)))
    local = base.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    earlier = Window.partitionBy(line).orderBy(CHUNK_OF).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        base.groupBy(line, CHUNK_OF)
        .agg(*[F.sum(c).alias(f"__skew_s_{n}") for n, c in sums.items()])
        .withColumns({f"__skew_s_{n}": F.sum(f"__skew_s_{n}").over(earlier) for n in sums})
        .where(F.col(CHUNK_OF) > 0)
    )
    out = local.join(shifts, [line, CHUNK_OF], "left")
    return out.withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"__skew_s_{n}"), F.lit(0.0)) for n in sums}
    ).select(*df.columns, *sums)


# ------------------------------------------------------------------ joins


def attach_line(
    df: DataFrame,
    lines: DataFrame,
    n: str = "n",
    how: str = "inner",
    chunk: int = CHUNK,
    line: str = "line_id",
    idx: str = "pt_idx",
) -> DataFrame:
    """Join per-line columns to points on (line, chunk), so that a long line spreads over tasks.

    ``lines`` carries the number of points ``n`` of each line.
    """
    last = F.floor((F.col(n) - 1) / F.lit(chunk))
    per_chunk = lines.where(F.col(n) > 0).withColumn(
        CHUNK_OF, F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")))
    )
    keyed = df.withColumn(CHUNK_OF, F.floor(F.col(idx) / F.lit(chunk)).cast("bigint"))
    return keyed.join(per_chunk, [line, CHUNK_OF], how).drop(CHUNK_OF)


def spread_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join over all shuffle partitions, for joins that yield far more than they read.

    Adaptive execution merges small inputs into few partitions, and the yield would then come from
    few tasks; it leaves a partition count that is asked for alone.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(k) for k in keys]
    return left.repartition(parts, *cols).join(right.repartition(parts, *cols), list(keys), how)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Equi-join in which the left rows of hot keys are dealt to several tasks.

    A key is hot above ``hot_rows`` rows and above 1/HOT_KEYS of all left rows, so there are at
    most HOT_KEYS hot keys and their list may be broadcast. ``spread`` names left columns whose
    hash deals the rows. The right rows of a hot key are repeated once per share.
    """
    keys = list(keys)
    if (hottest(left, keys) if largest is None else largest) <= hot_rows:
        return spread_join(left, right, keys, how)
    counts = left.groupBy(*keys).count()
    total = counts.agg(F.sum("count")).first()[0]
    limit = max(hot_rows, total // HOT_KEYS)
    hot = counts.where(F.col("count") > limit).select(
        *keys, F.least(F.ceil(F.col("count") / limit), F.lit(MAX_FAN)).cast("int").alias(FAN)
    )
    fan = F.coalesce(F.col(FAN), F.lit(1))
    deal = F.pmod(F.xxhash64(*(spread or left.columns)), fan).cast("int")
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(SHARE, deal).drop(FAN)
    copies = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn(SHARE, F.explode(F.sequence(F.lit(0), fan - 1)))
        .drop(FAN)
    )
    return spread_join(dealt, copies, [*keys, SHARE], how).drop(SHARE)


# ------------------------------------------------------------------ order-dependent folds


def chunked_fold(
    df: DataFrame,
    elem: list[Column],
    carry: dict[str, tuple[str, Column]],
    item: str,
    step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]],
    chunk: int = 1 << 12,
    line: str = "line_id",
    idx: str = "pt_idx",
) -> DataFrame:
    """Left fold along each line; returns (line, _chunk, exit, out).

    ``carry`` names the state fields with their type and first value. ``step(state, element)``
    gives the next fields, whether to emit, and the emitted value of type ``item``. ``exit`` is the
    state after the chunk and ``out`` the values emitted in it.

    All chunks are first folded as if each began a line. A chunk whose predecessor ended in a state
    other than its assumed entry is folded again from that state, until all entries agree; that
    fixed point is the sequential result. A line of one chunk never needs a second round, and
    folds that reset at a cut agree again soon after any border.
    """
    first = F.struct(*[v.cast(t).alias(n) for n, (t, v) in carry.items()])

    def merge(state: Column, e: Column) -> Column:
        new, emit, value = step(state, e)
        out = F.when(emit, F.concat(state["out"], F.array(value.cast(item))))
        return F.struct(
            *[new[n].cast(t).alias(n) for n, (t, _) in carry.items()],
            out.otherwise(state["out"]).alias("out"),
        )

    def fold(blocks: DataFrame) -> DataFrame:
        none = F.expr(f"cast(array() as array<{item}>)").alias("out")
        zero = F.struct(*[F.col("entry")[n].alias(n) for n in carry], none)
        return blocks.withColumn("_f", F.aggregate("_rows", zero, merge)).select(
            line,
            CHUNK_OF,
            "entry",
            F.struct(*[F.col("_f")[n].alias(n) for n in carry]).alias("exit"),
            F.col("_f")["out"].alias("out"),
        )

    blocks = (
        df.withColumn(CHUNK_OF, F.floor(F.col(idx) / F.lit(chunk)).cast("bigint"))
        .groupBy(line, CHUNK_OF)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(idx), *elem))).alias("_rows"))
    )
    if (df.agg(F.max(idx)).first()[0] or 0) < chunk:
        return fold(blocks.withColumn("entry", first)).drop("entry")

    blocks = reliable(blocks)
    done = reliable(fold(blocks.withColumn("entry", first)))
    while True:
        before = done.select(
            line, (F.col(CHUNK_OF) + 1).alias(CHUNK_OF), F.col("exit").alias("_next")
        )
        stale = (
            done.join(before, [line, CHUNK_OF])
            .where(~F.col("_next").eqNullSafe(F.col("entry")))
            .select(line, CHUNK_OF, F.col("_next").alias("entry"))
        )
        redo = reliable(fold(blocks.join(stale, [line, CHUNK_OF])))
        if redo.isEmpty():
            return done.drop("entry")
        done = reliable(done.join(redo, [line, CHUNK_OF], "left_anti").unionByName(redo))


# ------------------------------------------------------------------ long integer ranges


def explode_range(
    df: DataFrame, low: Column, high: Column, name: str, block: int = 1 << 12
) -> DataFrame:
    """One row per integer in [low, high]; no array is longer than ``block``."""
    size = F.lit(block)
    lo, hi = low.cast("bigint"), high.cast("bigint")
    blocks = df.where(lo <= hi).withColumn(
        BLOCK, F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))
    )
    first = F.greatest(lo, F.col(BLOCK) * size)
    last = F.least(hi, F.col(BLOCK) * size + size - 1)
    return blocks.withColumn(name, F.explode(F.sequence(first, last))).drop(BLOCK)
