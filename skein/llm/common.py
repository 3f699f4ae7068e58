"""What the text operators share: tables, folds, names that clash with nothing, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that one step of a Python task works on (a longer text is a step of its own).
STEP_BYTES = 4 << 20

LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Text that Spark sends to a Python task at a time. Rows of text are long, and a task holds a few batches.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session is told to send batches of at most BATCH_BYTES to Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4 (a null id: false)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def drawn(df: DataFrame, deal: Column, n: int, total: int) -> DataFrame:
    """The ``n`` of the ``total`` rows of ``df`` whose hash ``deal`` is smallest, ties by all columns.

    Only hashes that leave a few times ``n`` rows are sorted, since each task would else hand its own
    ``n`` smallest to a single one.
    """
    share = (4 * n + 100) / max(total, 1)
    if share < 1:
        df = df.where(deal < F.lit(int(share * 2**64) - 2**63))
    return df.orderBy(deal, *[quoted(c) for c in df.columns]).limit(n)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [t or b"" for t in texts.cast(kind).to_pylist()]


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
