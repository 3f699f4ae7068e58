"""Sources of many shards against the SQL, which states shards and their quotas by windows."""

import pytest
from pyspark.sql import functions as F

from check import connect, differences
from skein.llm import mixing
from skein.llm.common import table
from skein.llm.queries import mixing_sql


@pytest.mark.parametrize("shard_tokens", [100, 2_000])
def test_shards_agree_with_sql(spark, folder, shard_tokens):
    docs = table(spark, folder, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.take(sized, "size", shard_tokens=shard_tokens).drop("source", "epochs", "blocks").toPandas()
    assert differences(got, connect(folder).execute(mixing_sql(shard_tokens)).df()) is None


def test_shards_hold_their_quotas_and_rows_without_an_id_are_spread(spark):
    rows = [(None if i % 2 else i, "a" if i % 10 else None, i % 97) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.take(docs, "size", shard_tokens=1_000).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    for _, mine in got.groupby("source", dropna=False):
        shards = mixing.shards(int(mine["size"].sum()), 1_000, 0)
        assert abs(mine.taken.sum() - mine.target.iloc[0]) <= mixing.BLOCK_TOKENS * (shards + 1)
    draw = mixing.Seed().number("order", F.col("doc_id"), F.col("size"))
    places = docs.where("doc_id IS NULL").select(F.shiftright(draw * 40, 32).alias("k")).groupBy("k").count().toPandas()
    assert places["count"].max() < 200 and len(places) > 20


def test_stride_of_blocks_without_overflow(spark):
    rows = [(i, t) for t in (1, 7, 10**6, 2**42 - 3) for i in (0, 1, 12345, t // 2, t - 1)]
    df = spark.createDataFrame(rows, "i bigint, t bigint").select("i", "t", mixing._strided(F.col("i"), F.col("t")).alias("m"))
    assert all(r.m == r.i * mixing._STRIDE % r.t for r in df.collect())
