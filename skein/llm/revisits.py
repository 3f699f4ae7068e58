"""Resolution of not-modified revisit records of web archives.

A revisit record (status 304) has headers and no payload. It stands for the latest earlier full
response of the same canonical URL, if its validators name that response; the response's headers are
then updated by those of the revisit that may do so.

The as-of join runs over narrow rows, range-partitioned by URL and time, so that one URL with most of
the records is cut between tasks; what a task needs from earlier ones is one row, the last response
of the URL it begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.session import reliable

#: Header fields that a 304 does not change: fixed values of the HTTP caching standard.
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, ``/`` for an empty path.

    What is no absolute URL loses its fragment alone; null stays null.
    """
    bare = F.trim(url)
    scheme = F.lower(F.regexp_extract(bare, _URL, 1))
    host = F.lower(F.regexp_extract(bare, _URL, 2))
    rest = F.regexp_extract(bare, _URL, 3)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme == "", F.regexp_replace(bare, "#.*$", "")).otherwise(F.concat(scheme, F.lit("://"), host, path))


def fields(headers: Column) -> Column:
    """Sorted (name, value) with names in lower case; of equal names the smallest value."""
    pairs = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("name"), e["value"].alias("value"))))
    pairs = F.coalesce(pairs, F.expr("cast(array() as array<struct<name: string, value: string>>)"))
    return F.filter(pairs, lambda x, i: (i == 0) | (F.get(pairs, i - 1)["name"] != x["name"]))


def _field(pairs: Column, name: str) -> Column:
    return F.get(F.filter(pairs, lambda x: x["name"] == name), F.lit(0))["value"]


def merged(stored: Column, update: Column) -> Column:
    """``stored`` fields, those replaced that ``update`` has and may change."""
    new = F.filter(update, lambda x: ~x["name"].isin(*NOT_MERGED))
    names = F.transform(new, lambda x: x["name"])
    return F.array_sort(F.concat(F.filter(stored, lambda x: ~F.array_contains(names, x["name"])), new))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def latest_earlier(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(record_id, found): for every revisit the latest full response of its ``key`` at an earlier ``ts``.

    ``rows``: key, ts, full, record_id, etag, modified, without nulls in the first four. Responses
    of the same time are ordered by id; a response of the revisit's own time is not earlier.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["ts", "full", "record_id"]
    dealt = reliable(rows.repartitionByRange(parts, "key", *order).withColumn("part", F.spark_partition_id()))
    value = F.when(F.col("full"), F.struct("record_id", "etag", "modified"))
    before = Window.partitionBy("part", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("found", F.last(value, ignorenulls=True).over(before))
    ends = (
        dealt.groupBy("part")
        .agg(
            F.min("key").alias("first"), F.max("key").alias("last"),
            F.max(F.when(F.col("full"), F.struct("key", "ts", "record_id", "etag", "modified"))).alias("r"),
        )
        .orderBy("part")
        .collect()  # a row for each partition
    )
    carried, open_ = [], None  # the latest response so far of the key that the last partition ended in
    for e in ends:
        if open_ is not None and open_["key"] == e["first"]:
            carried.append((e["part"], e["first"], (open_["record_id"], open_["etag"], open_["modified"])))
        if e["r"] is not None and e["r"]["key"] == e["last"]:
            open_ = e["r"]
        elif open_ is not None and open_["key"] != e["last"]:
            open_ = None
    kind = rows.select("record_id", "etag", "modified").schema.simpleString()
    brought = spark.createDataFrame(carried, f"part int, key string, brought {kind}")
    return (
        local.join(F.broadcast(brought), ["part", "key"], "left")
        .where(~F.col("full"))
        .select("record_id", F.coalesce("found", "brought").alias("found"))
    )


def resolve(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Every record with its state, the response it stands for, its fields and its payload.

    ``records``: record_id bigint, url, ts, kind ('response' or 'revisit'), headers (map of strings),
    payload. Returns record_id, url (canonical), kind, state, response_id, headers (sorted name and
    value) and payload. State: ``full`` (a response, itself), ``resolved``, ``no_response`` (no
    earlier full one, or the revisit lacks an id, URL or time), ``no_validator`` (the revisit has
    neither ETag nor Last-Modified), ``mismatch``. An ETag decides where the revisit has one (weak
    comparison), else Last-Modified. Only resolved revisits get merged fields and a payload.

    Ids name records: repeated rows of one id come back as often as they stand, all resolved alike,
    and a repeated response serves once. Records of another kind pass as ``no_response``. Columns of
    other names are not read.
    """
    base = records.select(
        "record_id", canonical_url(F.col("url")).alias("url"), "ts", "kind", fields(F.col("headers")).alias("fields"), "payload"
    )
    full = F.coalesce(F.col("kind") == "response", F.lit(False))
    narrow = base.where("record_id is not null and url is not null and ts is not null and kind in ('response', 'revisit')").select(
        F.col("url").alias("key"), "ts", full.alias("full"), "record_id",
        _strong(_field(F.col("fields"), "etag")).alias("etag"), _field(F.col("fields"), "last-modified").alias("modified"),
    )
    found = latest_earlier(narrow, parts).groupBy("record_id").agg(F.min("found").alias("found"))
    etag, modified = _strong(_field(F.col("fields"), "etag")), _field(F.col("fields"), "last-modified")
    same = F.when(etag.isNotNull(), etag.eqNullSafe(F.col("found")["etag"])).otherwise(modified.eqNullSafe(F.col("found")["modified"]))
    state = (
        F.when(F.col("found").isNull(), "no_response")
        .when(etag.isNull() & modified.isNull(), "no_validator")
        .when(same, "resolved")
        .otherwise("mismatch")
    )
    revisit = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    # responses are whole as they are: of the joins, only the last one moves payloads, and each once
    known = base.where(revisit).drop("payload").join(found, "record_id", "left").withColumn("state", state)
    known = known.withColumn("response_id", F.when(F.col("state") == "resolved", F.col("found")["record_id"]))
    stored = base.where(full & F.col("record_id").isNotNull()).select(
        F.col("record_id").alias("stored_id"), F.col("fields").alias("stored_fields"), F.col("payload").alias("stored_payload")
    )
    if not stored.groupBy("stored_id").count().where("count > 1").isEmpty():
        stored = reliable(stored.groupBy("stored_id").agg(F.min(F.struct("stored_fields", "stored_payload")).alias("s")).select("stored_id", "s.*"))
    out = known.join(stored, F.col("response_id") == F.col("stored_id"), "left")
    resolved = F.col("state") == "resolved"
    return base.where(~revisit).select(
        "record_id", "url", "kind", F.when(full, "full").otherwise("no_response").alias("state"),
        F.when(full, F.col("record_id")).alias("response_id"), F.col("fields").alias("headers"), F.when(full, F.col("payload")).alias("payload"),
    ).unionByName(out.select(
        "record_id", "url", "kind", "state", "response_id",
        F.when(resolved, merged(F.col("stored_fields"), F.col("fields"))).otherwise(F.col("fields")).alias("headers"),
        F.when(resolved, F.col("stored_payload")).alias("payload"),
    ))


def capture_log(pages: DataFrame) -> DataFrame:
    """A log of captures that stands for ``pages``: a full response of each, and a revisit days later.

    Time, validators and the revisit's spelling of the URL follow from the page's id and html; one
    revisit in 7 has no validator and one in 5 a stale one.
    """
    i, tag = F.col("page_id"), F.md5(F.col("html"))
    when = F.lit(1_700_000_000) + i * 60
    day = F.concat(F.lit("day "), F.pmod(i, F.lit(365)).cast("string"))
    sent = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.concat(F.lit('"'), tag, F.lit('"')),
        F.lit("Last-Modified"), day, F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Date"), when.cast("string"),
    )
    stale = F.when(F.pmod(i, F.lit(5)) == 0, F.lit('W/"stale"')).otherwise(F.concat(F.lit('W/"'), tag, F.lit('"')))
    again = when + 86_400 * (1 + F.pmod(i, F.lit(3)))
    rest = [F.lit("Date"), again.cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60")]
    checked = F.when(F.pmod(i, F.lit(7)) == 0, F.create_map(*rest)).when(
        F.pmod(i, F.lit(2)) == 0, F.create_map(F.lit("etag"), stale, *rest)
    ).otherwise(F.create_map(F.lit("last-modified"), day, *rest))
    spelt = F.concat(F.regexp_replace("url", "^http", "HTTP"), F.lit("#again"))
    full = F.struct((2 * i).alias("record_id"), F.col("url"), when.alias("ts"), F.lit("response").alias("kind"), sent.alias("headers"), F.col("html").alias("payload"))
    later = F.struct((2 * i + 1).alias("record_id"), spelt.alias("url"), again.alias("ts"), F.lit("revisit").alias("kind"), checked.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return pages.select(F.explode(F.array(full, later)).alias("r")).select("r.*")
