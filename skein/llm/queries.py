"""Registered queries of the text operators, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm import decontaminate, language_id, line_dedup, mixing, pieces, ranking, revisits, secrets, simhash, span_dedup, topk, toxicity, whitening
from skein.llm.common import held_out, table
from skein.session import reliable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, "score").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def mixing_sql(shard_tokens: int = mixing.SHARD_TOKENS) -> str:
    """Targets by filling sources in the order in which they reach their limit, seats of sources and shards by quotients."""
    b, m = mixing.BLOCK_TOKENS, mixing.MAX_EPOCHS
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    seed = mixing.Seed().value
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % {len(mixing.WEIGHTS)} {weights} END AS w FROM s),
o AS (SELECT *, (sum(n) OVER () - coalesce(sum({m} * n) OVER before, 0))::BIGINT AS remaining,
    (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS weight FROM w
  WINDOW before AS (ORDER BY n::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, bool_and(remaining * w > {m} * n * weight) OVER (ORDER BY n::DOUBLE / w, rank ROWS UNBOUNDED PRECEDING) AS at_limit FROM o),
c AS (SELECT sum(n)::BIGINT AS total, coalesce(sum({m} * n) FILTER (at_limit), 0)::BIGINT AS used,
    coalesce(sum(w) FILTER (NOT at_limit), 1)::BIGINT AS weight FROM f),
t AS (SELECT f.source, rank, n, CASE WHEN at_limit THEN ({m} * n)::DOUBLE ELSE ((total - used) * w)::DOUBLE / c.weight::DOUBLE END AS target FROM f, c),
q AS (SELECT source, target / (2 * k + 1)::DOUBLE AS quotient, rank FROM t, unnest(range((SELECT floor(total / {b}.0 + 0.5)::BIGINT FROM c))) AS u(k)
  WHERE (2 * k - 1) * {b} < 2 * target + 4 * {b}),
g AS (SELECT source FROM q ORDER BY quotient DESC, rank LIMIT (SELECT floor(total / {b}.0 + 0.5)::BIGINT FROM c)),
h AS (SELECT source, count(*) AS seats FROM g GROUP BY source),
v AS (SELECT t.source, rank, n, target, coalesce(seats, 0) AS seats,
    greatest(1, ceil(n / greatest({shard_tokens}, ceil((SELECT total FROM c) / {mixing.MAX_SHARDS}))))::BIGINT AS shards
  FROM t LEFT JOIN h ON t.source IS NOT DISTINCT FROM h.source),
e AS (SELECT d.*, rank, v.n, target, shards, md5('{seed}:order:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size) AS draw
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
i AS (SELECT *, (('0x' || draw[:8])::BIGINT * shards) >> 32 AS shard FROM e),
j AS (SELECT rank, shard, sum(size)::BIGINT AS held FROM i GROUP BY ALL),
x AS (SELECT j.*, seats, sum(held) OVER (PARTITION BY j.rank) AS whole, count(*) OVER (PARTITION BY j.rank) AS parts FROM j JOIN v ON j.rank = v.rank),
y AS (SELECT rank, shard, seats, held / (2 * k + 1)::DOUBLE AS quotient
  FROM x, unnest(range(CASE WHEN held > 0 THEN seats ELSE 0 END)) AS u(k) WHERE (2 * k - 1) * whole < 2 * held * (seats + parts + 2)),
z AS (SELECT rank, shard FROM y QUALIFY row_number() OVER (PARTITION BY rank ORDER BY quotient DESC, shard) <= seats),
l AS (SELECT j.*, least(count(z.rank) * {b}, {m} * held)::BIGINT AS quota
  FROM j LEFT JOIN z ON j.rank = z.rank AND j.shard = z.shard GROUP BY j.rank, j.shard, j.held),
p AS (SELECT i.doc_id, i.size, n, target, quota // greatest(held, 1) AS epochs, held AS tokens, quota,
    sum(size) OVER (PARTITION BY i.rank, i.shard ORDER BY draw, i.doc_id, i.size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM i JOIN l ON i.rank = l.rank AND i.shard = l.shard),
r AS (SELECT *, floor((quota - epochs * tokens) / {b}.0 + 0.5)::BIGINT AS rest, ((tokens + {b - 1}) // {b})::BIGINT AS blocks FROM p)
SELECT doc_id, size, n AS source_size, target, (epochs * size + CASE WHEN size = 0 THEN 0 ELSE
  coalesce(list_sum(list_transform(list_filter(range((start // {b})::BIGINT, ((start + size - 1) // {b})::BIGINT + 1), lambda i: (i * {mixing._STRIDE}) % blocks < rest),
    lambda i: least((i + 1) * {b} - start, size) - greatest(i * {b} - start, 0))), 0) END)::BIGINT AS taken FROM r"""


@query("op2_source_mixing", mixing_sql())
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = reliable(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    return mixing.take(sized, "size").drop("source", "epochs", "blocks")


@query("op3_decontamination")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"), "passages"), "passages")


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~held_out("doc_id"))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "language.*"
    )


@query("op5_simhash_near_dedup")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.classes(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op6_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op6(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    whole = rows.select("vec_id", topk.scaled(F.col("embedding")).alias("embedding"))
    return topk.search(whole, F.pmod("vec_id", F.lit(50)) == 0)


@query("op7_secret_scan")
def op7(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "spans"), "spans")


@query("op8_span_dedup")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_dedup.drop_repeats(docs).withColumn("removed", F.col("n_removed") > 0)


@query("op9_line_dedup", f"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT source, trim(line) AS line, count(DISTINCT text) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL),
p AS (SELECT source, count(DISTINCT coalesce(text, '')) AS pages FROM documents GROUP BY ALL),
bad AS (SELECT n.source, list(line) AS lines FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source
  WHERE n >= {line_dedup.MIN_PAGES} AND n::DOUBLE / pages::DOUBLE > {line_dedup.MAX_RATIO}::DOUBLE GROUP BY ALL),
k AS (SELECT doc_id, text, string_split(text, chr(10)) AS every,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(lines, []), trim(x))) AS kept
  FROM documents d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, coalesce(len(every), 0)::BIGINT AS n_lines,
  coalesce(len(every) - len(kept), 0)::BIGINT AS n_dropped FROM k""")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).drop("source")


@query("op10_revisit_resolution", """
WITH u AS (SELECT page_id AS i, html, trim(url) AS url, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme FROM pages),
c AS (SELECT *, CASE WHEN scheme = '' THEN regexp_replace(url, '#.*$', '') ELSE lower(scheme) || '://' ||
    CASE lower(scheme) WHEN 'http' THEN regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':80$', '')
      WHEN 'https' THEN regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':443$', '')
      ELSE lower(regexp_extract(url, '://([^/?#]*)', 1)) END ||
    CASE WHEN regexp_extract(url, '://[^/?#]*([^#]*)', 1) LIKE '/%' THEN '' ELSE '/' END || regexp_extract(url, '://[^/?#]*([^#]*)', 1) END AS key FROM u),
f AS (SELECT i, key, html, 1700000000 + i * 60 AS ts, '"' || md5(html) || '"' AS etag, 'day ' || (i % 365) AS modified, length(html) AS n FROM c),
v AS (SELECT i, key, ts + 86400 * (1 + i % 3) AS ts,
    CASE WHEN i % 7 <> 0 AND i % 2 = 0 THEN CASE WHEN i % 5 = 0 THEN '"stale"' ELSE etag END END AS etag,
    CASE WHEN i % 7 <> 0 AND i % 2 = 1 THEN modified END AS modified FROM f),
l AS (SELECT key, ts, max(i) AS i FROM f GROUP BY ALL),
a AS (SELECT v.i, v.key, v.ts, v.etag, v.modified, l.i AS j FROM v ASOF LEFT JOIN l ON v.key = l.key AND v.ts > l.ts),
s AS (SELECT a.*, f.etag AS f_etag, f.modified AS f_modified, f.n, f.html, CASE WHEN j IS NULL THEN 'no_response'
    WHEN a.etag IS NULL AND a.modified IS NULL THEN 'no_validator'
    WHEN CASE WHEN a.etag IS NOT NULL THEN a.etag = f.etag ELSE a.modified = f.modified END THEN 'resolved' ELSE 'mismatch' END AS state
  FROM a LEFT JOIN f ON a.j = f.i)
SELECT 2 * i AS record_id, key AS url, 'response' AS kind, 'full' AS state, 2 * i AS response_id,
  'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || etag || chr(10) || 'last-modified: ' || modified AS headers,
  html AS payload FROM f
UNION ALL
SELECT 2 * i + 1, key, 'revisit', state, CASE WHEN state = 'resolved' THEN 2 * j ELSE -1 END,
  CASE WHEN state = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) ||
    'etag: ' || CASE WHEN etag IS NULL THEN f_etag ELSE 'W/' || etag END || chr(10) || 'last-modified: ' || coalesce(modified, f_modified)
  ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts || CASE WHEN etag IS NOT NULL THEN chr(10) || 'etag: W/' || etag ELSE '' END ||
    CASE WHEN modified IS NOT NULL THEN chr(10) || 'last-modified: ' || modified ELSE '' END END,
  CASE WHEN state = 'resolved' THEN html END FROM s""")
def op10(spark, sf_dir):
    log = revisits.capture_log(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    lines = F.array_join(F.transform("headers", lambda x: F.concat_ws(": ", x["name"], x["value"])), "\n")
    return revisits.resolve(log).withColumns({"headers": lines, "response_id": F.coalesce("response_id", F.lit(-1).cast("long"))})


@query("op11_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
c AS (SELECT doc_id, r, len(words) AS n FROM d WHERE len(words) > 0),
s AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS words FROM c),
t AS (SELECT r, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
i AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * n * total) // words) AS m FROM c, s),
o AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER best::INTEGER AS rank, doc_id, score FROM o JOIN m USING (r) WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= {ranking.K}""")
def op11(spark, sf_dir):
    return ranking.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op12_sentencepiece_codec")
def op12(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digest(pieces.decode(pieces.encode(docs, model).drop("text"), model))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.digest(vectors, whitening.fit(vectors))
