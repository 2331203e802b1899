"""Queries over the ten operators and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, linededup, mixing, quality, secrets, simhash, toxicity, urlfilter, webp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(k: int) -> Column:
    """Remainder of the CRC-32 of the doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(fold(5) != 0))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(webp.pixels(webp.store(table(spark, sf_dir, "documents"))))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(fold(3) != 1))
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


UP, LOW = urlfilter.UPPER, urlfilter.LOWER

SQL_URLFILTER = f"""
WITH u AS (
  SELECT page_id, coalesce(position('://' in url) > 0, false) AS ok, substring(url, position('://' in url) + 3) AS rest FROM pages
), p AS (
  SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*', 0), '{UP}', '{LOW}') ELSE '' END AS host,
         CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u
), rules(rhost, rpath, verdict) AS (VALUES {", ".join(map(str, RULES))}),
m AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

SQL_CHAT = f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text FROM conversations),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, name, md5(text)) AS k FROM m),
s AS (SELECT DISTINCT conv_id, name AS assistant FROM m WHERE name <> 'system'),
h AS (
  SELECT q.*, s.assistant, (k - 1) // {chat.WHOLE} AS part, CASE WHEN name = assistant THEN '<|assistant|>' || chr(10) WHEN name = 'system' THEN '<|system|>' || chr(10) ELSE '<|user:' || name || '|>' || chr(10) END AS head
  FROM q JOIN s ON q.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, CAST(sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, assistant ORDER BY k) - length(text) - 1 AS BIGINT) AS p0 FROM h
)
SELECT conv_id, assistant, part, min(p0 - length(head)) AS start, count(*) AS n_messages, count(*) FILTER (WHERE name = assistant) AS n_masked,
       string_agg(head || text || chr(10), '' ORDER BY k) AS rendered,
       coalesce(string_agg(p0 || '-' || (p0 + length(text)), ',' ORDER BY k) FILTER (WHERE name = assistant), '') AS mask
FROM o GROUP BY conv_id, assistant, part
"""

WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL_DECONTAM = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, m, list_slice(w, p0, p0 + m - 1) AS win
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p0 FROM (SELECT *, least({decontam.WINDOW}, len(w)) AS m FROM b WHERE len(w) > 0))
), d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, p0, list_slice(w, p0, p0 + m - 1) AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p0 FROM d, lens)),
hit AS (SELECT doc_id, dw.m, p0, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + m)) AS p FROM (SELECT DISTINCT doc_id, m, p0 FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SQL_LINEDEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), l AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UP}', '{LOW}') AS key FROM l
), f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {linededup.LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT r) >= {linededup.LEAST_DOCS}),
g AS (SELECT k.*, f.last IS NOT NULL AND f.last <> doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY r, doc_id
"""


SQL_MIXING = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(text), '{mixing.SEED}')), 1, 16) AS drawn FROM documents
), s AS (
  SELECT *, (rank - 1) % 3 + 1 AS w, {mixing.EPOCHS} * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source)
), f AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER o, 0) AS BIGINT) AS lft, CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS rest
  FROM s WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT lft AS l_left, rest AS l_rest FROM f WHERE cap * rest >= lft * w ORDER BY CAST(cap AS DOUBLE) / w, rank LIMIT 1),
t AS (SELECT source, source_size, rank, total, CASE WHEN l_rest IS NULL OR cap * l_rest <= l_left * w THEN CAST(cap AS DOUBLE) ELSE CAST(l_left * w AS DOUBLE) / l_rest END AS target FROM f LEFT JOIN l ON true),
p AS (SELECT d.*, source_size, target, rank, total, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY drawn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS played FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT r, size, total, rank, drawn, doc_id, epoch, (played + epoch * source_size) / target AS time FROM p, (SELECT unnest(range(0, {mixing.EPOCHS})) AS epoch) WHERE size > 0 AND target > 0),
q AS (SELECT r, sum(size) OVER (ORDER BY time, rank, drawn, doc_id NULLS FIRST, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= total AS inside FROM c),
k AS (SELECT r, count(*) AS copies FROM q WHERE inside GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken FROM p LEFT JOIN k USING (r)
"""


def _sql_spans() -> str:
    """A row a match of each kind: position from the lengths of the gaps and matches before it."""
    kinds = []
    for k, (_, pattern, _, *_) in enumerate(secrets.KINDS):
        quoted = "'" + pattern.replace("'", "''") + "'"
        kinds.append(f"SELECT r, {k} AS kind, regexp_extract_all(text, {quoted}, 0) AS w, string_split_regex(text, {quoted}) AS g, regexp_extract_all(text, {quoted}, {2 if pattern is secrets.ASSIGN else 0}) AS v FROM t")
    return " UNION ALL ".join(kinds)


_NAMED = "VALUES " + ", ".join(f"({k}, '{name}', {least}, {'NULL' if strong is None else strong}, '{part}')" for k, (name, _, _, least, strong, part) in enumerate(secrets.KINDS))

SQL_SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, kind, i, length(w[i]) AS n, length(v[i]) AS v, sum(length(g[i]) + length(w[i])) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ({_sql_spans()}))),
kinds(kind, name, least, strong, part) AS ({_NAMED}),
s AS (SELECT r, m.kind, name, part, CAST(e - n AS BIGINT) AS b, CAST(e AS BIGINT) AS e, coalesce(v >= strong, false) AS strong FROM m JOIN kinds USING (kind) WHERE v >= least),
l AS (SELECT *, EXISTS (SELECT 1 FROM s o WHERE o.r = s.r AND (o.part = 'secret') <> (s.part = 'secret') AND o.b <= s.e + {secrets.SCOPE} AND o.e >= s.b - {secrets.SCOPE}) AS linked FROM s),
f AS (SELECT *, CASE WHEN strong OR name IN ('ident', 'endpoint') THEN name ELSE 'weak_' || name END || ':' || b || ':' || e AS line FROM l WHERE strong OR linked),
p AS (SELECT r, count(*) FILTER (WHERE strong AND name = 'assign') AS n_assign, count(*) FILTER (WHERE strong AND name = 'access') AS n_access, count(*) FILTER (WHERE strong AND name = 'hex') AS n_hex,
  string_agg(line, ',' ORDER BY b, kind) FILTER (WHERE strong) AS base, string_agg(line, ',' ORDER BY b, NOT strong, kind, line) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN p USING (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_toxicity, op2_simhash, op3_webp, op4_urlfilter, op5_chat, op6_quality, op7_mixing, op8_decontam, op9_linededup, op10_secrets, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_urlfilter": SQL_URLFILTER, "op5_chat": SQL_CHAT, "op7_mixing": SQL_MIXING, "op8_decontam": SQL_DECONTAM, "op9_linededup": SQL_LINEDEDUP, "op10_secrets": SQL_SECRETS}
