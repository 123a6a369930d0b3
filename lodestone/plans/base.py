"""The engine's tables derived from the driver's, as DataFrames and as DuckDB views (WITH clauses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import search
from lodestone.session import table


def items(spark: SparkSession, d: str) -> DataFrame:
    """documents as items; labels give their state."""
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    x = table(spark, d, "documents").join(lab, "doc_id", "left")
    x = x.withColumn("category", F.concat("lang", F.lit("/"), "source"))
    return x.select(
        F.col("doc_id").alias("id"), "text", "lang", "source", "category", *T.category_levels("category"), "quality", "toxic",
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("deprecated"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("pinned"),
        F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 3).cast("int").alias("status"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("dedup_verified"),
        (1 + F.col("n_chars") % 5).cast("int").alias("occurrence_count"),
        F.when(F.col("toxic") == 1, F.col("source")).alias("origin_repo"),
        F.array(F.concat(F.lit("u"), (F.col("n_chars") % 150).cast("string"))).alias("source_sessions"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars") * 600).alias("refreshed_at"),
    )


def item_tags(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    tags = F.array_compact(F.array("lang", "source", F.concat(F.lit("repo:"), "source"), F.concat(F.lit("quality:"), F.col("quality").cast("string"))))
    return i.select(F.col("id").alias("item_id"), F.explode(tags).alias("tag")).distinct()


def log(spark: SparkSession, d: str) -> DataFrame:
    """events with their item, session and relevance."""
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("item_id"))


def verdict_events(spark: SparkSession, d: str) -> DataFrame:
    """item_id, tag, raw in [-1, 1], weight, seq: every event judges an item under its type's tag."""
    return log(spark, d).select("item_id", F.col("event_type").alias("tag"), (F.col("value") / 250.0 - 1.0).alias("raw"), F.lit(1.0).alias("weight"), F.col("event_id").alias("seq"))


def in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Active items that a session in the repository src7 sees, where src3 and src4 are isolated."""
    active = items(spark, d).where("not deprecated")
    return search.isolated_scope(active, item_tags(spark, d), audit(spark, d), "src7", ["src3", "src4"])


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id").join(vectors(spark, d).withColumnRenamed("id", "query_id"), "query_id")


def shown(spark: SparkSession, d: str) -> DataFrame:
    """What sessions were shown: their view events."""
    return log(spark, d).where("event_type = 'view'").select("session_id", "item_id", F.col("event_type").alias("hook_event"), F.col("ts").alias("shown_at"), F.col("event_id").alias("seq"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    """session_id, ts, repo, env_tags of each session."""
    g = log(spark, d).groupBy("session_id", "user_id").agg(F.max("ts").alias("ts"))
    repo = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))
    return g.select("session_id", "ts", repo.alias("repo"), F.array(F.concat(F.lit("repo:"), repo), F.lit("en")).alias("env_tags"))


def processed(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with purchases: completed if they signed up, else failed once per error."""
    g = log(spark, d).groupBy("session_id").agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "signup").alias("s"), F.count_if(F.col("event_type") == "error").alias("e"))
    return g.where("p > 10").select("session_id", F.when(F.col("s") > 12, "completed").otherwise("failed").alias("status"), (F.col("e") % 5).cast("int").alias("retry_count"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations as transcript turns."""
    return table(spark, d, "conversations").where("role in ('user', 'assistant')").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("line_no"), "role", "text")


#: The same in SQL; queries start with WITH RECURSIVE and these.
SQL = r"""
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
items AS (SELECT d.doc_id AS id, text, lang, source, lang || '/' || source AS category, lang AS level1, source AS level2, quality, toxic,
  coalesce(quality = 0, false) AS deprecated, coalesce(toxic = 1, false) AS pinned,
  CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 3 END AS status, coalesce(quality = 1, false) AS dedup_verified,
  (1 + n_chars % 5)::INT AS occurrence_count, CASE WHEN toxic = 1 THEN source END AS origin_repo,
  'u' || (n_chars % 150) AS source_session, 1704067200 + n_chars * 600 AS refreshed_s FROM documents d LEFT JOIN lab USING (doc_id)),
item_tags AS (SELECT DISTINCT id AS item_id, tag FROM (SELECT id, unnest([lang, source, 'repo:' || source, 'quality:' || quality]) AS tag FROM items) WHERE tag IS NOT NULL),
log AS (SELECT event_id, ts, 'u' || user_id AS session_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS item_id FROM events),
ev AS (SELECT item_id, event_type AS tag, value / 250.0 - 1.0 AS raw, event_id AS seq FROM log),
rel AS (SELECT item_id, tag, sum(0.3 * raw * pow(0.7, n)) AS score, count(*) FILTER (raw > 0) AS pos, count(*) FILTER (raw < 0) AS neg
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id, tag ORDER BY seq DESC) - 1 AS n FROM ev) GROUP BY item_id, tag),
questions AS (SELECT item_id AS query_id, text FROM benchmark),
shown AS (SELECT session_id, item_id, ts AS shown_at, event_id AS seq FROM log WHERE event_type = 'view'),
audit AS (SELECT session_id, max(ts) AS ts, 'src' || (user_id % 20) AS repo FROM log GROUP BY session_id, user_id),
processed AS (SELECT session_id, CASE WHEN s > 12 THEN 'completed' ELSE 'failed' END AS status, e % 5 AS retry_count FROM
  (SELECT session_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'error') AS e FROM log GROUP BY session_id) WHERE p > 10),
turns AS (SELECT conv_id::VARCHAR AS session, turn AS line_no, role, text FROM conversations WHERE role IN ('user', 'assistant')),
-- what a search sees
ties AS (SELECT id, origin_repo AS repo FROM items WHERE origin_repo IS NOT NULL UNION SELECT item_id, substr(tag, 6) FROM item_tags WHERE tag LIKE 'repo:%' UNION SELECT i.id, a.repo FROM items i JOIN audit a ON a.session_id = i.source_session),
scope AS (SELECT * FROM items WHERE true),
-- keyword list
tok AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text || ' ' || category), '[\p{L}\p{N}_]+')) AS term FROM scope) GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM tok GROUP BY id),
st AS (SELECT (SELECT count(*) FROM scope) AS n, (SELECT sum(tf) FROM tok) / (SELECT count(*) FROM scope) AS avgdl),
idf0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tok, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf0) ELSE raw END AS idf FROM idf0),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM questions) GROUP BY ALL),
kw0 AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING (term) JOIN tok USING (term) JOIN dl USING (id), st GROUP BY ALL),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank0 FROM kw0) WHERE rank0 < 10),
-- vector list
vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
vn AS (SELECT id, e, label, sqrt(list_inner_product(e, e)) + 1e-10 AS norm FROM vec),
v0 AS (SELECT q.query_id, v.id, list_inner_product(a.e, v.e) / (a.norm * v.norm) AS score FROM questions q JOIN vn a ON a.id = q.query_id, vn v),
v1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS r FROM v0) WHERE r < 10),
vl AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS rank0 FROM v1 WHERE id IN (SELECT id FROM scope)),
-- fusion
an AS (SELECT greatest(1, n // 5) AS k, 2.0 / (greatest(1, n // 5) + 1) AS hi, 1.0 / (greatest(1, n // 5) + 10) AS lo FROM st),
rrf AS (SELECT query_id, id, sum(1.0 / (k + 1 + rank0)) AS rrf FROM (SELECT query_id, id, rank0 FROM kw UNION ALL SELECT query_id, id, rank0 FROM vl), an GROUP BY query_id, id),
fused AS (SELECT query_id, id, rrf, (rrf - lo) / (hi - lo) AS score FROM rrf, an)
"""


#: Active items, without those tied to the isolated repositories src3 and src4.
IN_SCOPE = "NOT deprecated AND id NOT IN (SELECT id FROM ties WHERE repo IN ('src3', 'src4'))"


#: A body that holds this searches what is in scope, others all items.
SCOPED = "/* in scope */"


def sql(body: str, recursive: bool = False) -> str:
    scope = IN_SCOPE if SCOPED in body else "true"
    start = "WITH RECURSIVE " if recursive else "WITH "
    return start + SQL.strip().replace("FROM items WHERE true", f"FROM items WHERE {scope}") + "\n" + (body if body.lstrip().upper().startswith("SELECT") else ", " + body)
