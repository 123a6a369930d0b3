"""Feedback loop: relevance, evidence, pins, pending work."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import feedback as fb

from . import base as B

QUERIES, ORACLES = {}, {}


def query(name, sql=None, recursive=False):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = B.sql(sql, recursive)
        return f

    return add


def _rel(spark, d):
    return fb.relevance(B.verdict_events(spark, d))


@query("a07_relevance", "SELECT item_id, tag, round(score, 6) AS score, pos::INT AS positive_evals, neg::INT AS negative_evals FROM rel")
def relevance(spark, d):
    return _rel(spark, d).select("item_id", "tag", F.round("score", 6).alias("score"), "positive_evals", "negative_evals")


@query("a07_relevance_bounded", "SELECT item_id, tag, round(score, 6) AS score, pos::INT AS positive_evals, neg::INT AS negative_evals FROM rel")
def bounded(spark, d):
    return fb.relevance_bounded(B.verdict_events(spark, d)).withColumn("score", F.round("score", 6))


@query("a04_mean_over_rows", "SELECT item_id, round(avg(score), 6) AS avg_score FROM rel WHERE tag IN ('click', 'view', 'none') GROUP BY item_id")
def mean_rows(spark, d):
    return fb.mean_over_rows(_rel(spark, d), ["click", "view", "none"]).withColumn("avg_score", F.round("avg_score", 6))


@query("a05_mean_over_requested", "SELECT id AS item_id, round(coalesce(sum(score), 0) / 3, 6) AS avg_score, coalesce(sum(pos + neg), 0)::BIGINT AS evidence FROM items LEFT JOIN (SELECT * FROM rel WHERE tag IN ('click', 'view', 'none')) ON item_id = id GROUP BY id")
def mean_requested(spark, d):
    return fb.mean_over_requested(B.items(spark, d), _rel(spark, d), ["click", "view", "none"]).withColumn("avg_score", F.round("avg_score", 6))


@query("a06_pin_statistics", "SELECT item_id, round(avg(score), 6) AS avg_score, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, round(sum(pos) / sum(pos + neg), 6) AS rate FROM rel GROUP BY item_id")
def statistics(spark, d):
    return fb.pin_statistics(_rel(spark, d)).select("item_id", F.round("avg_score", 6).alias("avg_score"), "pos", "neg", F.round("rate", 6).alias("rate"))


_PINS = """p AS (SELECT item_id AS id, avg(score) AS a, sum(pos) AS pos, sum(neg) AS neg FROM big GROUP BY item_id)
SELECT id, CASE WHEN NOT pinned AND coalesce(pos + neg, 0) >= 5 AND a > 0.6 AND pos / (pos + neg) >= 0.8 THEN true WHEN pinned AND coalesce(pos + neg, 0) >= 5 AND a < 0.2 THEN false ELSE pinned END AS pinned FROM items LEFT JOIN p USING (id)"""


@query("m10_pin_state", "big AS (SELECT item_id, tag, score * 3 AS score, pos + neg AS pos, 0 AS neg FROM rel), " + _PINS)
def pins(spark, d):
    r = _rel(spark, d).select("item_id", "tag", (F.col("score") * 3).alias("score"), (F.col("positive_evals") + F.col("negative_evals")).alias("positive_evals"), F.lit(0).alias("negative_evals"))
    i = B.items(spark, d).select("id", "pinned", F.col("pinned").alias("auto_pinned"))
    return fb.pin_state(r, i).select("id", "pinned")


_TAGS = ("click", "view", "purchase", "signup", "error")
_MOVED = ", ".join(f"CASE WHEN tag = '{t}' THEN greatest(-3, least(3, 0.7 * coalesce({t}_, 0) + 0.3 * x)) ELSE {t}_ END AS {t}_" for t in _TAGS)
_MEAN = "(" + " + ".join(f"coalesce({t}_, 0)" for t in _TAGS) + ") / (" + " + ".join(f"({t}_ IS NOT NULL)::INT" for t in _TAGS) + ")"


@query("m10_pin_history", f"""o AS (SELECT item_id, tag, abs(raw) * 2.0 AS x, (raw <> 0)::INT AS up, seq, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS n FROM ev),
w AS (SELECT DISTINCT item_id, 0::BIGINT AS n, 0::BIGINT AS seq, 0 AS pos, false AS pinned, false AS moved, {", ".join(f"NULL::DOUBLE AS {t}_" for t in _TAGS)} FROM o
UNION ALL SELECT item_id, n, seq, pos, CASE WHEN NOT pinned AND pos >= 5 AND mean > 0.6 THEN true WHEN pinned AND pos >= 5 AND mean < 0.2 THEN false ELSE pinned END, (NOT pinned AND pos >= 5 AND mean > 0.6) OR (pinned AND pos >= 5 AND mean < 0.2), {", ".join(t + "_" for t in _TAGS)}
  FROM (SELECT *, {_MEAN} AS mean FROM (SELECT o.item_id, o.n, o.seq, w.pos + o.up AS pos, w.pinned, {_MOVED} FROM w JOIN o ON o.item_id = w.item_id AND o.n = w.n + 1)))
SELECT item_id, seq, pinned FROM w WHERE moved""", True)
def history(spark, d):
    e = B.verdict_events(spark, d).withColumn("raw", F.abs("raw")).withColumn("weight", F.lit(2.0))
    return fb.pin_history(e)


@query("j01_pending", "SELECT session_id FROM audit LEFT JOIN processed USING (session_id) WHERE status IS NULL OR (status <> 'completed' AND retry_count < 3)")
def pending(spark, d):
    return fb.pending(B.audit(spark, d), B.processed(spark, d)).select("session_id")


@query("e01_pending_batch", "SELECT session_id FROM (SELECT session_id, repo FROM audit LEFT JOIN processed USING (session_id) WHERE status IS NULL OR (status <> 'completed' AND retry_count < 3) ORDER BY ts, session_id LIMIT 40) WHERE repo <> 'src5'")
def pending_batch(spark, d):
    return fb.pending(B.audit(spark, d), B.processed(spark, d), 40, ["src5"]).select("session_id")


@query("m13_evaluation_status", "SELECT session_id, arg_max(event_type, event_id) AS status, count(*) FILTER (event_type = 'failed')::INT AS retry_count FROM (SELECT session_id, event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE event_type END AS event_type FROM log) GROUP BY session_id")
def status(spark, d):
    a = B.log(spark, d).select("session_id", F.col("event_id").alias("ts"), F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("status"))
    return fb.evaluation_status(a)


_V = """v AS (SELECT item_id, 'src' || (user_id % 20) AS repo, event_id AS seq, CASE WHEN s > 1 AND event_type = 'error' THEN 1 ELSE s END / 3.0 AS raw FROM (SELECT *, (item_id % 7)::INT - 3 AS s FROM log))
"""


@query("e02_evaluation_batches", """k AS (SELECT DISTINCT session_id, item_id FROM shown WHERE item_id IN (SELECT id FROM items WHERE NOT deprecated)),
p AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY item_id) - 1) // 15 AS batch FROM k)
SELECT session_id, batch::BIGINT AS batch, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM p GROUP BY session_id, batch""")
def evaluation_batches(spark, d):
    got = fb.evaluation_batches(B.shown(spark, d), B.items(spark, d).where("not deprecated"))
    return got.select("session_id", "batch", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("e04_tag_events", _V + "SELECT item_id, 'repo:' || repo AS tag, round(raw, 6) AS raw, seq FROM v WHERE raw <> 0 UNION ALL SELECT v.item_id, tag, round(raw, 6), seq FROM v JOIN item_tags t USING (item_id) WHERE raw <> 0 AND tag NOT LIKE 'repo:%'")
def tag_events(spark, d):
    log = B.log(spark, d)
    v = log.select("item_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("repo"), F.col("event_id").alias("seq"), (F.col("item_id") % 7 - 3).cast("int").alias("score"), F.when(F.col("event_type") == "error", "NO").otherwise("quote").alias("found"))
    return fb.attribution_events(v, B.item_tags(spark, d)).select("item_id", "tag", F.round("raw", 6).alias("raw"), "seq")


@query("e03_weighted_events", _V + """, sm AS (SELECT item_id, tag, ((item_id + length(tag)) % 10) / 10.0 AS sim FROM item_tags),
w AS (SELECT item_id, tag, CASE WHEN sim <= 0.2 THEN 0 ELSE least(pow((sim - 0.2) / 0.8, 2), 1) END AS w FROM sm WHERE tag NOT LIKE 'repo:%'),
h AS (SELECT DISTINCT item_id FROM w WHERE w > 0)
SELECT v.item_id, tag, round(sum(raw * CASE WHEN h.item_id IS NULL THEN 1 ELSE w END), 6) AS total, count(*)::BIGINT AS n FROM v JOIN w USING (item_id) LEFT JOIN h ON h.item_id = v.item_id WHERE raw <> 0 AND (h.item_id IS NULL OR w > 0) GROUP BY ALL""")
def weighted(spark, d):
    log = B.log(spark, d)
    v = log.select("item_id", F.lit(None).cast("string").alias("repo"), F.col("event_id").alias("seq"), (F.col("item_id") % 7 - 3).cast("int").alias("score"), F.when(F.col("event_type") == "error", "NO").otherwise("quote").alias("found"))
    t = B.item_tags(spark, d)
    sim = t.select("item_id", "tag", (((F.col("item_id") + F.length("tag")) % 10) / 10.0).alias("sim"))
    return fb.attribution_events(v, t, sim).groupBy("item_id", "tag").agg(F.round(F.sum("raw"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query("m17_explicit_feedback", "SELECT l.item_id, tag, CASE WHEN event_type = 'purchase' THEN 0.5 ELSE -0.5 END::DOUBLE AS raw, event_id AS seq FROM log l JOIN item_tags USING (item_id) WHERE event_type IN ('purchase', 'error')")
def explicit(spark, d):
    f = B.log(spark, d).where("event_type in ('purchase', 'error')").select("item_id", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("applicable"), F.lit(None).cast("map<string,double>").alias("tag_scores"))
    return fb.explicit_feedback(f, B.item_tags(spark, d)).select("item_id", "tag", "raw", "seq")
