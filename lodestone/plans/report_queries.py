"""Counts, reports, metrics and sweeps (A, E, W)."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import dedup as D
from lodestone.operators import evaluation as E
from lodestone.operators import feedback as fb
from lodestone.operators import metric_join as M
from lodestone.operators import search as S

from . import base as B
from . import search_queries as SQ

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


@query("a01_active_count", "SELECT count(*)::BIGINT AS n FROM items WHERE NOT deprecated")
def active(spark, d):
    return B.items(spark, d).where("not deprecated").agg(F.count(F.lit(1)).alias("n"))


@query("a02_category_counts", "SELECT level1, count(*)::BIGINT AS n FROM items WHERE NOT deprecated GROUP BY level1")
def categories(spark, d):
    return B.items(spark, d).where("not deprecated").groupBy("level1").agg(F.count(F.lit(1)).alias("n"))


@query("a27_status_report", "SELECT 'items' AS what, count(*)::BIGINT AS n FROM items WHERE NOT deprecated UNION ALL SELECT 'pinned', count(*) FROM items WHERE NOT deprecated AND pinned UNION ALL SELECT 'categories', count(DISTINCT category) FROM items WHERE NOT deprecated UNION ALL SELECT 'tags', count(DISTINCT tag) FROM item_tags")
def report(spark, d):
    live = B.items(spark, d).where("not deprecated")
    row = live.agg(F.count(F.lit(1)).alias("items"), F.count_if("pinned").alias("pinned"), F.countDistinct("category").alias("categories"))
    tags = B.item_tags(spark, d).agg(F.countDistinct("tag").alias("tags"))
    return row.crossJoin(tags).unpivot([], ["items", "pinned", "categories", "tags"], "what", "n")


@query("a10_tag_signal", "SELECT count(*)::BIGINT AS n_pairs, count(*) FILTER (score > 0)::BIGINT AS n_positive, count(*) FILTER (score < 0)::BIGINT AS n_negative, count(*) FILTER (pos + neg >= 3)::BIGINT AS n_strong, sum(pos + neg)::BIGINT AS evaluations, round(avg(score), 6) AS mean_score, round(sum(abs(score)), 4) AS total_signal FROM rel")
def signal(spark, d):
    return E.tag_signal(_rel(spark, d)).withColumn("mean_score", F.round("mean_score", 6)).withColumn("total_signal", F.round("total_signal", 4))


@query("a11_evidence_histogram", "SELECT (pos + neg)::BIGINT AS evals, count(*)::BIGINT AS n_pairs, round(avg(score), 6) AS mean_score FROM rel GROUP BY 1")
def histogram(spark, d):
    return E.evidence_histogram(_rel(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query("a12_recovery", "SELECT count(*) FILTER (score < 0)::BIGINT AS n_bad, count(*) FILTER (score < 0 AND pos > 0)::BIGINT AS n_recoverable, round(sum(score) FILTER (score < 0), 4) AS bad_sum FROM rel")
def recovery(spark, d):
    return E.recovery(_rel(spark, d)).withColumn("bad_sum", F.round("bad_sum", 4))


_SUB = """ts AS (SELECT item_id, event_type AS t, user_id % 4 AS u, count(*) AS n FROM log GROUP BY ALL),
sets AS (SELECT item_id, u, list_sort(list(DISTINCT t)) AS s, sum(n) AS m FROM ts GROUP BY item_id, u),
e1 AS (SELECT item_id, u, m, unnest(s) AS a FROM sets),
e2 AS (SELECT x.item_id, x.u, x.m, x.a, y.a AS b FROM e1 x JOIN e1 y ON x.item_id = y.item_id AND x.u = y.u AND x.a < y.a),
e3 AS (SELECT x.item_id, x.u, x.m, x.a, x.b, y.a AS c FROM e2 x JOIN e1 y ON x.item_id = y.item_id AND x.u = y.u AND x.b < y.a),
e4 AS (SELECT x.item_id, x.u, x.m, x.a, x.b, x.c, y.a AS d FROM e3 x JOIN e1 y ON x.item_id = y.item_id AND x.u = y.u AND x.c < y.a),
al AS (SELECT item_id, m, [a] AS s FROM e1 UNION ALL SELECT item_id, m, [a, b] FROM e2 UNION ALL SELECT item_id, m, [a, b, c] FROM e3 UNION ALL SELECT item_id, m, [a, b, c, d] FROM e4),
c AS (SELECT item_id, s, sum(m) AS support FROM al GROUP BY ALL HAVING sum(m) >= 15)
SELECT item_id, array_to_string(s, ',') AS subset, support::BIGINT AS support FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY len(s), s) AS r FROM c) WHERE r = 1"""


@query("a13_tag_subsets", _SUB)
def subsets(spark, d):
    s = B.log(spark, d).groupBy("item_id", (F.col("user_id") % 4).alias("u")).agg(F.collect_set("event_type").alias("tag_set"), F.count(F.lit(1)).alias("times_matched"))
    return E.tag_subsets(s.select("item_id", "tag_set", "times_matched")).select("item_id", F.array_join("subset", ",").alias("subset"), "support")


def _labels(spark, d):
    """Two thirds of the labels are of tool calls, before and after them."""
    q = B.questions(spark, d)
    lab = B.items(spark, d).select(F.col("id").alias("query_id"), "quality")
    j = q.join(lab, "query_id", "left")
    expect = F.when(F.col("quality") == 1, "relevant").when(F.col("quality") == 0, "abstain").otherwise("useful")
    kind = F.when(F.col("query_id") % 3 == 1, "tool").when(F.col("query_id") % 3 == 2, "post_tool")
    return j.select("query_id", expect.alias("expect"), F.array("query_id").alias("expected"), kind.alias("type"))


_LABELS = """lb AS (SELECT query_id, CASE WHEN quality = 1 THEN 'relevant' WHEN quality = 0 THEN 'abstain' ELSE 'useful' END AS expect,
  CASE query_id % 3 WHEN 1 THEN 'tool' WHEN 2 THEN 'post_tool' ELSE 'prompt' END AS type FROM questions LEFT JOIN items ON id = query_id)
"""

_METRICS = ("p1", "p3", "useful", "abstain", "score_std", "separation", "composite", "hook", "interactive")
_MEASURES = """avg((coalesce(top = query_id, false))::INT) FILTER (expect = 'relevant') AS p1, avg(coalesce(hit, false)::INT) FILTER (expect = 'relevant') AS p3,
  avg((best >= 0.40)::INT) FILTER (expect = 'useful') AS useful, avg((best < 0.30)::INT) FILTER (expect = 'abstain') AS abstain, stddev_samp(best) AS score_std,
  coalesce(avg(best) FILTER (expect = 'relevant'), 0) - coalesce(avg(best) FILTER (expect = 'abstain'), 0) AS separation"""


def _shown_sql(k: str = "") -> str:
    c = "coalesce({}, 0)".format
    objective = lambda a, b, d, e, f: f"1 - ({a} * {c('p1')} + {b} * {c('p3')} + {d} * {c('abstain')} + {e} * least(separation, 1) + {f} * {c('useful')})"
    all_three = {"composite": objective(0.35, 0.20, 0.25, 0.10, 0.10), "hook": objective(0.30, 0.15, 0.35, 0.10, 0.10), "interactive": objective(0.25, 0.30, 0.10, 0.10, 0.25)}
    return f"SELECT {k}" + ", ".join(f"round({all_three.get(m, c(m))}, 6) + 0.0 AS {m}" for m in _METRICS) + " FROM m"


def _metrics_sql(source: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    u = f"USING ({k}query_id)"
    base = f"(SELECT DISTINCT {by} FROM {source}), lb" if by else "lb"
    return f"""f AS (SELECT {k}query_id, id AS top, score AS best FROM {source} WHERE rank0 = 0),
h AS (SELECT {k}query_id, bool_or(id = query_id) AS hit FROM {source} WHERE rank0 < 3 GROUP BY ALL),
j AS (SELECT {k}query_id, expect, type, top, coalesce(best, 0) AS best, hit FROM (SELECT * FROM {base}) LEFT JOIN f {u} LEFT JOIN h {u}),
m AS (SELECT {k}{_MEASURES} FROM j {'GROUP BY ' + by if by else ''})
{_shown_sql(k)}"""


def _rounded(m, *keys):
    return m.select(*keys, *((F.round(c, 6) + 0.0).alias(c) for c in _METRICS))


_TOP3 = "t3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank0 FROM fused) WHERE rank0 < 3), "


@query("a14_retrieval_metrics", _LABELS + ", " + _TOP3 + _metrics_sql("t3"))
def metrics(spark, d):
    return _rounded(E.retrieval_metrics(S.top_k(SQ._fused(spark, d)[2], 3), _labels(spark, d)))


#: 1440 configurations: 8 tag weights, 6 repository weights, 6 abstention and 5 least best scores.
_W_TAG, _W_REPO = [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.35, 0.5], [0.0, 0.05, 0.1, 0.2, 0.5, 1.0]
_ABSTAIN, _MIN_TOP1 = [0.0, 0.2, 0.25, 0.3, 0.55, 1.0], [0.0, 0.1, 0.3, 0.4, 0.6]


def _configs(spark):
    rows = itertools.product(enumerate(_W_TAG), enumerate(_W_REPO), enumerate(_ABSTAIN), enumerate(_MIN_TOP1))
    return spark.createDataFrame([(i * 180 + j * 30 + k * 5 + m, a, b, c, e) for (i, a), (j, b), (k, c), (m, e) in rows], "config_id long, w_tag double, w_repo double, abstain double, min_top1 double")


_SWEEP = f"""cf AS (SELECT (i * 180 + j * 30 + k * 5 + m)::BIGINT AS config_id, {_W_TAG}[i + 1]::DOUBLE AS w_tag, {_W_REPO}[j + 1]::DOUBLE AS w_repo, {_ABSTAIN}[k + 1]::DOUBLE AS ab, {_MIN_TOP1}[m + 1]::DOUBLE AS mt
  FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(6)) AS j), (SELECT unnest(range(6)) AS k), (SELECT unnest(range(5)) AS m)),
vb AS (SELECT query_id, max(score) AS vec_best FROM vl GROUP BY query_id),
pt AS (SELECT query_id, id, f.score AS base, coalesce(r.score, 0) AS tag, coalesce(CASE WHEN c.score > 0 THEN 0.05 * least(c.score, 1) WHEN c.score < 0 THEN -0.08 * least(abs(c.score), 1) ELSE 0 END, 0) AS repo, vec_best
  FROM fused f LEFT JOIN vb USING (query_id) LEFT JOIN (SELECT * FROM rel WHERE tag = 'view') r ON r.item_id = id LEFT JOIN (SELECT * FROM rel WHERE tag = 'click' AND pos + neg >= 3) c ON c.item_id = id),
sc AS (SELECT config_id, mt, query_id, id, base + w_tag * tag + w_repo * repo AS score FROM pt, cf WHERE vec_best IS NULL OR vec_best >= ab),
rk AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank0, max(score) OVER (PARTITION BY config_id, query_id) AS b FROM sc),
sw AS (SELECT * FROM rk WHERE rank0 < 3 AND b >= mt)
"""


@query("e07_sweep", _LABELS + ", " + _SWEEP + ", " + _metrics_sql("sw", "config_id"))
def sweep(spark, d):
    """1440 configurations over all questions, re-scored from parts computed once."""
    return _rounded(E.sweep(sweep_parts(spark, d), _labels(spark, d), _configs(spark)), "config_id")


@query("t11_best_configs", _LABELS + ", " + _SWEEP + ", mm AS (" + "WITH " + _metrics_sql("sw", "config_id") + ") SELECT config_id, composite FROM mm ORDER BY round(composite, 9), config_id LIMIT 5")
def best_configs(spark, d):
    return E.best_configs(sweep(spark, d), 5).select("config_id", "composite")


#: preset: content tags, repository prior and feedback (1 or 0), abstention, least best score
_PRESETS = [("semantic_only", 0, 0, 0, 0.0, 0.0), ("semantic_plus_tags", 1, 0, 0, 0.0, 0.0), ("semantic_plus_tags_repo", 1, 1, 0, 0.0, 0.0), ("semantic_plus_filters", 1, 0, 0, 0.55, 0.40), ("hook_current", 1, 1, 1, 0.55, 0.40), ("interactive_current", 1, 1, 1, 0.0, 0.0)]


@query("e08_ablation", _LABELS + ", " + SQ._FULL.replace("max(score) < 0.2", "max(score) < -9") + f""", pz AS (SELECT * FROM (VALUES {str(_PRESETS)[1:-1]}) AS x(preset, wt, wr, wf, ab, mt)),
x AS (SELECT preset, ab, mt, query_id, id, (rrf + wr * repo_delta + wt * tag_affinity + wf * feedback_delta) * recency_multiplier AS score, vec_best AS vb FROM c2 LEFT JOIN (SELECT query_id, max(score) AS vec_best FROM vl GROUP BY query_id) USING (query_id), pz),
rx AS (SELECT *, row_number() OVER (PARTITION BY preset, query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank0, max(score) OVER (PARTITION BY preset, query_id) AS b FROM x),
ax AS (SELECT * FROM rx WHERE rank0 < 3 AND b >= mt AND (vb IS NULL OR vb >= ab)), """ + _metrics_sql("ax", "preset"))
def ablation(spark, d):
    """The six presets, scored from the parts of one search that keeps all candidates."""
    parts = SQ._full(spark, d, diagnostics=True, settings=S.Settings(top=20, abstain_below=-9.0, min_top1=-9.0, tag_penalty=-0.1))
    presets = spark.createDataFrame(_PRESETS, "preset string, wt int, wr int, wf int, ab double, mt double")
    x = parts.crossJoin(F.broadcast(presets))  # two lists of ten a query, six rows
    score = (F.col("rrf_normalized") + F.col("wr") * F.col("repo_delta") + F.col("wt") * F.col("tag_affinity") + F.col("wf") * F.col("feedback_delta")) * F.col("recency_multiplier")
    near = S.rescope(S.nearest(B.vectors(spark, d), B.question_vectors(spark, d)), B.in_scope(spark, d)).groupBy("query_id").agg(F.max("score").alias("vb"))
    w = Window.partitionBy("preset", "query_id")
    x = x.join(near, "query_id", "left").withColumn("score", score)
    x = x.withColumns({"rank0": F.row_number().over(w.orderBy(F.round("score", 9).desc(), "id")) - 1, "b": F.max("score").over(w)})
    best = x.where((F.col("rank0") < 3) & (F.col("b") >= F.col("mt")) & (F.col("vb").isNull() | (F.col("vb") >= F.col("ab"))))
    return _rounded(E.retrieval_metrics(best.select("preset", "query_id", "rank0", "id", "score"), _labels(spark, d), ["preset"]), "preset")


def sweep_parts(spark, d):
    """query_id, id, base, vec_best, tag, repo: what every configuration of the sweep is scored from."""
    _, vec, fused = SQ._fused(spark, d)
    rel = _rel(spark, d)
    best = vec.groupBy("query_id").agg(F.max("score").alias("vec_best"))
    tag = rel.where("tag = 'view'").select(F.col("item_id").alias("id"), F.col("score").alias("tag"))
    return fused.select("query_id", "id", F.col("score").alias("base")).join(best, "query_id", "left").join(tag, "id", "left").join(S.repo_prior(rel, "click").withColumnRenamed("repo_prior", "repo"), "id", "left").na.fill(0.0, ["tag", "repo"])


@query("a15_bucket_metrics", _LABELS + ", " + _TOP3 + _metrics_sql("t3").split("m AS (")[0] + f"""jb AS (SELECT *, unnest(['expect:' || expect, 'type:' || type]) AS bucket FROM j), m AS (SELECT bucket, {_MEASURES} FROM jb GROUP BY bucket) """ + _shown_sql("bucket, "))
def buckets(spark, d):
    """All metrics by expected outcome and by type of query."""
    return _rounded(E.bucket_metrics(S.top_k(SQ._fused(spark, d)[2], 3), _labels(spark, d)), "bucket")


_RANKS = "rk AS (SELECT item_id AS query_id, (day(ts) - 1) // 6 AS round, min(1 + event_id % 25) AS rank FROM log GROUP BY ALL)"


def _ranks(spark, d):
    return B.log(spark, d).groupBy(F.col("item_id").alias("query_id"), F.floor((F.dayofmonth("ts") - 1) / 6).alias("round")).agg(F.min(1 + F.col("event_id") % 25).alias("rank"))


@query("a16_w09_trajectory", _RANKS + """, g AS (SELECT query_id, arg_min(rank, round) AS first_rank, arg_max(rank, round) AS last_rank FROM rk GROUP BY query_id),
c AS (SELECT query_id, min(round) AS converged FROM rk JOIN g USING (query_id) WHERE round >= 1 AND rank = last_rank GROUP BY query_id)
SELECT query_id, first_rank::BIGINT AS first_rank, last_rank::BIGINT AS last_rank, converged::BIGINT AS converged, (first_rank - last_rank)::BIGINT AS improvement FROM g LEFT JOIN c USING (query_id)""")
def trajectory(spark, d):
    return E.trajectory(_ranks(spark, d))


@query("a16_trajectory_summary", _RANKS + """, g AS (SELECT query_id, arg_min(rank, round) AS a, arg_max(rank, round) AS z FROM rk GROUP BY query_id),
c AS (SELECT g.*, coalesce((SELECT min(round) FROM rk WHERE rk.query_id = g.query_id AND round >= 1 AND rank = z), 5) AS conv FROM g)
SELECT count(*)::BIGINT AS total, count(*) FILTER (a > z)::BIGINT AS improved, round(avg(a - z), 6) AS avg_improvement, (count(*) FILTER (z = 1) - count(*) FILTER (a = 1))::BIGINT AS top1_gain,
  (count(*) FILTER (z <= 3) - count(*) FILTER (a <= 3))::BIGINT AS top3_gain, round(avg(conv), 6) AS avg_convergence,
  round((count(*) FILTER (z = 1) - count(*) FILTER (a = 1)) * 3.0 + (count(*) FILTER (z <= 3) - count(*) FILTER (a <= 3)) * 1.5 + count(*) FILTER (a > z) / count(*) * 5.0 + avg(a - z), 6) AS composite FROM c""")
def trajectory_summary(spark, d):
    got = E.trajectory_summary(E.trajectory(_ranks(spark, d)), 5)
    return got.withColumns({c: F.round(c, 6) for c in ("avg_improvement", "avg_convergence", "composite")})


@query("a17_a18_recall", """b AS (SELECT query_id, max(score) AS s FROM v0 WHERE id <> query_id GROUP BY query_id), m AS (SELECT CASE WHEN quality = 0 THEN 'bad' ELSE 'good' END AS kind, s * 2 AS s FROM b LEFT JOIN items ON id = query_id)
SELECT count(*) FILTER (s >= 0.9)::BIGINT AS direct, count(*) FILTER (s < 0.9 AND s >= 0.8)::BIGINT AS borderline, count(*) FILTER (s < 0.8)::BIGINT AS missed, round(avg((s >= 0.85)::INT) FILTER (kind = 'good'), 6) AS recall, round(avg((s < 0.85)::INT) FILTER (kind = 'bad'), 6) AS avoidance FROM m""")
def recall(spark, d):
    n = S.nearest(B.vectors(spark, d), B.question_vectors(spark, d), 2).where("id <> query_id").groupBy("query_id").agg((F.max("score") * 2).alias("similarity"))
    kind = B.items(spark, d).select(F.col("id").alias("query_id"), F.when(F.col("quality") == 0, "bad").otherwise("good").alias("kind"))
    r = E.recall_metrics(n.join(kind, "query_id", "left").na.fill({"kind": "good"}))
    return r.withColumn("recall", F.round("recall", 6)).withColumn("avoidance", F.round("avoidance", 6))


@query("a19_merge_precision", "SELECT round((count(*) FILTER (event_type = 'click') + 0.5 * count(*) FILTER (event_type = 'view')) / count(*) FILTER (event_type <> 'error'), 6) AS precision, count(*) FILTER (event_type <> 'error')::BIGINT AS judged FROM log")
def precision(spark, d):
    v = B.log(spark, d).select(F.when(F.col("event_type") == "click", "correct").when(F.col("event_type") == "view", "partial").otherwise(F.col("event_type")).alias("verdict"))
    return E.merge_precision(v).withColumn("precision", F.round("precision", 6))


@query("e14_judged_evaluations", """e AS (SELECT item_id, avg(s) AS m FROM (SELECT item_id, event_type, avg(value / 250.0 - 1.0) AS s FROM log GROUP BY ALL) GROUP BY item_id),
v AS (SELECT item_id, CASE WHEN m > 0.1 THEN 'POSITIVE' WHEN m < -0.1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction, CASE item_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'questionable' WHEN 2 THEN 'wrong' ELSE 'error' END AS verdict, CASE WHEN item_id % 4 < 3 THEN (item_id % 10) / 10.0 END AS c FROM e)
SELECT direction, verdict, count(*)::BIGINT AS n, round(avg(c), 6) AS mean_confidence FROM v GROUP BY ALL""")
def judged_evaluations(spark, d):
    """Every fourth evaluation got no verdict."""
    tag = B.log(spark, d).groupBy("item_id", "event_type").agg(F.avg(F.col("value") / 250.0 - 1.0).alias("s"))
    e = tag.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "s"))).alias("tag_scores"))
    k = F.col("item_id") % 4
    v = e.where(k < 3).select("item_id", F.when(k == 0, "correct").when(k == 1, "questionable").otherwise("wrong").alias("verdict"), ((F.col("item_id") % 10) / 10.0).alias("confidence"))
    return E.judged_evaluations(e, v).groupBy("direction", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("judge_confidence"), 6).alias("mean_confidence"))


@query("e14_judged_merges", """g AS (SELECT min(id) AS group_id, count(*) AS n_known FROM items GROUP BY text)
SELECT group_id, n_known::BIGINT AS n_known, 0.9::DOUBLE AS original_confidence, CASE group_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'wrong' ELSE 'error' END AS verdict, CASE WHEN group_id % 4 < 3 THEN 0.5::DOUBLE END AS judge_confidence FROM g WHERE n_known >= 2""")
def judged_merges(spark, d):
    """Groups of equal texts, each with an id that no item has; every fourth group got no verdict."""
    i = B.items(spark, d)
    g = i.groupBy("text").agg(F.min("id").alias("group_id"), F.collect_list("id").alias("ids")).select("group_id", F.concat("ids", F.array(-F.col("group_id") - 1)).alias("ids"), F.lit(0.9).alias("confidence"))
    k = F.col("group_id") % 4
    v = g.where(k < 3).select("group_id", F.when(k == 0, "correct").when(k == 1, "partial").otherwise("wrong").alias("verdict"), F.lit(0.5).alias("confidence"))
    return E.judged_merges(g, i, v)


@query("a21_agreement", "s AS (SELECT item_id, tag, CASE WHEN score > 0.1 THEN 1 WHEN score < -0.1 THEN -1 ELSE 0 END AS s FROM rel) SELECT count(*)::BIGINT AS n, round(avg((a.s = b.s)::INT), 6) AS agreement FROM s a JOIN s b USING (item_id) WHERE a.tag = 'click' AND b.tag = 'view'")
def agreement(spark, d):
    r = _rel(spark, d)
    return E.agreement(r.where("tag = 'click'"), r.where("tag = 'view'")).withColumn("agreement", F.round("agreement", 6))


_Y = "y AS (SELECT 'src' || (user_id % 20) AS repo, session_id, count(*) FILTER (event_type = 'purchase') AS positive, count(*) FILTER (event_type IN ('purchase', 'error')) AS total FROM log GROUP BY ALL)"


@query("a31_yield", _Y + " SELECT repo, round(avg(coalesce(positive / nullif(total, 0), 0)), 6) AS mean_ratio, round(sum(positive) / sum(total), 6) AS pooled, count(*)::BIGINT AS n_sessions FROM y GROUP BY repo")
def yields(spark, d):
    y = B.log(spark, d).groupBy(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("repo"), "session_id").agg(F.count_if(F.col("event_type") == "purchase").alias("positive"), F.count_if(F.col("event_type").isin("purchase", "error")).alias("total"))
    return E.yield_by(y, "repo").withColumn("mean_ratio", F.round("mean_ratio", 6)).withColumn("pooled", F.round("pooled", 6))


@query("a20_yield_tiers", """e AS (SELECT 'src' || (user_id % 20) AS repo, session_id, item_id, event_type, avg(value / 250.0 - 1.0) AS s FROM log GROUP BY ALL),
v AS (SELECT repo, CASE item_id % 7 WHEN 0 THEN 'applied' WHEN 1 THEN 'negative' WHEN 2 THEN 'other' ELSE '' END AS rel, avg(s) FILTER (event_type <> 'view') AS m FROM e GROUP BY repo, session_id, item_id),
t AS (SELECT repo, CASE WHEN rel IN ('applied', 'negative') THEN rel WHEN rel <> '' THEN 'neutral' WHEN m > 0.3 THEN 'applied' WHEN m > 0 THEN 'relevant' WHEN m < -0.1 THEN 'negative' ELSE 'neutral' END AS tier FROM v)
SELECT repo, count(*)::BIGINT AS total, count(*) FILTER (tier = 'applied')::BIGINT AS applied, count(*) FILTER (tier = 'relevant')::BIGINT AS relevant, count(*) FILTER (tier = 'neutral')::BIGINT AS neutral,
  count(*) FILTER (tier = 'negative')::BIGINT AS negative, round(count(*) FILTER (tier IN ('applied', 'relevant')) / count(*), 4) AS yield_rate FROM t GROUP BY repo""")
def tiers(spark, d):
    """An evaluation per session and item: mean scores by tag, views aside; some carry a relevance of their own."""
    e = B.log(spark, d).groupBy(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("repo"), "session_id", "item_id", "event_type").agg(F.avg(F.col("value") / 250.0 - 1.0).alias("s"))
    pairs = F.collect_list(F.when(F.col("event_type") != "view", F.struct("event_type", "s")))
    given = F.col("item_id") % 7
    v = e.groupBy("repo", "session_id", "item_id").agg(F.map_from_entries(pairs).alias("tag_scores")).withColumn("relevance", F.when(given == 0, "applied").when(given == 1, "negative").when(given == 2, "other"))
    return E.yield_tiers(v, ["repo"])


_PAIRS = "c AS (SELECT a.id AS a, b.id AS b, round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 9) AS s FROM vn a, vn b WHERE a.id < b.id) "


@query("a28_similarity_summary", _PAIRS + "SELECT round(avg(s), 6) AS mean_sim, round(max(s), 6) AS max_sim, count(*) FILTER (s >= 0.3)::BIGINT AS n_above FROM c")
def distribution(spark, d):
    """Over all pairs a < b of vectors."""
    return E.similarity_summary(M.pair_parts(B.vectors(spark, d), 0.3)).withColumn("mean_sim", F.round("mean_sim", 6)).withColumn("max_sim", F.round("max_sim", 6))


@query("a28_top_pairs", _PAIRS + "SELECT a, b, round(s, 6) AS similarity FROM c WHERE s >= 0.3 ORDER BY s DESC, a, b LIMIT 10")
def top_pairs(spark, d):
    return E.top_pairs(M.pair_parts(B.vectors(spark, d), 0.3), 10).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("a29_reduction", """c AS (SELECT a.id AS x, b.id AS y, list_inner_product(a.e, b.e) / (a.norm * b.norm) AS s FROM vn a, vn b WHERE a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(s, 9) DESC, y) - 1 AS r FROM c WHERE round(s, 9) >= 0.3),
g AS (SELECT list(y) AS ids, row_number() OVER (ORDER BY x) AS n FROM k WHERE r < 8 GROUP BY x),
w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS seen, 0 AS kept
UNION ALL SELECT n, CASE WHEN c THEN list_distinct(list_concat(seen, ids)) ELSE seen END, kept + c::INT FROM (SELECT g.n, seen, kept, ids, len(list_filter(ids, lambda i: NOT list_contains(seen, i))) >= 2 AS c FROM w JOIN g ON g.n = w.n + 1))
SELECT kept::INT AS n_groups, len(seen)::INT AS n_ids, (len(seen) - kept)::INT AS n_removed FROM w ORDER BY n DESC LIMIT 1""", True)
def reduction(spark, d):
    p = D.self_candidates(B.vectors(spark, d), 0.3)
    g = p.groupBy(F.col("source_id").alias("pos")).agg(F.array_sort(F.collect_list("target_id")).alias("ids"))
    return E.reduction(g)


@query("a30_pivot", "SELECT (user_id % 3)::BIGINT AS ctx, round(avg(value) FILTER (event_type = 'click'), 4) AS click, round(avg(value) FILTER (event_type = 'view'), 4) AS view FROM log GROUP BY 1")
def pivot(spark, d):
    r = B.log(spark, d).select((F.col("user_id") % 3).alias("ctx"), F.col("event_type").alias("config"), "value", F.when(~F.col("event_type").isin("click", "view"), "x").alias("error"))
    p = E.pivot_report(r, "ctx", "config", "value")
    return p.select("ctx", F.round("click", 4).alias("click"), F.round("view", 4).alias("view"))


@query("t10_judge_sample", "SELECT item_id, round(avg(score), 6) AS avg_score FROM rel GROUP BY item_id ORDER BY abs(round(avg(score), 9)) DESC, round(avg(score), 9) DESC, item_id DESC LIMIT 15")
def sample(spark, d):
    s = _rel(spark, d).groupBy("item_id").agg(F.avg("score").alias("avg_score"))
    return E.judge_sample(s, 15).select("item_id", F.round("avg_score", 6).alias("avg_score"))


@query("w04_top_gap", "SELECT query_id, round(max(score) FILTER (rank0 = 0) - max(score) FILTER (rank0 = 1), 6) AS gap FROM kw GROUP BY query_id")
def gap(spark, d):
    w = Window.partitionBy("query_id").orderBy("rank0")
    kw = S.bm25(SQ._docs(spark, d), B.questions(spark, d)).withColumn("next", F.lead("score").over(w))
    return kw.where("rank0 = 0").select("query_id", F.round(F.col("score") - F.col("next"), 6).alias("gap"))


@query("w03_rank_of_expected", "SELECT query_id, min(rank0 + 1)::INT AS best_rank FROM kw JOIN items USING (id) WHERE quality = 1 GROUP BY query_id")
def expected(spark, d):
    good = B.items(spark, d).where("quality = 1").select("id")
    return S.bm25(SQ._docs(spark, d), B.questions(spark, d)).join(good, "id", "left_semi").groupBy("query_id").agg(F.min(F.col("rank0") + 1).alias("best_rank"))


@query("e09_divergence", "a AS (SELECT query_id, id AS ia, score AS sa FROM kw WHERE rank0 = 0), b AS (SELECT query_id, id AS ib, score AS sb FROM vl WHERE rank0 = 0) SELECT query_id FROM a FULL JOIN b USING (query_id) WHERE ia IS DISTINCT FROM ib OR abs(coalesce(sa, 0) - coalesce(sb, 0)) > 0.05")
def diverging(spark, d):
    _, kw, vec = SQ._lists(spark, d)
    r = kw.select(F.lit("a").alias("strategy"), "query_id", "id", "score", "rank0").unionByName(vec.select(F.lit("b").alias("strategy"), "query_id", "id", "score", "rank0"))
    return E.divergence(r, "a", "b").select("query_id")
