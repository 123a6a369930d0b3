"""Around the search and upkeep of the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import workspace as W
from lodestone.operators import dedup as D
from lodestone.operators import evaluation as E
from lodestone.operators import feedback as fb
from lodestone.operators import maintenance as U
from lodestone.operators import retrieval as R
from lodestone.operators import search as S
from lodestone.sources import files
from lodestone.sources import transcripts as X
from lodestone.streaming import sessions as Z

from . import base as B
from . import report_queries as RQ
from . import search_queries as SQ
from . import transcript_queries as TQ

QUERIES, ORACLES = {}, {}
_QUESTIONS = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"


def query(name, sql=None, questions=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            whole = B.sql(sql)
            ORACLES[name] = whole.replace(_QUESTIONS, questions) if questions else whole
        return f

    return add


def _rel(spark, d):
    return fb.relevance(B.verdict_events(spark, d))


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- similar items, merge or add ------------------------------------------------------------------
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))"
_SIMILAR = f"""live AS (SELECT id, text FROM items WHERE NOT deprecated),
nv AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM v0),
bv AS (SELECT query_id, arg_min(id, r) AS id FROM nv WHERE r <= 3 AND round(score, 9) >= 0.85 AND id IN (SELECT id FROM live) GROUP BY query_id),
lw AS (SELECT id, {_WORDS} AS w FROM live), qw AS (SELECT query_id, {_WORDS} AS w FROM questions WHERE query_id NOT IN (SELECT query_id FROM bv)),
bw AS (SELECT query_id, min(id) AS id FROM qw, lw WHERE len(qw.w) > 0 AND len(lw.w) > 0 AND len(list_intersect(qw.w, lw.w)) / least(len(qw.w), len(lw.w)) > 0.7 GROUP BY query_id),
si AS (SELECT query_id, id, 'vector' AS via FROM bv UNION ALL SELECT query_id, id, 'words' FROM bw)
"""


def _similar(spark, d):
    live = B.items(spark, d).where("not deprecated").select("id", "text")
    return R.similar_items(live, B.questions(spark, d), B.vectors(spark, d), B.question_vectors(spark, d))


@query("r09_similar_items", _SIMILAR + "SELECT * FROM si")
def similar(spark, d):
    return _similar(spark, d).select("query_id", "id", "via")


@query("p24_overlap_by_larger", f"""qw AS (SELECT query_id, {_WORDS} AS w FROM questions), iw AS (SELECT id, {_WORDS} AS w FROM items),
o AS (SELECT query_id, id, len(list_intersect(qw.w, iw.w)) / greatest(len(qw.w), len(iw.w)) AS overlap FROM qw, iw WHERE len(qw.w) > 0 AND len(iw.w) > 0)
SELECT query_id, id, round(overlap, 6) AS overlap FROM o WHERE overlap > 0.15""")
def overlap_by_larger(spark, d):
    got = R.word_overlaps(B.questions(spark, d).withColumnRenamed("query_id", "a"), B.items(spark, d).select(F.col("id").alias("b"), "text"), 0.15, "max")
    return got.select(F.col("a").alias("query_id"), F.col("b").alias("id"), F.round("overlap", 6).alias("overlap"))


@query("m18_merge_or_add", _SIMILAR + """, x AS (SELECT q.query_id, si.id AS item_id, unnest(list_distinct(['tag' || (q.query_id % 5), 'repo:src' || (q.query_id % 3)])) AS tag FROM questions q LEFT JOIN si USING (query_id))
SELECT 'event' AS what, query_id, item_id, tag FROM x UNION ALL SELECT 'seen', q.query_id, si.id, 'u' || (q.query_id % 7) FROM questions q JOIN si USING (query_id)
UNION ALL SELECT 'new', query_id, NULL, CASE WHEN query_id % 2 = 0 THEN 'a/b' ELSE 'general/misc' END FROM questions WHERE query_id NOT IN (SELECT query_id FROM si)""")
def merge_or_add(spark, d):
    q = F.col("query_id")
    rows = B.questions(spark, d).select("query_id", "text", F.when(q % 2 == 0, "a/b").otherwise("misc").alias("category"), _text("u", q % 7).alias("session_id"), _text("src", q % 3).alias("repo"), F.array(_text(" Tag", q % 5)).alias("tags"))
    out = R.merge_or_add(B.items(spark, d), rows, _similar(spark, d))
    events = out["events"].select(F.lit("event").alias("what"), "query_id", "item_id", "tag")
    seen = out["seen"].select(F.lit("seen").alias("what"), F.col("seq").alias("query_id"), F.col("id").alias("item_id"), F.col("session_id").alias("tag"))
    new = out["new"].select(F.lit("new").alias("what"), "query_id", F.lit(None).cast("long").alias("item_id"), F.col("category").alias("tag"))
    return events.unionByName(seen).unionByName(new)


# --- hooks ----------------------------------------------------------------------------------------
_TOOL = "questions AS (SELECT item_id AS query_id, 'Grep ' || left(text, 100) AS text FROM benchmark)"
_TOP2 = """t AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank0, max(round(score, 4)) OVER (PARTITION BY query_id) AS b FROM fused
  WHERE query_id NOT IN (SELECT query_id FROM vl GROUP BY query_id HAVING max(score) < 0.2))
SELECT query_id, rank0::INT AS rank0, id, round(score, 4) AS score FROM t WHERE rank0 < 2 AND b >= 0.05 AND round(score, 4) >= 0.1"""


@query("r18_tool_search", _TOP2, _TOOL)
def tool_search(spark, d):
    """Tool calls become queries (P08); the two best from a floor on."""
    q = B.questions(spark, d).select("query_id", T.tool_query(F.lit("Grep"), {"pattern": F.col("text")}).alias("text")).where("text is not null")
    return S.search(B.items(spark, d), q, B.vectors(spark, d), B.question_vectors(spark, d), settings=S.Settings(top=2, abstain_below=0.2, min_top1=0.05, floor=0.1))


_HOOK = """t3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank0 FROM fused) WHERE rank0 < 3),
ask AS (SELECT query_id, text, 'u' || (query_id % 9) AS session_id FROM questions),
nw AS (SELECT * FROM (SELECT session_id, query_id, rank0, id, score, row_number() OVER (PARTITION BY session_id, id ORDER BY query_id, rank0) AS n FROM t3 JOIN ask USING (query_id) WHERE score >= 0.02
  AND (session_id, id) NOT IN (SELECT session_id, item_id FROM shown)) WHERE n = 1)
"""


def _hook(spark, d):
    asked = B.questions(spark, d).withColumn("session_id", _text("u", F.col("query_id") % 9))
    found = S.top_k(SQ._fused(spark, d)[2], 3)
    return asked, R.hook(found, asked, B.shown(spark, d), 0.02)


@query("r19_prompt_hook", _HOOK + "SELECT session_id, query_id, id, rank0::INT AS rank0, left(text, 80) AS context FROM nw JOIN ask USING (session_id, query_id)")
def prompt_hook(spark, d):
    """What each prompt newly shows in its session (J07), as logged."""
    asked, new = _hook(spark, d)
    log = R.hook_log(new, asked, "prompt")
    ranks = new.select("session_id", "query_id", "id", "rank0")
    return log.select("session_id", "query_id", "context", F.explode("item_ids").alias("id")).join(ranks, ["session_id", "query_id", "id"]).select("session_id", "query_id", "id", "rank0", "context")


@query("r19_prompt_records", _HOOK + "SELECT session_id, id AS item_id, 'prompt' AS hook_event, text AS query_text FROM nw JOIN ask USING (session_id, query_id)")
def prompt_records(spark, d):
    asked, new = _hook(spark, d)
    return R.hook_records(new, asked, "prompt")


@query("r20_narrated_calls", """c AS (SELECT session_id, event_id AS seq, event_type AS tool, 'n' || (item_id % 3) AS narration FROM log),
l AS (SELECT *, last_value(CASE WHEN tool IN ('click', 'view') THEN narration END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c)
SELECT session_id, seq, narration FROM l WHERE tool IN ('click', 'view') AND narration IS DISTINCT FROM p""")
def narrated(spark, d):
    calls = B.log(spark, d).select("session_id", F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), _text("n", F.col("item_id") % 3).alias("narration"))
    return R.narrated(calls, ["click", "view"]).where("narration is not null").select("session_id", "seq", "narration")


@query("r21_p10_post_tool_query", """SELECT event_id, 'n' || user_id || CASE event_type WHEN 'view' THEN ' b/c/f' || user_id || '.py' WHEN 'click' THEN ' p' || item_id ELSE '' END AS query FROM log""")
def post_tool(spark, d):
    e, u = F.col("event_type"), F.col("user_id")
    tool = F.when(e == "view", "Read").when(e == "click", "Grep").otherwise("Bash")
    return B.log(spark, d).select("event_id", T.post_tool_query(_text("n", u), tool, {"file_path": _text("/a/b/c/f", u, ".py"), "pattern": _text("p", F.col("item_id"))}).alias("query"))


@query("p09_with_narration", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'n' || user_id || ' ' ELSE '' END || event_type AS query FROM log")
def narration(spark, d):
    lead = F.when(F.col("event_id") % 2 == 0, _text("n", F.col("user_id"))).otherwise(F.when(F.col("event_id") % 3 == 0, ""))
    return B.log(spark, d).select("event_id", T.with_narration(lead, F.col("event_type")).alias("query"))


_BARE = r"p AS (SELECT session, line_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b, CASE WHEN line_no % 2 = 0 THEN 'before' END AS prior FROM turns WHERE role = 'user')"


@query("p11_strategies", _BARE + r""", s AS (SELECT *, CASE WHEN prior IS NOT NULL AND len(list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> '')) < 8 THEN prior || ' ' ELSE '' END AS lead FROM p)
SELECT session, line_no, 'strip' AS strategy, md5(b) AS digest FROM s UNION ALL SELECT session, line_no, 'strip+file', md5('[file: b/c/d.py] ' || b) FROM s UNION ALL SELECT session, line_no, 'strip+prior', md5(lead || b) FROM s UNION ALL SELECT session, line_no, 'full', md5('[file: b/c/d.py] ' || lead || b) FROM s""")
def strategies(spark, d):
    t = B.turns(spark, d).where("role = 'user'").withColumn("prompt", F.concat(F.lit("<task-notification>x\ny</task-notification>\n"), "text")).withColumn("prior", F.when(F.col("line_no") % 2 == 0, "before"))
    each = [F.struct(F.lit(s).alias("strategy"), F.md5(T.enrichment(s, F.col("prompt"), F.col("prior"), F.lit("/a/b/c/d.py"))).alias("digest")) for s in ("strip", "strip+file", "strip+prior", "full")]
    return t.select("session", "line_no", F.inline(F.array(*each)))


@query("r25_backfill", """t5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM fused) WHERE r <= 5)
SELECT 'u' || (query_id % 9) AS session_id, string_agg(DISTINCT id::VARCHAR, ',' ORDER BY id::VARCHAR) AS ids FROM t5 GROUP BY 1""")
def backfill(spark, d):
    """All prompts of all sessions in one search; what each session would have been shown."""
    asked = B.questions(spark, d).select("query_id", _text("u", F.col("query_id") % 9).alias("session_id"))
    got = R.would_have_shown(S.top_k(SQ._fused(spark, d)[2], 5), asked)
    return got.select("session_id", F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ",").alias("ids"))


@query("r26_auto_tags", SQ._TAGV.replace("m > 3", "m > 5") + "SELECT query_id AS id, tag, rank0::INT AS rank0 FROM pt WHERE rank0 < 5", "questions AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 1) AND doc_id NOT IN (SELECT id FROM items WHERE deprecated))")
def auto_tags(spark, d):
    """Items without a tag (odd ids, here) get the tags their own vector is about."""
    v = B.vectors(spark, d)
    label = F.concat(F.lit("label"), F.col("label").cast("string"))
    held = v.where("id % 2 = 0").select(F.col("id").alias("item_id"), label.alias("tag"))
    bare = R.untagged(B.items(spark, d), held).select("id", "text").join(v.select("id", "embedding"), "id")
    sim = bare.select(F.col("id").alias("query_id"), F.col("embedding").alias("qe")).crossJoin(F.broadcast(SQ._tag_vectors(spark, d))).select("query_id", "tag", T.cosine("qe", "embedding").alias("sim"))
    vocabulary = v.groupBy(label.alias("tag")).agg(F.count(F.lit(1)).alias("freq"))
    return S.prompt_tags(sim, vocabulary, bare.select(F.col("id").alias("query_id"), "text"), top=5, least=0.2).select(F.col("query_id").alias("id"), "tag", "rank0")


@query("s25_last_search", "SELECT query_id, rank0::INT AS rank0, id, left(i.text, 100) AS text FROM kw JOIN items i USING (id)")
def last_search(spark, d):
    kept = R.last_search(S.bm25(SQ._docs(spark, d), B.questions(spark, d)), B.questions(spark, d), B.items(spark, d))
    return kept.select("query_id", F.inline("results")).select("query_id", "rank0", "id", "text")


# --- the older blend ------------------------------------------------------------------------------
_BLEND = """wt AS (SELECT * FROM (VALUES (0, 0.6, 0.4), (1, 0.7, 0.3), (2, 0.8, 0.2), (3, 1.0, 0.0)) AS x(config_id, ws, wg)),
ts AS (SELECT query_id, id, ((id + query_id) % 100) / 100.0 AS sim FROM fused WHERE id IN (SELECT id FROM vec)),
bl AS (SELECT config_id, f.query_id, f.id, ws * rrf / max(rrf) OVER (PARTITION BY config_id, f.query_id) + wg * CASE WHEN sim IS NULL THEN 0.5 ELSE greatest(0, least(1, (sim - 0.65) / 0.30)) END AS b FROM wt, fused f LEFT JOIN ts USING (query_id, id))
"""


def _blend(spark, d):
    fused = SQ._fused(spark, d)[2].select("query_id", "id", "rrf")
    tagged = B.vectors(spark, d).select("id")
    sims = fused.join(tagged, "id", "left_semi").select("query_id", "id", (((F.col("id") + F.col("query_id")) % 100) / 100.0).alias("sim"))
    weights = spark.createDataFrame([(0, 0.6, 0.4), (1, 0.7, 0.3), (2, 0.8, 0.2), (3, 1.0, 0.0)], "config_id int, w_semantic double, w_tag double")
    return R.blended(fused, sims, weights)


@query("r23_r30_blend", _BLEND + "SELECT config_id::INT AS config_id, query_id, id, round(b, 6) AS blended FROM bl")
def blend(spark, d):
    return _blend(spark, d).select("config_id", "query_id", "id", F.round("blended", 6).alias("blended"))


@query("r24_blend_grid", _BLEND + """, mr AS (SELECT item_id AS id, sum(score) / 2 AS a, sum(pos + neg) AS n FROM rel WHERE tag IN ('click', 'view') GROUP BY item_id),
gr AS (SELECT (i * 3 + j)::INT AS grid_id, [0.0, 0.05, 0.2][i + 1]::DOUBLE AS w, [0.0, 0.3, 0.6][j + 1]::DOUBLE AS m FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j))
SELECT grid_id, config_id::INT AS config_id, count(*)::BIGINT AS n, round(avg(b + coalesce(a, 0) / 3 * w), 6) AS mean FROM bl LEFT JOIN mr USING (id), gr WHERE NOT (coalesce(n, 0) >= 3 AND coalesce(a, 0) < -0.1) AND b + coalesce(a, 0) / 3 * w >= m GROUP BY 1, 2""")
def blend_grid(spark, d):
    means = fb.mean_over_requested(B.items(spark, d), _rel(spark, d), ["click", "view"])
    grid = spark.createDataFrame([(i * 3 + j, w, m) for i, w in enumerate((0.0, 0.05, 0.2)) for j, m in enumerate((0.0, 0.3, 0.6))], "grid_id int, w_relevance double, min_score double")
    got = R.blend_grid(_blend(spark, d), means, grid)
    return got.groupBy("grid_id", "config_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("final"), 6).alias("mean"))


# --- simulated feedback ---------------------------------------------------------------------------
_SIM = """cf AS (SELECT (i * 5 + j)::INT AS config_id, [0.1, 0.2, 0.3, 0.4, 0.5, 0.7][i + 1]::DOUBLE AS alpha, [0.05, 0.1, 0.2, 0.4, 0.8][j + 1]::DOUBLE AS w FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(5)) AS j)),
ft AS (SELECT t.item_id AS id, count(*) AS n_tags, sum(coalesce(r.score, 0)) / count(*) AS a, sum(coalesce(pos + neg, 0)) AS n FROM item_tags t LEFT JOIN rel r USING (item_id, tag) GROUP BY 1),
pt AS (SELECT query_id, f.id, f.score AS base, coalesce(a, 0) AS a, coalesce(n, 0) AS n, coalesce(n_tags, 0) AS n_tags, coalesce(i.quality = 1, false) AS ex FROM fused f JOIN items i USING (id) LEFT JOIN ft USING (id)),
rd AS (SELECT config_id, w, query_id, id, r, base, ex, CASE WHEN ex AND n_tags > 0 THEN pow(1 - alpha, r) * a + 2.0 / 3 * (1 - pow(1 - alpha, r)) ELSE a END AS a, CASE WHEN ex AND n_tags > 0 THEN n + r * n_tags ELSE n END AS n FROM pt, cf, (SELECT unnest(range(6)) AS r)),
rk AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id, r ORDER BY round(base + w * a, 9) DESC, id) AS rank FROM rd WHERE NOT (n >= 3 AND a < -0.1)),
pr AS (SELECT config_id, query_id, r, min(rank) FILTER (ex) AS rank FROM rk GROUP BY ALL)
"""


def _simulated(spark, d):
    tags, rel = B.item_tags(spark, d), _rel(spark, d)
    means = tags.join(rel, ["item_id", "tag"], "left").groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("n_tags"), (F.sum(F.coalesce("score", F.lit(0.0))) / F.count(F.lit(1))).alias("avg_rel"), F.sum(F.coalesce(F.col("positive_evals") + F.col("negative_evals"), F.lit(0))).alias("evals"))
    good = B.items(spark, d).select("id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("expected"))
    parts = SQ._fused(spark, d)[2].select("query_id", "id", F.col("score").alias("base")).join(good, "id").join(means, "id", "left").na.fill(0.0, ["avg_rel"]).na.fill(0, ["evals", "n_tags"])
    rows = [(i * 5 + j, a, w) for i, a in enumerate((0.1, 0.2, 0.3, 0.4, 0.5, 0.7)) for j, w in enumerate((0.05, 0.1, 0.2, 0.4, 0.8))]
    return R.simulated_ranks(parts, spark.createDataFrame(rows, "config_id int, alpha double, weight double"))


@query("e10_attribution_rounds", _SIM + "SELECT config_id, query_id, r::INT AS round, rank::INT AS rank FROM pr")
def rounds(spark, d):
    return _simulated(spark, d)


@query("e11_attribution_sweep", _SIM + """, z AS (SELECT config_id, query_id, r, coalesce(rank, 21) AS rank FROM pr), g AS (SELECT config_id, query_id, arg_min(rank, r) AS a, arg_max(rank, r) AS z FROM z GROUP BY ALL),
c AS (SELECT config_id, query_id, min(r) AS c FROM z JOIN g USING (config_id, query_id) WHERE r >= 1 AND z.rank = g.z GROUP BY ALL)
SELECT config_id, count(*)::BIGINT AS n, round(avg(a - z), 6) + 0.0 AS improvement, round(avg((a > z)::INT), 6) AS improvement_rate, (count(*) FILTER (z <= 1) - count(*) FILTER (a <= 1))::BIGINT AS top1_gain, (count(*) FILTER (z <= 3) - count(*) FILTER (a <= 3))::BIGINT AS top3_gain, round(avg(c), 6) AS convergence,
round(3 * (count(*) FILTER (z <= 1) - count(*) FILTER (a <= 1)) + 1.5 * (count(*) FILTER (z <= 3) - count(*) FILTER (a <= 3)) + 5 * avg((a > z)::INT) + avg(a - z), 6) AS composite FROM g LEFT JOIN c USING (config_id, query_id) GROUP BY config_id""")
def attribution_sweep(spark, d):
    m = R.simulation_summary(_simulated(spark, d))
    return m.withColumns({c: F.round(c, 6) for c in ("improvement", "improvement_rate", "convergence", "composite")})


# --- labels and gates -----------------------------------------------------------------------------
@query("j13_by_prefix", """p AS (SELECT query_id AS pos, CASE WHEN query_id % 2 = 0 THEN text ELSE left(text, 45) || ' and more' END AS prompt FROM questions)
SELECT pos, min(query_id) AS idx FROM p, questions WHERE contains(left(prompt, 60), left(text, 60)) OR contains(text, left(left(prompt, 60), 40)) GROUP BY pos""")
def by_prefix(spark, d):
    q = B.questions(spark, d)
    prompts = q.select(F.col("query_id").alias("pos"), F.when(F.col("query_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.substring("text", 1, 45), F.lit(" and more"))).alias("prompt"))
    return R.by_prefix(prompts, q.select(F.col("query_id").alias("idx"), F.col("text").alias("query")))


_LAB = """lv AS (SELECT i.id, i.source, i.quality, i.source_session, v.e, v.norm FROM items i JOIN vn v USING (id)),
"""


def _labelled(spark, d):
    i = B.items(spark, d).select("id", "source", "quality", "dedup_verified", "deprecated", "source_sessions").join(B.vectors(spark, d).select("id", "embedding"), "id")
    lab = i.where("quality is not null").select(F.col("id").alias("label_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("kind"), F.col("source").alias("session_id"), "embedding")
    return i, lab


@query("j14_best_in_session", _LAB + """j AS (SELECT a.id AS label_id, a.quality, b.id, round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 9) AS s FROM lv a JOIN lv b USING (source) WHERE a.quality IS NOT NULL AND b.quality IS NULL),
m AS (SELECT label_id, quality, max(s) AS s, arg_max(id, (s, -id)) AS id FROM j GROUP BY ALL)
SELECT label_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS kind, round(greatest(0, s), 6) AS similarity, CASE WHEN s > 0 THEN id END AS match FROM m""")
def best_in_session(spark, d):
    i, lab = _labelled(spark, d)
    got = R.best_in_session(lab, i.where("quality is null").select(F.col("source").alias("session_id"), "id", "embedding"))
    return got.withColumn("similarity", F.round("similarity", 6))


@query("a22_e12_gate_outcome", _LAB + """vd AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'reject' ELSE 'keep' END AS verdict FROM lv), gm AS (SELECT id // 10 AS group_id, id FROM lv WHERE id % 10 IN (1, 2)),
gm2 AS (SELECT * FROM gm WHERE group_id IN (SELECT group_id FROM gm GROUP BY 1 HAVING count(*) = 2)), ge AS (SELECT group_id, min(id) AS rep FROM gm2 GROUP BY 1),
al AS (SELECT lv.* FROM lv JOIN vd USING (id) WHERE verdict = 'keep' AND id NOT IN (SELECT id FROM gm2)),
pl AS (SELECT source, e, norm FROM al UNION ALL SELECT m.source, r.e, r.norm FROM gm2 JOIN lv m USING (id) JOIN ge USING (group_id) JOIN lv r ON r.id = rep),
bs AS (SELECT a.id, a.quality, max(round(list_inner_product(a.e, p.e) / (a.norm * p.norm), 9)) AS b FROM lv a JOIN pl p USING (source) WHERE a.quality IS NOT NULL GROUP BY ALL)
SELECT (SELECT count(*) FROM vd WHERE verdict = 'keep')::BIGINT AS kept, (SELECT count(*) FROM vd WHERE verdict = 'reject')::BIGINT AS rejected, (SELECT count(*) FROM ge)::BIGINT AS merged_groups, (SELECT count(*) FROM gm2)::BIGINT AS merged_items,
count(*) FILTER (quality = 1 AND b >= 0.85)::BIGINT AS good_found, count(*) FILTER (quality = 1)::BIGINT AS good_total, count(*) FILTER (quality = 0 AND b < 0.85)::BIGINT AS bad_avoided, count(*) FILTER (quality = 0)::BIGINT AS bad_total, ((SELECT count(*) FROM al) + (SELECT count(*) FROM ge))::BIGINT AS final,
round(coalesce(100.0 * count(*) FILTER (quality = 1 AND b >= 0.85) / nullif(count(*) FILTER (quality = 1), 0), 0), 6) AS good_recall, round(coalesce(100.0 * count(*) FILTER (quality = 0 AND b < 0.85) / nullif(count(*) FILTER (quality = 0), 0), 0), 6) AS bad_avoidance FROM bs""")
def gate(spark, d):
    i, lab = _labelled(spark, d)
    items = i.select("id", F.col("source").alias("session_id"), "embedding")
    verdicts = i.select("id", F.when(F.col("id") % 3 == 0, "reject").otherwise("keep").alias("verdict"))
    g = i.where("id % 10 in (1, 2)").groupBy(F.floor(F.col("id") / 10).alias("group_id")).agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("embedding", "id").alias("embedding")).where(F.size("ids") == 2)
    return U.gate_outcome(items, verdicts, g, lab).withColumn("good_recall", F.round("good_recall", 6)).withColumn("bad_avoidance", F.round("bad_avoidance", 6))


@query("a23_pass_totals", "SELECT count(*)::BIGINT AS passes, sum(n)::BIGINT AS merged, sum(k)::BIGINT AS absorbed, sum(v)::BIGINT AS verified, sum(f)::BIGINT AS failed FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS n, count(DISTINCT item_id) AS k, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'error') AS f FROM log GROUP BY 1)")
def totals(spark, d):
    hit = lambda t: F.count_if(F.col("event_type") == t)
    p = B.log(spark, d).groupBy(F.col("user_id").alias("pass")).agg(hit("click").alias("merged"), F.count_distinct("item_id").alias("absorbed"), hit("view").alias("verified"), hit("error").alias("failed"))
    return U.pass_totals(p)


_CONFIRMED = _LAB + """sk AS (SELECT 'u' || n AS session_id FROM (SELECT unnest(range(0, 150, 7)) AS n)),
ex AS (SELECT source_session AS session_id, e, norm FROM lv WHERE id % 2 = 0 AND quality IS NULL),
b AS (SELECT lv.id, max(round(list_inner_product(lv.e, ex.e) / (lv.norm * ex.norm), 9)) AS s FROM lv LEFT JOIN ex ON ex.session_id = lv.source_session WHERE source_session NOT IN (SELECT session_id FROM sk) GROUP BY 1)
"""


@query("e05_confirmations", _CONFIRMED + "SELECT lv.id, CASE WHEN b.id IS NULL THEN 'skipped' WHEN s >= 0.8 THEN 'confirmed' ELSE 'unconfirmed' END AS result FROM lv LEFT JOIN b USING (id)")
def confirmations(spark, d):
    return _confirmed(spark, d)[1]


def _confirmed(spark, d):
    i, _ = _labelled(spark, d)
    extracted = i.where("id % 2 = 0 and quality is null").select(F.explode("source_sessions").alias("session_id"), "embedding")
    skipped = spark.range(0, 150, 7).select(_text("u", F.col("id")).alias("session_id"))
    return i, U.confirmations(i, extracted, skipped)


@query("e06_pruned", _CONFIRMED + "SELECT i.id, i.deprecated OR (b.id IS NOT NULL AND coalesce(s, -1) < 0.8) AS deprecated FROM items i JOIN lv USING (id) LEFT JOIN b USING (id)")
def pruned(spark, d):
    i, results = _confirmed(spark, d)
    items = B.items(spark, d).join(i.select("id"), "id", "left_semi")
    return U.pruned(items, results).select("id", "deprecated")


# --- upkeep ---------------------------------------------------------------------------------------
@query("j18_environment_tags", "SELECT i.id, 'en,repo:' || a.repo AS tags FROM items i JOIN audit a ON a.session_id = i.source_session")
def environment_tags(spark, d):
    return U.environment_tags(B.items(spark, d), B.audit(spark, d)).select("id", F.array_join("tags", ",").alias("tags"))


@query("m14_reset_stats", "SELECT id, false AS pinned, 0 AS times_matched, 0::BIGINT AS repo_rows FROM items")
def reset(spark, d):
    i = B.items(spark, d).withColumn("times_matched", F.col("occurrence_count")).withColumn("last_matched", F.col("refreshed_at"))
    after, stats = U.reset_stats(i, i.select(F.col("id").alias("item_id"), F.lit("r").alias("repo")))
    return after.where("last_matched is null").crossJoin(F.broadcast(stats.agg(F.count(F.lit(1)).alias("repo_rows")))).select("id", "pinned", "times_matched", "repo_rows")


@query("m15_backfill_prerequisites", "SELECT id, CASE WHEN id % 4 = 0 THEN 'own' WHEN contains(lower(text), 'figma mcp') OR contains(lower(text), 'figma server') OR id % 3 = 0 THEN 'new' END AS prerequisites FROM items")
def prerequisites(spark, d):
    i = B.items(spark, d).withColumn("prerequisites", F.when(F.col("id") % 4 == 0, "own"))
    inferred = i.where(T.inferred_servers("text").isNotNull() | (F.col("id") % 3 == 0)).select("id", F.lit("new").alias("prerequisites"))
    return U.backfill_prerequisites(i, inferred).select("id", "prerequisites")


@query("m20_add_tags", "SELECT item_id, tag FROM item_tags UNION SELECT id, 'topic' || (id % 5) FROM items UNION SELECT id, 'en' FROM items WHERE id % 2 = 0")
def add_tags(spark, d):
    i = B.items(spark, d)
    new = i.select(F.col("id").alias("item_id"), _text(" Topic", F.col("id") % 5, " ").alias("tag")).unionByName(i.where("id % 2 = 0").select(F.col("id").alias("item_id"), F.lit("EN").alias("tag"))).unionByName(i.select(F.col("id").alias("item_id"), F.lit("  ").alias("tag")))
    return U.add_tags(B.item_tags(spark, d), new).select("item_id", "tag")


@query("m22_pins", """SELECT r.id, CASE WHEN i.id IS NOT NULL THEN r.id % 2 = 0 END AS pinned, CASE WHEN i.id IS NULL THEN 'not found' WHEN r.id % 2 = 0 AND i.pinned THEN 'already pinned' WHEN r.id % 2 = 1 AND NOT i.pinned THEN 'not pinned' WHEN r.id % 2 = 0 THEN 'pinned' ELSE 'unpinned' END AS message
FROM (SELECT DISTINCT item_id AS id FROM log) r LEFT JOIN items i USING (id)""")
def pins(spark, d):
    asked = B.log(spark, d).select(F.col("item_id").alias("id")).distinct().withColumn("pin", F.col("id") % 2 == 0)
    return U.set_pins(B.items(spark, d), asked)


@query("m23_extra_categories", "SELECT id AS item_id, category AS path FROM items UNION SELECT id, 'extra/topic' FROM items WHERE id % 3 = 0 AND id % 6 <> 0")
def extra_categories(spark, d):
    i = B.items(spark, d)
    base = i.select(F.col("id").alias("item_id"), F.col("category").alias("path"))
    more = U.add_categories(base, i.where("id % 3 = 0").select(F.col("id").alias("item_id"), F.lit("/extra//topic/").alias("path")))
    gone = i.where("id % 6 = 0").select(F.col("id").alias("item_id"), F.lit("extra/topic").alias("path"))
    return U.remove_categories(more, gone.unionByName(base), i)


@query("m25_deprecate", """c AS (SELECT id FROM items WHERE NOT deprecated AND id % 4 = 0)
SELECT 'log' AS what, id FROM c UNION ALL SELECT 'index', id FROM vec WHERE id NOT IN (SELECT id FROM items WHERE deprecated) AND id NOT IN (SELECT id FROM c) UNION ALL SELECT 'item', id FROM items WHERE deprecated OR id IN (SELECT id FROM c)""")
def deprecate(spark, d):
    i = B.items(spark, d)
    out = U.deprecate(i, i.where("id % 4 = 0").select("id", F.lit("old").alias("reason")), B.vectors(spark, d))
    return out["log"].select(F.lit("log").alias("what"), "id").unionByName(out["index"].select(F.lit("index").alias("what"), "id")).unionByName(out["items"].where("deprecated").select(F.lit("item").alias("what"), "id"))


@query("a26_merged_context", """x AS (SELECT session_id, item_id, min(seq) AS pos, min(CASE WHEN seq % 3 = 0 THEN 't' || seq END) AS prompt_tags, CASE WHEN item_id % 2 = 0 THEN '' ELSE 'q' || item_id END AS query_text FROM shown GROUP BY session_id, item_id),
y AS (SELECT session_id, CASE WHEN item_id % 5 = 1 THEN item_id - 1 ELSE item_id END AS to_id, (item_id % 5 = 1)::INT AS late, pos, prompt_tags, query_text FROM x)
SELECT session_id, to_id AS item_id, arg_min(prompt_tags, (late, pos)) FILTER (prompt_tags IS NOT NULL AND prompt_tags <> '') AS prompt_tags, arg_min(query_text, (late, pos)) FILTER (query_text <> '') AS query_text FROM y GROUP BY 1, 2""")
def context(spark, d):
    s = B.shown(spark, d)
    c = s.groupBy("session_id", "item_id").agg(F.min("seq").alias("pos"), F.min(F.when(F.col("seq") % 3 == 0, _text("t", F.col("seq")))).alias("prompt_tags")).withColumn("query_text", F.when(F.col("item_id") % 2 == 0, "").otherwise(_text("q", F.col("item_id")))).withColumn("hook_event", F.lit("view"))
    ids = s.select("item_id").distinct().where("item_id % 5 = 1").select(F.col("item_id").alias("absorbed"), (F.col("item_id") - 1).alias("survivor"))
    return U.merged_context(c, ids).select("session_id", "item_id", "prompt_tags", "query_text")


@query("a09_merged_counters", """m AS (SELECT item_id, 'r' || (user_id % 4) AS repo, count(*) AS n, max(ts) AS t FROM log GROUP BY ALL)
SELECT CASE WHEN item_id % 5 = 1 THEN item_id - 1 ELSE item_id END AS item_id, repo, sum(n)::INT AS times_matched, max(t) AS last_matched FROM m GROUP BY 1, 2""")
def counters(spark, d):
    log = B.log(spark, d)
    stats = log.groupBy("item_id", _text("r", F.col("user_id") % 4).alias("repo")).agg(F.count(F.lit(1)).cast("int").alias("times_matched"), F.max("ts").alias("last_matched"))
    ids = log.select("item_id").distinct().where("item_id % 5 = 1").select(F.col("item_id").alias("absorbed"), (F.col("item_id") - 1).alias("survivor"))
    return D.merge_counters(stats, ids, "repo")


@query("x10_target_candidates", """c AS (SELECT b.id, list_inner_product(a.e, b.e) / (a.norm * b.norm) AS s FROM vn a, vn b WHERE a.id = 5 AND b.id <> 5)
SELECT 5::BIGINT AS source_id, id AS target_id, round(s, 6) AS similarity FROM c WHERE round(s, 9) >= 0.1 ORDER BY round(s, 9) DESC, id LIMIT 8""")
def target(spark, d):
    return U.target_candidates(B.vectors(spark, d), 5, 0.1).select("source_id", "target_id", F.round("similarity", 6).alias("similarity"))


@query("x11_curation_due", "SELECT count(*) >= 100 AS due, count(*)::BIGINT AS waiting FROM items WHERE NOT deprecated AND (status IS NULL OR status & 1 = 0)")
def due(spark, d):
    return U.curation_due(B.items(spark, d))


@query("x12_curation_run", """w AS (SELECT id FROM items WHERE NOT deprecated AND (status IS NULL OR status & 1 = 0)), k AS (SELECT id FROM w WHERE id % 3 <> 0),
g AS (SELECT id // 6 AS group_id, id FROM k), s AS (SELECT group_id, min(id) AS survivor FROM g GROUP BY 1 HAVING count(*) >= 2)
SELECT 'merge' AS what, id, survivor AS other FROM g JOIN s USING (group_id) WHERE id <> survivor UNION ALL SELECT 'status', id, CASE WHEN id IN (SELECT id FROM w) THEN CASE WHEN id % 3 = 0 THEN 3 ELSE 1 END ELSE status END FROM items""")
def curation_run(spark, d):
    i = B.items(spark, d)
    verdicts = i.select("id", F.when(F.col("id") % 3 == 0, "reject").otherwise("keep").alias("verdict"))
    groups = i.groupBy(F.floor(F.col("id") / 6).alias("group_id")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    after, merges = U.curation_run(i, verdicts, groups)
    return merges.select(F.lit("merge").alias("what"), F.col("absorbed").alias("id"), F.col("survivor").alias("other")).unionByName(after.select(F.lit("status").alias("what"), "id", F.col("status").cast("long").alias("other")))


@query("x04_validated_groups", """e AS (SELECT id // 4 AS batch, id AS pos, id AS a, CASE WHEN id % 7 = 0 THEN id ELSE id + 1 END AS b, CASE WHEN id % 11 = 0 THEN 1.5 ELSE 0.9 END AS c FROM items),
f AS (SELECT *, CASE WHEN a = b THEN 'size' WHEN b NOT IN (SELECT id FROM items) THEN 'unknown' END AS p FROM e)
SELECT batch, pos, p AS problem FROM f WHERE p IS NOT NULL""")
def validated(spark, d):
    """Groups of two neighbours; here those of wrong size or with an unknown id (the fold of the rest is in the tests)."""
    i = F.col("id")
    ids = F.array(i, F.when(i % 7 == 0, i).otherwise(i + 1))
    g = B.items(spark, d).select(F.floor(i / 4).alias("batch"), i.alias("pos"), ids.alias("ids"), F.lit("t").alias("canonical_text"), F.when(i % 11 == 0, 1.5).otherwise(0.9).alias("confidence"), F.lit("r").alias("reason"))
    return D.validated(g, B.items(spark, d)).where("problem in ('size', 'unknown')").select("batch", "pos", "problem")


@query("a25_merged_prerequisites", """p AS (SELECT id, CASE WHEN id % 5 = 1 THEN id - 1 ELSE id END AS k, ['os' || (id % 2)] AS os, CASE WHEN id % 3 = 0 THEN ['s1'] ELSE ['s1', 's2'] END AS servers FROM items WHERE id % 5 < 2)
SELECT k AS id, array_to_string(list_sort(list_distinct(flatten(list(os)))), ',') AS os, CASE WHEN bool_and(list_contains(servers, 's2')) THEN 's1,s2' ELSE 's1' END AS servers FROM p GROUP BY k""")
def merged_prerequisites(spark, d):
    i = B.items(spark, d).where("id % 5 < 2")
    n = F.col("id")
    none = F.array().cast("array<string>")
    pre = F.struct(F.array(_text("os", n % 2)).alias("os"), none.alias("repos"), none.alias("paths"), F.when(n % 3 == 0, F.array(F.lit("s1"))).otherwise(F.array(F.lit("s1"), F.lit("s2"))).alias("mcp_servers"), F.lit(False).alias("auto_pinned"))
    ids = i.where("id % 5 = 1").select(n.alias("absorbed"), (n - 1).alias("survivor"))
    out = D.merge_prerequisites(i.select("id", pre.alias("prerequisites")), ids)
    return out.select("id", F.array_join("os", ",").alias("os"), F.array_join("mcp_servers", ",").alias("servers"))


# --- expressions ----------------------------------------------------------------------------------
@query("p13_prerequisites", """SELECT id, (id % 3 = 0 OR id % 2 = 0) AND (id % 4 <> 1 OR id % 5 = 0) AS met FROM items""")
def prerequisites_met(spark, d):
    n = F.col("id")
    none = F.lit(None).cast("array<string>")
    pre = F.when(n % 60 != 59, F.struct(F.when(n % 3 != 0, F.array(F.lit("linux"))).otherwise(none).alias("os"), F.when(n % 4 == 1, F.array(F.lit("/work/a/"))).otherwise(none).alias("paths"), none.alias("mcp_servers")))
    env = B.items(spark, d).withColumn("pre", F.coalesce(pre, F.struct(F.array(F.lit("linux")).alias("os"), none.alias("paths"), none.alias("mcp_servers"))))
    return env.select("id", T.meets_prerequisites("pre", F.when(n % 2 == 0, "linux").otherwise("darwin"), F.when(n % 5 == 0, "/work/a/b").otherwise("/work/ab"), F.array().cast("array<string>")).alias("met"))


@query("p16_workspace_tags", """SELECT DISTINCT 'w' || (user_id % 7) AS workspace, unnest(CASE event_type WHEN 'click' THEN ['github', 'repo:r' || (item_id % 3)] WHEN 'view' THEN ['python'] WHEN 'error' THEN ['react', 'frontend'] WHEN 'purchase' THEN ['monorepo'] ELSE ['rails', 'backend'] END) AS tag FROM log""")
def workspace_tags(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "click", "remote").when(e == "view", "file").when(e == "error", "dep").when(e == "purchase", "dir").otherwise("gem")
    value = F.when(e == "click", _text("git@github.com:a/R", F.col("item_id") % 3, ".git")).when(e == "view", "requirements.txt").when(e == "error", "react").when(e == "purchase", "apps/").otherwise("rails")
    return W.workspace_tags(B.log(spark, d).select(_text("w", F.col("user_id") % 7).alias("workspace"), kind.alias("kind"), value.alias("value")))


@query("p21_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 0")
def parsed(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    broken = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return e.select("event_id", T.merged_json(broken, "k long")["k"].alias("k"))


@query("p28_injected_block", "SELECT category, 'Known:' || chr(10) || string_agg('- ' || id, chr(10) ORDER BY id) AS block FROM items GROUP BY category")
def injected(spark, d):
    g = B.items(spark, d).groupBy("category").agg(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")).alias("lines"))
    return g.select("category", T.injected_block("lines", "Known:").alias("block"))


@query("p31_frontmatter", "SELECT id, md5(text) AS body FROM items")
def frontmatter(spark, d):
    return B.items(spark, d).select("id", F.md5(T.strip_frontmatter(F.concat(F.lit("---\nid: "), F.col("id").cast("string"), F.lit("\nx: y\n---\n"), "text"))).alias("body"))


@query("p32_repo_of_remote", "SELECT id, 'r' || id AS repo FROM items")
def remotes(spark, d):
    n = F.col("id")
    url = F.when(n % 2 == 0, _text("git@github.com:org/r", n, ".git")).otherwise(_text("https://host/org/r", n))
    return B.items(spark, d).select("id", T.repo_of_remote(url).alias("repo"))


@query("p33_environments", "SELECT 'w' || id AS workspace, 'linux' AS os, CASE WHEN id % 2 = 0 THEN 'r' || id ELSE 'd' || id END AS repo, 'github' AS tags FROM items")
def environments(spark, d):
    n = F.col("id")
    w = B.items(spark, d).select(_text("w", n).alias("workspace"), F.lit("Linux").alias("os"), F.when(n % 2 == 0, _text("git@github.com:o/R", n, ".git")).alias("remote"), _text("/work/d", n, "/").alias("cwd"), F.lit(None).cast("array<string>").alias("servers"))
    tags = w.select("workspace", F.lit("github").alias("tag"))
    return U.environments(w, tags).select("workspace", "os", "repo", F.array_join("tags", ",").alias("tags"))


@query("p34_dedup_payload", "SELECT id, CASE WHEN dedup_verified THEN 'verified' ELSE 'unverified' END AS status, text, category, occurrence_count FROM items")
def payload(spark, d):
    return U.dedup_payload(B.items(spark, d))


@query("p35_control_sets", "SELECT id, CASE WHEN id % 3 = 0 THEN 'a,b' WHEN id % 3 = 1 THEN 'a,b,c' ELSE 'b' END AS names FROM items")
def controls(spark, d):
    n = F.col("id")
    now = F.when(n % 3 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"), F.lit("b")))
    return B.items(spark, d).select("id", F.array_join(U.control_set(now, F.when(n % 3 == 1, "c").otherwise("a"), n % 3 != 2), ",").alias("names"))


@query("p36_counted_labels", "SELECT id FROM items WHERE id % 4 <> 1")
def counted(spark, d):
    n = F.col("id")
    return U.counted_labels(B.items(spark, d).select("id", F.when(n % 4 == 0, "counted").when(n % 4 == 1, "dropped").alias("status"))).select("id")


@query("s24_parsed_arrays", "SELECT id, 'n' || id AS text FROM items WHERE id % 5 <> 0 UNION ALL SELECT id, 'x [] ' || id FROM items WHERE id % 5 = 2")
def arrays(spark, d):
    n = F.col("id")
    out = F.when(n % 5 == 0, _text("no array ", n)).when(n % 5 == 2, _text('see [1] then [{"text": "n', n, '"}, {"text": "x [] ', n, '"}]')).otherwise(_text('```json\n[{"text": "n', n, '"}]\n```'))
    got = files.parsed_arrays(B.items(spark, d).select("id", out.alias("reply")), "reply", "struct<text:string>")
    return got.select("id", F.inline("items"))


@query("s17_before_offset", TQ._CUT + ", k AS (SELECT session, string_agg(role || ': ' || text, chr(10) ORDER BY line_no) AS a FROM t WHERE line_no < 2 GROUP BY session) SELECT session, right(a, 2000) AS context FROM k WHERE session IN (SELECT conv_id::VARCHAR FROM conversations WHERE turn = 2)")
def before(spark, d):
    lines = TQ._lines(spark, d)
    return X.before_offset(lines, lines.where("line_no = 2").select("session", F.col("start").alias("offset")))


@query("z02_z03_needs_work", "SELECT session_id AS session, (n * 37)::BIGINT AS from_offset FROM (SELECT session_id, count(*) AS n, sum(value) AS b FROM log GROUP BY 1) WHERE floor(b) >= 1000 AND n * 37 < 0.9 * floor(b)")
def work(spark, d):
    g = B.log(spark, d).groupBy(F.col("session_id").alias("session")).agg(F.floor(F.sum("value")).alias("bytes"), (F.count(F.lit(1)) * 37).alias("offset"))
    return Z.needs_work(g.select("session", "bytes"), g.select("session", "offset"), 1000).select("session", "from_offset")


@query("r32_verbose_listing", """m AS (SELECT item_id, 'r' || (user_id % 4) AS repo, count(*) AS n FROM log GROUP BY ALL), r AS (SELECT item_id AS id, max(round(score, 6)) AS best, string_agg(tag, ',' ORDER BY tag) AS tags FROM rel GROUP BY 1),
p AS (SELECT item_id AS id, string_agg(repo || ':' || n, ',' ORDER BY repo || ':' || n) AS repos FROM m GROUP BY 1), s AS (SELECT i.id, string_agg(DISTINCT 'title ' || a.repo, ',') AS titles FROM items i JOIN audit a ON a.session_id = i.source_session GROUP BY 1)
SELECT id, category, coalesce(best, 0) AS best, coalesce(tags, '') AS tags, coalesce(repos, '') AS repos, coalesce(titles, '') AS titles FROM items LEFT JOIN r USING (id) LEFT JOIN p USING (id) LEFT JOIN s USING (id) WHERE NOT deprecated""")
def verbose(spark, d):
    stats = B.log(spark, d).groupBy("item_id", _text("r", F.col("user_id") % 4).alias("repo")).agg(F.count(F.lit(1)).alias("times_matched"))
    titles = B.audit(spark, d).select("session_id", _text("title ", F.col("repo")).alias("title"))
    got = U.verbose_listing(B.items(spark, d), _rel(spark, d), stats, titles)
    return got.select("id", "category", "best", *(F.array_join(c, ",").alias(c) for c in ("tags", "repos", "titles")))


@query("j22_labelled_sessions", "SELECT DISTINCT l.id AS label_id, i.source_session AS session_id FROM items l JOIN items i ON l.text = i.text WHERE l.quality IS NOT NULL")
def labelled_sessions(spark, d):
    i = B.items(spark, d)
    return U.labelled_sessions(i.where("quality is not null").select(F.col("id").alias("label_id"), "text"), i)


@query("e13_variants", """v AS (SELECT tag AS variant, item_id, CASE WHEN score > 0.1 THEN 1 WHEN score < -0.1 THEN -1 ELSE 0 END AS s FROM rel), b AS (SELECT item_id, s AS base FROM v WHERE variant = 'click')
SELECT variant, count(*)::BIGINT AS n, count(*) FILTER (s = 1)::BIGINT AS positive, round(avg((s = 1)::INT), 6) AS yield_, round(avg((s = base)::INT), 6) AS agreement FROM v LEFT JOIN b USING (item_id) GROUP BY variant""")
def variants(spark, d):
    """Each event type as the verdicts of another judge."""
    got = E.variant_report(_rel(spark, d).select(F.col("tag").alias("variant"), "item_id", "score"), "click")
    return got.withColumns({c: F.round(c, 6) for c in ("yield_", "agreement")})


@query("e16_dedup_thresholds", """c AS (SELECT a.id AS source_id, b.id AS target_id, list_inner_product(a.e, b.e) / (a.norm * b.norm) AS s FROM vn a, vn b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(s, 9) DESC, target_id) - 1 AS rank0 FROM c WHERE round(s, 9) >= 0.25), h AS (SELECT unnest([0.25, 0.3, 0.35, 0.4]) AS threshold)
SELECT threshold::DOUBLE AS threshold, count(*)::BIGINT AS n_pairs, count(DISTINCT source_id)::BIGINT AS n_items, round(avg(s), 6) AS mean_similarity FROM r, h WHERE rank0 < 8 AND round(s, 9) >= threshold GROUP BY threshold""")
def thresholds(spark, d):
    pairs = D.self_candidates(B.vectors(spark, d), 0.25)
    got = E.threshold_report(pairs, spark.createDataFrame([(x,) for x in (0.25, 0.3, 0.35, 0.4)], "threshold double"))
    return got.withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("r29_one_configuration", RQ._LABELS + ", " + SQ._FULL + f", t AS (SELECT * REPLACE (round(score, 4) AS score) FROM ({SQ._cut(3, 0.05)})), " + RQ._metrics_sql("t"))
def one_configuration(spark, d):
    """The metrics of the whole path under one configuration."""
    found = SQ._full(spark, d, settings=S.Settings(abstain_below=0.2, min_top1=0.05, tag_penalty=-0.1))
    return RQ._rounded(E.retrieval_metrics(found, RQ._labels(spark, d)))
