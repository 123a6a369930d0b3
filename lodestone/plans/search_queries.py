"""Retrieval queries (R, J05-J12, T01-T04, P03, P05, P20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import feedback as fb
from lodestone.operators import postings
from lodestone.operators import search as S
from lodestone.sources.files import scratch, stored

from . import base as B

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = B.sql(sql)
        return f

    return add


def _docs(spark, d):
    return B.items(spark, d).select("id", F.concat_ws(" ", "text", "category").alias("text"))


def _lists(spark, d):
    items = B.items(spark, d)
    kw = S.bm25(_docs(spark, d), B.questions(spark, d))
    vec = S.rescope(S.nearest(B.vectors(spark, d), B.question_vectors(spark, d)), items)
    return items, kw, vec


def _fused_of(items, kw, vec):
    return S.fuse([vec, kw], S.anchors(items))


def _fused(spark, d):
    items, kw, vec = _lists(spark, d)
    return items, vec, _fused_of(items, kw, vec)


@query("r04_bm25_topk", "SELECT query_id, rank0::INT AS rank0, id, round(score, 6) AS score FROM kw")
def bm25(spark, d):
    return S.bm25(_docs(spark, d), B.questions(spark, d)).select("query_id", "rank0", "id", F.round("score", 6).alias("score"))


_ACTIVE = """atok AS (SELECT t.* FROM tok t JOIN items i USING (id) WHERE NOT i.deprecated),
adl AS (SELECT id, sum(tf) AS dl FROM atok GROUP BY id),
ast AS (SELECT (SELECT count(*) FROM items WHERE NOT deprecated) AS n, (SELECT sum(tf) FROM atok) / (SELECT count(*) FROM items WHERE NOT deprecated) AS avgdl),
aidf0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM atok, ast GROUP BY term, n),
aidf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM aidf0) ELSE raw END AS idf FROM aidf0),
akw0 AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN aidf USING (term) JOIN atok USING (term) JOIN adl USING (id), ast GROUP BY ALL),
akw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank0 FROM akw0) WHERE rank0 < 10)
"""


@query("index_search_t01_s08", _ACTIVE + "SELECT query_id, rank0::INT AS rank0, id, round(score, 6) AS score FROM akw")
def stored_postings(spark, d):
    """An index of all items in two segments, the deprecated ones removed, then merged; all questions searched."""
    index, docs = postings.Postings(spark, scratch(spark)), _docs(spark, d)
    index.add(docs.where("id % 2 = 0"))
    index.add(docs.where("id % 2 <> 0"))
    index.remove(docs.join(B.items(spark, d).where("deprecated").select("id"), "id", "left_semi"))
    index.merge()
    return index.search(B.questions(spark, d)).select("query_id", "rank0", "id", F.round("score", 6).alias("score"))


@query("j09_vector_topk", "SELECT query_id, r::INT AS rank0, id, round(score, 6) AS score FROM v1")
def vectors(spark, d):
    return S.nearest(B.vectors(spark, d), B.question_vectors(spark, d)).select("query_id", "rank0", "id", F.round("score", 6).alias("score"))


@query("r03_vector_scope", "SELECT query_id, rank0::INT AS rank0, id FROM vl")
def scoped(spark, d):
    return _lists(spark, d)[2].select("query_id", "rank0", "id")


@query("r06_r07_fusion", "SELECT query_id, id, round(rrf, 9) AS rrf, round(score, 6) AS score FROM fused")
def fusion(spark, d):
    return _fused(spark, d)[2].select("query_id", "id", F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"))


_BEST = """best AS (SELECT query_id FROM vl GROUP BY query_id HAVING max(score) < 0.55),
fb AS (SELECT t.item_id AS id, sum(coalesce(r.score, 0)) / count(*) AS a, sum(coalesce(r.pos + r.neg, 0)) AS n FROM item_tags t LEFT JOIN rel r USING (item_id, tag) GROUP BY t.item_id),
s AS (SELECT query_id, id, score + 0.2 * coalesce(a, 0) AS score FROM fused LEFT JOIN fb USING (id) WHERE query_id NOT IN (SELECT query_id FROM best) AND NOT (coalesce(n, 0) >= 3 AND coalesce(a, 0) < -0.1)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank0, max(score) OVER (PARTITION BY query_id) AS b FROM s) WHERE rank0 < 3 AND round(b, 4) >= 0.4)
SELECT query_id, rank0::INT AS rank0, id, round(score, 4) AS score FROM t"""


@query("r_hybrid_search", _BEST)
def hybrid(spark, d):
    """All benchmark questions through lists, fusion and feedback."""
    rel = fb.relevance(B.verdict_events(spark, d))
    return S.search(B.items(spark, d), B.questions(spark, d), B.vectors(spark, d), B.question_vectors(spark, d), B.item_tags(spark, d), rel).select("query_id", "rank0", "id", "score")


@query("r05_abstain", "SELECT query_id, count(*)::BIGINT AS n FROM fused WHERE query_id NOT IN (SELECT query_id FROM vl GROUP BY query_id HAVING max(score) < 0.55) GROUP BY query_id")
def abstained(spark, d):
    _, vec, fused = _fused(spark, d)
    return S.abstain(fused, vec).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("r08_repo_prior", "SELECT item_id AS id, round(CASE WHEN score > 0 THEN 0.05 * least(score, 1) WHEN score < 0 THEN -0.08 * least(abs(score), 1) ELSE 0 END, 9) AS repo_prior FROM rel WHERE tag = 'click' AND pos + neg >= 3")
def prior(spark, d):
    return S.repo_prior(fb.relevance(B.verdict_events(spark, d)), "click").select("id", F.round("repo_prior", 9).alias("repo_prior"))




_TAGV = """tv AS (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM vec) GROUP BY label, i),
tg AS (SELECT 'label' || label AS tag, list(m ORDER BY i) AS e FROM tv GROUP BY label),
tn AS (SELECT tag, e, sqrt(list_inner_product(e, e)) + 1e-10 AS norm FROM tg),
fr AS (SELECT 'label' || label AS tag, count(*) AS freq FROM vec GROUP BY label),
sim AS (SELECT q.query_id, t.tag, list_inner_product(a.e, t.e) / (a.norm * t.norm) AS sim FROM questions q JOIN vn a ON a.id = q.query_id, tn t),
sc AS (SELECT query_id, tag, sim * (1 - 0.3 * freq / (SELECT max(freq) FROM fr)) AS s FROM sim JOIN fr USING (tag)),
k AS (SELECT * FROM sc WHERE s >= 0.2),
sh AS (SELECT query_id, count(*) AS m, list(round(s, 9) ORDER BY round(s, 9) DESC) AS l FROM k GROUP BY query_id),
ok AS (SELECT query_id, CASE WHEN m > 3 THEN l[1] - 0.6 * (l[1] - l[m // 2 + 1]) ELSE -1 END AS cut FROM sh JOIN questions USING (query_id)
  WHERE m / (SELECT count(*) FROM fr) <= least(0.30 + 0.03 * len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')), 0.55) AND NOT (m > 3 AND l[1] - l[m // 2 + 1] < 0.03)),
pt AS (SELECT query_id, tag, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, tag) - 1 AS rank0 FROM k JOIN ok USING (query_id) WHERE round(s, 9) >= round(cut, 9))
"""


def _tag_vectors(spark, d):
    v = B.vectors(spark, d).select("label", F.posexplode("embedding").alias("i", "x"))
    m = v.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    e = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    return e.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("tag"), "embedding")


def _prompt_tags(spark, d):
    """Tag vocabulary of a few rows: it goes to every task."""
    tags = _tag_vectors(spark, d)
    q = B.question_vectors(spark, d).select("query_id", F.col("embedding").alias("qe"))
    sim = q.crossJoin(F.broadcast(tags)).select("query_id", "tag", T.cosine("qe", "embedding").alias("sim"))
    voc = B.vectors(spark, d).groupBy(F.concat(F.lit("label"), F.col("label").cast("string")).alias("tag")).agg(F.count(F.lit(1)).alias("freq"))
    return tags, S.prompt_tags(sim, voc, B.questions(spark, d), least=0.2)


@query("r10_prompt_tags", _TAGV + "SELECT query_id, tag, rank0::INT AS rank0, round(s, 6) AS tag_score FROM pt WHERE rank0 < 3")
def tags_of_prompts(spark, d):
    return _prompt_tags(spark, d)[1].select("query_id", "tag", "rank0", F.round("tag_score", 6).alias("tag_score"))


@query("r11_affinity", _TAGV + """, p3 AS (SELECT query_id, tag FROM pt WHERE rank0 < 3),
it AS (SELECT id, 'label' || label AS tag FROM vec),
pr AS (SELECT a.tag, b.tag AS other, list_inner_product(a.e, b.e) / (a.norm * b.norm) AS sim FROM tn a, tn b),
c AS (SELECT query_id, id FROM fused WHERE query_id IN (SELECT query_id FROM p3)),
b AS (SELECT c.query_id, c.id, it.tag, max(sim) AS b FROM c JOIN it USING (id) JOIN p3 USING (query_id) JOIN pr ON pr.tag = it.tag AND pr.other = p3.tag GROUP BY ALL),
g AS (SELECT query_id, id, sum(pow(greatest(0, (b - 0.5) / 0.5), 2)) AS g, max(b) AS n FROM b GROUP BY ALL)
SELECT c.query_id, c.id, round(CASE WHEN it.tag IS NULL THEN -0.05 WHEN coalesce(n, 0) < 0.2 THEN -0.1 ELSE 0.25 * g END, 6) AS affinity FROM c LEFT JOIN it USING (id) LEFT JOIN g USING (query_id, id)""")
def affinities(spark, d):
    tags, prompt = _prompt_tags(spark, d)
    pairs = _pairs(tags)
    own = B.vectors(spark, d).select(F.col("id").alias("item_id"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("tag"))
    out = S.affinity(_fused(spark, d)[2], own, prompt, pairs, penalty=-0.1)
    return out.select("query_id", "id", F.round("affinity", 6).alias("affinity"))


def _pairs(tags):
    a, b = tags.select("tag", F.col("embedding").alias("ea")), tags.select(F.col("tag").alias("other"), F.col("embedding").alias("eb"))
    return a.crossJoin(F.broadcast(b)).select("tag", "other", T.cosine("ea", "eb").alias("sim"))


_FULL = _TAGV + B.SCOPED + """, p3 AS (SELECT query_id, tag FROM pt WHERE rank0 < 3),
it AS (SELECT id, 'label' || label AS tag FROM vec),
pr AS (SELECT a.tag, b.tag AS other, list_inner_product(a.e, b.e) / (a.norm * b.norm) AS sim FROM tn a, tn b),
rel2 AS (SELECT item_id, tag, sum(0.3 * raw * pow(0.7, n)) AS score, count(*) FILTER (raw > 0) AS pos, count(*) FILTER (raw < 0) AS neg FROM (SELECT *, row_number() OVER (PARTITION BY item_id, tag ORDER BY seq DESC) - 1 AS n
  FROM (SELECT item_id, 'label' || label AS tag, value / 250.0 - 1.0 AS raw, event_id AS seq FROM log JOIN vec ON vec.id = item_id UNION ALL SELECT item_id, 'repo:src' || (user_id % 3), value / 250.0 - 1.0, event_id FROM log)) GROUP BY item_id, tag),
c0 AS (SELECT f.query_id, f.id, f.score AS rrf, coalesce(v.score, 0) AS vector_sim, coalesce(k.score, 0) AS bm25,
  coalesce(CASE WHEN r.pos + r.neg >= 3 THEN CASE WHEN r.score > 0 THEN 0.05 * least(r.score, 1) ELSE -0.08 * least(abs(r.score), 1) END END, 0) AS repo_delta
  FROM fused f LEFT JOIN vl v USING (query_id, id) LEFT JOIN kw k USING (query_id, id) LEFT JOIN rel2 r ON r.item_id = f.id AND r.tag = 'repo:src' || (f.query_id % 3)
  WHERE f.query_id NOT IN (SELECT query_id FROM vl GROUP BY query_id HAVING max(score) < 0.2)),
tb AS (SELECT c0.query_id, c0.id, it.tag, max(sim) AS b FROM c0 JOIN it USING (id) JOIN p3 USING (query_id) JOIN pr ON pr.tag = it.tag AND pr.other = p3.tag GROUP BY ALL),
tg2 AS (SELECT query_id, id, sum(pow(greatest(0, (b - 0.5) / 0.5), 2)) AS g, max(b) AS m FROM tb GROUP BY ALL),
ft AS (SELECT c0.query_id, c0.id, it.tag, tb.b >= 0.5 AS hit FROM c0 JOIN it USING (id) LEFT JOIN tb ON tb.query_id = c0.query_id AND tb.id = c0.id AND tb.tag = it.tag),
fs AS (SELECT query_id, id, CASE WHEN count(*) FILTER (hit) > 0 THEN coalesce(sum(score) FILTER (hit), 0) / count(*) FILTER (hit) ELSE coalesce(sum(score), 0) / count(*) END AS a,
  CASE WHEN count(*) FILTER (hit) > 0 THEN coalesce(sum(pos + neg) FILTER (hit), 0) ELSE coalesce(sum(pos + neg), 0) END AS n FROM ft LEFT JOIN rel2 ON item_id = id AND rel2.tag = ft.tag GROUP BY query_id, id),
c1 AS (SELECT c0.*, CASE WHEN query_id NOT IN (SELECT query_id FROM p3) THEN 0 WHEN m IS NOT NULL THEN 0.25 * g + CASE WHEN m < 0.2 THEN -0.1 ELSE 0 END WHEN id NOT IN (SELECT id FROM it) THEN -0.05 ELSE 0 END AS tag_affinity,
  coalesce(m, 0) AS best_tag_sim, coalesce(g, 0) AS tag_bonus, 0.2 * coalesce(a, 0) AS feedback_delta, 1 / (1 + 0.003 * greatest((1735689600 - refreshed_s) / 86400.0, 0)) AS recency_multiplier, category
  FROM c0 LEFT JOIN tg2 USING (query_id, id) LEFT JOIN fs USING (query_id, id) JOIN items USING (id) WHERE NOT (coalesce(n, 0) >= 3 AND coalesce(a, 0) < -0.1)),
c2 AS (SELECT *, (rrf + repo_delta + tag_affinity + feedback_delta) * recency_multiplier AS score FROM c1)
"""
_SHOWN = "query_id, rank0::INT AS rank0, id, round(score, 4) AS score"
_NINE = ", ".join(f"round({c}, 4) AS {n}" for c, n in [(x, x) for x in ("vector_sim", "bm25")] + [("rrf", "rrf_normalized")] + [(x, x) for x in ("repo_delta", "feedback_delta", "tag_affinity", "best_tag_sim", "tag_bonus", "recency_multiplier")])


def _cut(top, least, where="true", floor=-9):
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank0, max(round(score, 4)) OVER (PARTITION BY query_id) AS b FROM c2 WHERE {where}) WHERE rank0 < {top} AND b >= {least} AND round(score, 4) >= {floor}"""


def _full(spark, d, repo=True, diagnostics=False, **more):
    """search() over the items in scope with everything it can use: repositories, content tags, feedback, recency."""
    seen = stored(B.in_scope(spark, d).select("id"))
    items = B.items(spark, d).join(seen, "id", "left_semi")
    tags, prompt = _prompt_tags(spark, d)
    label = F.concat(F.lit("label"), F.col("label").cast("string"))
    own = B.vectors(spark, d).select(F.col("id").alias("item_id"), label.alias("tag"))
    log = B.log(spark, d).select("item_id", "user_id", (F.col("value") / 250.0 - 1.0).alias("raw"), F.lit(1.0).alias("weight"), F.col("event_id").alias("seq"))
    events = log.join(own, "item_id").select("item_id", "tag", "raw", "weight", "seq").unionByName(log.select("item_id", F.concat(F.lit("repo:src"), (F.col("user_id") % 3).cast("string")).alias("tag"), "raw", "weight", "seq"))
    q = B.questions(spark, d)
    if repo:
        q = q.withColumn("repo", F.concat(F.lit("src"), (F.col("query_id") % 3).cast("string")))
    return S.search(items, q, B.vectors(spark, d), B.question_vectors(spark, d), own, fb.relevance(events), prompt, _pairs(tags), F.timestamp_seconds(F.lit(1735689600)), diagnostics=diagnostics, **more)


@query("r_full_search", _FULL + f", t AS ({_cut(3, 0.05)}) SELECT {_SHOWN}, {_NINE} FROM t")
def full(spark, d):
    """The flagship: every step of the path (R01-R15, R17), with the nine parts of each score."""
    out = _full(spark, d, diagnostics=True, settings=S.Settings(abstain_below=0.2, min_top1=0.05, tag_penalty=-0.1))
    return out.select("query_id", "rank0", "id", "score", *(F.round(c, 4).alias(c) for c in out.columns[4:]))


@query("r16_hook_floor", _FULL + f", t AS ({_cut(3, 0.05, floor=0.2)}) SELECT {_SHOWN} FROM t")
def floored(spark, d):
    return _full(spark, d, settings=S.Settings(abstain_below=0.2, min_top1=0.05, floor=0.2, tag_penalty=-0.1))


_INTERACTIVE = _FULL.replace("r.pos + r.neg >= 3", "false")


@query("r27_interactive", _INTERACTIVE + f""", t AS ({_cut(5, -9, "(category LIKE 'en%' OR id IN (SELECT id FROM items WHERE category LIKE 'en%')) AND id IN (SELECT id FROM it WHERE tag = 'label1')")}) SELECT {_SHOWN} FROM t""")
def interactive(spark, d):
    """No repository; filters by category and by required tags (R14), five results."""
    return _full(spark, d, repo=False, category="en", tags=["Label1 "], settings=S.Settings(top=5, abstain_below=0.2, min_top1=-9.0, tag_penalty=-0.1))


@query("r28_tool_server", _FULL + f""", t AS ({_cut(5, 0.05)}) SELECT {_SHOWN} FROM t WHERE id IN (SELECT item_id FROM item_tags WHERE tag = 'en')""")
def tool_server(spark, d):
    """The search as it is, with the tag filter after the cut."""
    found = _full(spark, d, settings=S.Settings(top=5, abstain_below=0.2, min_top1=0.05, tag_penalty=-0.1))
    return found.join(S.with_all_tags(B.items(spark, d), B.item_tags(spark, d), ["en"]).select("id"), "id", "left_semi").select("query_id", "rank0", "id", "score")


@query("r12_feedback", """fb AS (SELECT t.item_id AS id, sum(coalesce(r.score, 0)) / count(*) AS a, sum(coalesce(r.pos + r.neg, 0)) AS n FROM (SELECT DISTINCT item_id, tag FROM ev) t LEFT JOIN rel r USING (item_id, tag) GROUP BY t.item_id)
SELECT query_id, id, round(score + 0.2 * coalesce(a, 0), 6) AS score FROM fused LEFT JOIN fb USING (id) WHERE NOT (coalesce(n, 0) >= 3 AND coalesce(a, 0) < -0.1)""")
def fed_back(spark, d):
    ev = B.verdict_events(spark, d)
    return S.feedback(_fused(spark, d)[2], ev.select("item_id", "tag").distinct(), fb.relevance(ev)).select("query_id", "id", F.round("score", 6).alias("score"))


@query("r13_recency", "SELECT id, round(1 / (1 + 0.003 * greatest((1735689600 - refreshed_s) / 86400.0, 0)), 9) AS factor FROM items")
def recencies(spark, d):
    now = F.timestamp_seconds(F.lit(1735689600))
    return B.items(spark, d).select("id", F.round(T.recency("refreshed_at", F.lit(None).cast("timestamp"), now), 9).alias("factor"))


@query("r14_j06_category", "SELECT id FROM items WHERE category LIKE 'en/%' OR id IN (SELECT item_id FROM rel WHERE 'en/' || tag LIKE 'en/cl%')")
def by_category(spark, d):
    bridge = fb.relevance(B.verdict_events(spark, d)).select("item_id", F.concat(F.lit("fr/"), "tag").alias("path"))
    en = S.in_category(B.items(spark, d), bridge, "en/").select("id")
    return en.union(S.in_category(B.items(spark, d), bridge, "fr/cl").join(bridge.where("path like 'fr/cl%'").select(F.col("item_id").alias("id")), "id", "left_semi").select("id")).distinct()


@query("j05_all_tags", "SELECT item_id AS id FROM item_tags WHERE tag IN ('en', 'quality:1') GROUP BY item_id HAVING count(*) = 2")
def all_tags(spark, d):
    return S.with_all_tags(B.items(spark, d), B.item_tags(spark, d), ["en", "quality:1"]).select("id")


@query("j07_not_shown", "SELECT DISTINCT session_id, item_id AS id FROM log l WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.session_id = l.session_id AND s.item_id = l.item_id)")
def unseen(spark, d):
    clicks = B.log(spark, d).where("event_type = 'click'").select("session_id", F.col("item_id").alias("id")).distinct()
    return S.not_shown(clicks, B.shown(spark, d))


@query("j08_isolated_scope", """SELECT 'src3' AS repo, id FROM items WHERE id IN (SELECT id FROM ties WHERE repo = 'src3') UNION ALL SELECT 'src7', id FROM items WHERE id NOT IN (SELECT id FROM ties WHERE repo IN ('src3', 'src4'))""")
def isolation(spark, d):
    i, t, a = B.items(spark, d), B.item_tags(spark, d), B.audit(spark, d)
    one = S.isolated_scope(i, t, a, "src3", ["src3", "src4"]).select(F.lit("src3").alias("repo"), "id")
    return one.unionByName(S.isolated_scope(i, t, a, "src7", ["src3", "src4"]).select(F.lit("src7").alias("repo"), "id"))


@query("r22_pinned", """p AS (SELECT item_id AS id, avg(score) AS a, sum(pos + neg) AS n FROM rel GROUP BY item_id)
SELECT id FROM items LEFT JOIN p USING (id) WHERE pinned AND NOT deprecated AND NOT (coalesce(n, 0) >= 3 AND coalesce(a, 0) < -0.1)""")
def pinned(spark, d):
    stats = fb.pin_statistics(fb.relevance(B.verdict_events(spark, d))).select(F.col("item_id").alias("id"), "avg_score", (F.col("pos") + F.col("neg")).alias("n"))
    j = B.items(spark, d).where("pinned and not deprecated").join(stats, "id", "left")
    return j.where(~((F.coalesce("n", F.lit(0)) >= 3) & (F.coalesce("avg_score", F.lit(0.0)) < -0.1))).select("id")


@query("r17_diagnostics", "SELECT f.query_id, f.id, v.rank0::INT AS vector_rank, k.rank0::INT AS keyword_rank, round(v.score, 6) AS cosine, round(k.score, 6) AS bm25, round(f.score, 6) AS score FROM fused f LEFT JOIN vl v USING (query_id, id) LEFT JOIN kw k USING (query_id, id)")
def diagnostics(spark, d):
    items, kw, vec = _lists(spark, d)
    fused = S.fuse([vec, kw], S.anchors(items), ("cosine", "bm25"))
    j = fused.join(vec.select("query_id", "id", F.col("rank0").alias("vector_rank")), ["query_id", "id"], "left")
    j = j.join(kw.select("query_id", "id", F.col("rank0").alias("keyword_rank")), ["query_id", "id"], "left")
    return j.select("query_id", "id", "vector_rank", "keyword_rank", *(F.round(c, 6).alias(c) for c in ("cosine", "bm25", "score")))
