"""Scans, projections, sets and upserts over items (S, P, U, M, T05-T09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import dedup as D
from lodestone.operators import passes as P
from lodestone.operators import retrieval as R
from lodestone.operators import search as S
from lodestone.operators import state as M
from lodestone.operators.snapshots import Snapshots, merge_groups
from lodestone.sources import files

from . import base as B

QUERIES, ORACLES = {}, {}


def query(name, sql=None, recursive=False):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = B.sql(sql, recursive)
        return f

    return add


@query("s01_active_scan", "SELECT id, category FROM items WHERE NOT deprecated")
def active(spark, d):
    return B.items(spark, d).where(~F.col("deprecated")).select("id", "category")


@query("s02_point_lookup", "SELECT id, category FROM items WHERE id IN (SELECT item_id FROM log)")
def lookup(spark, d):
    ids = B.log(spark, d).select(F.col("item_id").alias("id")).distinct()
    return B.items(spark, d).join(ids, "id", "left_semi").select("id", "category")


@query("s03_category_scan", "SELECT id FROM items WHERE level1 = 'en' AND level2 = 'src2'")
def category_scan(spark, d):
    return B.items(spark, d).where("level1 = 'en'").where("level2 = 'src2'").select("id")


@query("s04_pinned_scan", "SELECT id FROM items WHERE NOT deprecated AND pinned")
def pinned_scan(spark, d):
    return B.items(spark, d).where("not deprecated and pinned").select("id")


@query("s05_verified_scans", "SELECT dedup_verified AS verified, id FROM items WHERE NOT deprecated")
def verified_scans(spark, d):
    live = B.items(spark, d).where("not deprecated")
    return live.where("dedup_verified").select(F.lit(True).alias("verified"), "id").unionByName(live.where("not dedup_verified").select(F.lit(False).alias("verified"), "id"))


@query("s06_uncurated", "SELECT id FROM items WHERE NOT deprecated AND (status IS NULL OR status & 1 = 0)")
def uncurated(spark, d):
    return M.uncurated(B.items(spark, d)).select("id")


@query("s07_s08_vector_index", "SELECT vec_id AS id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding)::INT AS dims FROM embeddings")
def vector_index(spark, d):
    """The index is written as a whole (S08) and loaded again."""
    path = f"{files.scratch(spark)}/index"
    files.write_index(B.vectors(spark, d), path)
    return files.read_index(spark, path).select("id", F.round("norm", 6).alias("norm"), F.size("embedding").alias("dims"))


@query("s09_tag_bags", "SELECT item_id, string_agg(tag, ' ' ORDER BY tag) AS bag FROM item_tags GROUP BY item_id")
def bags(spark, d):
    return files.tag_bags(B.item_tags(spark, d))


@query("s10_a03_tag_vocabulary", "SELECT tag, count(DISTINCT item_id)::BIGINT AS freq FROM item_tags GROUP BY tag HAVING count(DISTINCT item_id) >= 2")
def vocabulary(spark, d):
    return files.tag_vocabulary(B.item_tags(spark, d), 2)


@query("s22_export_markdown", "SELECT category, '## ' || category || chr(10) || string_agg('- ' || text, chr(10) ORDER BY id) AS block FROM items WHERE NOT deprecated GROUP BY category")
def export(spark, d):
    return files.export_markdown(B.items(spark, d).where("not deprecated").select("id", "category", "text"))


@query("s26_t05_log_page", "SELECT event_id AS id, event_type FROM log WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20 OFFSET 40")
def page(spark, d):
    log = B.log(spark, d).select(F.col("event_id").alias("id"), "event_type")
    return M.log_page(log, 20, 40, F.col("event_type") == "error")


@query("s28_recent_sessions", "SELECT session_id FROM (SELECT a.session_id, a.ts FROM audit a WHERE session_id IN (SELECT session_id FROM shown) ORDER BY ts DESC, session_id LIMIT 50) WHERE session_id IN (SELECT 'u' || session FROM turns) ORDER BY ts DESC, session_id LIMIT 10")
def recent(spark, d):
    a = B.audit(spark, d).join(B.shown(spark, d).select("session_id").distinct(), "session_id", "left_semi")
    over = a.orderBy(F.desc("ts"), "session_id").limit(50)
    have = B.turns(spark, d).select(F.concat(F.lit("u"), "session").alias("session_id")).distinct()
    return over.join(have, "session_id", "left_semi").orderBy(F.desc("ts"), "session_id").limit(10).select("session_id")


@query("s29_relevance_map", "SELECT item_id, string_agg(tag || '=' || round(score, 4)::DECIMAL(10,4), ',' ORDER BY tag) AS scores FROM rel GROUP BY item_id")
def relevance_map(spark, d):
    from lodestone.operators import feedback as fb

    r = fb.relevance(B.verdict_events(spark, d))
    pair = F.concat("tag", F.lit("="), F.round("score", 4).cast("decimal(10,4)").cast("string"))
    return r.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("scores"))


@query("p01_levels", "SELECT id, level1, level2, NULL::VARCHAR AS level3 FROM items")
def levels(spark, d):
    return B.items(spark, d).select("id", *T.category_levels("category"))


@query("p02_closure", "SELECT level1 AS path, count(DISTINCT id)::BIGINT AS n FROM items GROUP BY 1 UNION ALL SELECT category, count(*)::BIGINT FROM items GROUP BY 1")
def closure(spark, d):
    return B.items(spark, d).select("id", F.explode(T.category_closure("category")).alias("path")).groupBy("path").agg(F.countDistinct("id").alias("n"))


@query("p03_tokens", r"SELECT id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::BIGINT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))::BIGINT AS n_distinct FROM items")
def tokens(spark, d):
    t = T.tokens("text")
    return B.items(spark, d).select("id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("p04_p23_question_overlap", r"""w AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS ws FROM items),
q AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS ws FROM questions)
SELECT query_id, id, round(len(list_intersect(q.ws, w.ws)) / least(len(q.ws), len(w.ws)), 6) AS overlap FROM q, w WHERE len(list_intersect(q.ws, w.ws)) > 0.7 * least(len(q.ws), len(w.ws)) AND len(w.ws) > 0""")
def question_overlap(spark, d):
    got = R.word_overlaps(B.questions(spark, d).withColumnRenamed("query_id", "a"), B.items(spark, d).select(F.col("id").alias("b"), "text"))
    return got.select(F.col("a").alias("query_id"), F.col("b").alias("id"), F.round("overlap", 6).alias("overlap"))


@query("p15_scope", "SELECT session_id FROM audit WHERE repo NOT IN ('src1', 'src2')")
def scope(spark, d):
    return B.audit(spark, d).where(T.in_scope("repo", ["src1", "src2"])).select("session_id")


@query("p17_p18_attribution", """x AS (SELECT query_id, id, (score + 1) / 2 AS s FROM v0)
SELECT query_id, id, round(CASE WHEN s <= 0.2 THEN 0 ELSE least(pow((s - 0.2) / 0.8, 2), 1) END, 6) AS weight, round(CASE WHEN s <= 0.2 THEN 0 ELSE least(pow((s - 0.2) / (0.8 - 0.2), 2), 1) END, 6) AS plateau, round(s, 6) AS sim FROM x""")
def attribution(spark, d):
    q = B.question_vectors(spark, d)
    got = S.similarities(B.vectors(spark, d), q).select("query_id", "id", ((F.col("score") + 1) / 2).alias("s"))
    return got.select("query_id", "id", F.round(T.attribution("s"), 6).alias("weight"), F.round(T.attribution("s", ceiling=0.8), 6).alias("plateau"), F.round("s", 6).alias("sim"))


@query("p22_s18_excerpt", "SELECT id, CASE WHEN length(text) > 600 THEN left(text, 295) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 295) ELSE text END AS shown FROM items")
def excerpt(spark, d):
    return B.items(spark, d).select("id", T.excerpt("text", 600).alias("shown"))


@query("p27_normal_category", "SELECT id, level1 || '/' || level2 AS category FROM items")
def normal_category(spark, d):
    return B.items(spark, d).select("id", T.normal_category(F.concat(F.lit("//"), "lang", F.lit("//"), "source", F.lit("/"))).alias("category"))


@query("p30_buckets", "SELECT item_id, tag, CASE WHEN score > 0.1 THEN 'pos' WHEN score < -0.1 THEN 'neg' ELSE 'neu' END AS bucket FROM rel")
def buckets(spark, d):
    from lodestone.operators import feedback as fb

    return fb.relevance(B.verdict_events(spark, d)).select("item_id", "tag", T.bucket("score").alias("bucket"))


@query("p12_inferred_servers", "SELECT id, CASE WHEN contains(lower(text), 'figma mcp') OR contains(lower(text), 'figma server') THEN 'figma' END AS servers FROM items")
def servers(spark, d):
    return B.items(spark, d).select("id", F.array_join(T.inferred_servers("text"), ",").alias("servers"))


# --- sets and upserts -----------------------------------------------------------------------------
@query("u01_insert_or_ignore", """o AS (SELECT session_id, item_id, min(seq) + 1000000 AS seq FROM shown WHERE item_id % 3 = 0 GROUP BY ALL)
SELECT session_id, item_id, seq FROM o UNION ALL SELECT session_id, item_id, min(seq) FROM shown WHERE item_id % 3 <> 0 GROUP BY ALL""")
def insert(spark, d):
    """A third of the pairs is known already, under other numbers: those stay."""
    s = B.shown(spark, d).select("session_id", "item_id", "seq")
    known = s.where("item_id % 3 = 0").groupBy("session_id", "item_id").agg((F.min("seq") + 1000000).alias("seq"))
    return M.insert_or_ignore(known, s, ["session_id", "item_id"], ["seq"])


@query("u02_replace_tags", "SELECT item_id, tag FROM item_tags WHERE item_id NOT IN (SELECT item_id FROM ev) UNION SELECT item_id, tag FROM ev")
def replace(spark, d):
    return M.replace_set(B.item_tags(spark, d), B.verdict_events(spark, d).select("item_id", "tag"), "item_id")


@query("u03_delete_tags", "SELECT item_id, tag FROM item_tags WHERE tag <> 'quality:0' OR item_id NOT IN (SELECT id FROM items WHERE deprecated)")
def delete(spark, d):
    gone = B.items(spark, d).where("deprecated").select(F.col("id").alias("item_id"), F.lit("quality:0").alias("tag"))
    return M.delete_rows(B.item_tags(spark, d), gone, ["item_id", "tag"])


@query("u06_id_accounting", """g AS (SELECT item_id AS id, count(*) AS n FROM (SELECT DISTINCT item_id, tag FROM ev) GROUP BY 1)
SELECT id, 'missing' AS problem FROM items WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT id, 'unknown' FROM g WHERE id NOT IN (SELECT id FROM items) UNION ALL SELECT id, 'duplicated' FROM g WHERE n > 1""")
def accounting(spark, d):
    given = B.verdict_events(spark, d).select("item_id", "tag").distinct().select(F.col("item_id").alias("id"))
    return M.id_accounting(B.items(spark, d).select("id"), given)


@query("m01_add_items", "SELECT id, category FROM items UNION ALL SELECT (SELECT max(id) FROM items) + row_number() OVER (ORDER BY query_id), 'general/question' FROM questions")
def add(spark, d):
    new = B.questions(spark, d).select("query_id", "text", F.lit("general/question").alias("category"))
    base = B.items(spark, d).select("id", "text", "category", "level1", "level2", "level3", "deprecated", "pinned")
    return M.add_items(base, new, "query_id", F.current_timestamp()).select("id", "category")


@query("m02_match_counts", "SELECT item_id, a.repo, count(*)::INT AS times_matched, max(l.ts) AS last_matched FROM log l JOIN audit a USING (session_id) WHERE event_type = 'click' GROUP BY ALL")
def matches(spark, d):
    m = B.log(spark, d).where("event_type = 'click'").join(B.audit(spark, d).select("session_id", "repo"), "session_id").select("item_id", "repo", "ts")
    empty = spark.createDataFrame([], "item_id long, repo string, times_matched int, last_matched timestamp")
    return M.match_counts(empty.select("item_id", "repo", "times_matched", F.col("last_matched").cast(m.schema["ts"].dataType).alias("last_matched")), m)


@query("m03_processed_sessions", """n AS (SELECT session_id, max(struct_pack(ts := ts, e := event_id)) AS at, max((event_type = 'error')::INT) AS fr, max(item_id) AS ex,
  arg_max(CASE WHEN event_type = 'signup' THEN 't' || event_id END, CASE WHEN event_type = 'signup' THEN (ts, event_id) END) AS title FROM log WHERE event_id % 2 = 1 GROUP BY session_id),
o AS (SELECT session_id, max(struct_pack(ts := ts, e := event_id)) AS at, 2 AS fr, min(item_id) AS ex, 'old ' || session_id AS title FROM log WHERE event_id % 2 = 0 AND user_id % 2 = 0 GROUP BY session_id)
SELECT session_id, greatest(coalesce(o.at, n.at), coalesce(n.at, o.at)).ts AS processed_at, greatest(coalesce(o.fr, 0), coalesce(n.fr, 0))::INT AS had_friction, greatest(coalesce(o.ex, n.ex), coalesce(n.ex, o.ex)) AS extracted,
  CASE WHEN n.title IS NULL THEN o.title WHEN o.title IS NULL OR n.at > o.at THEN n.title ELSE o.title END AS title FROM o FULL JOIN n USING (session_id)""")
def processed(spark, d):
    """Sessions of even users were processed before, under an old title; the newest title that is known wins."""
    log = B.log(spark, d)
    at = F.struct("ts", "event_id")
    title = F.max_by(F.concat(F.lit("t"), F.col("event_id").cast("string")), F.when(F.col("event_type") == "signup", at))
    new = log.where("event_id % 2 = 1").groupBy("session_id").agg(F.max(at).alias("processed_at"), F.max((F.col("event_type") == "error").cast("int")).alias("had_friction"), F.max("item_id").alias("extracted"), title.alias("title"))
    old = log.where("event_id % 2 = 0 and user_id % 2 = 0").groupBy("session_id").agg(F.max(at).alias("processed_at"), F.lit(2).alias("had_friction"), F.min("item_id").alias("extracted")).withColumn("title", F.concat(F.lit("old "), "session_id"))
    return M.processed_sessions(old, new).withColumn("processed_at", F.col("processed_at.ts"))


@query("m04_occurrence_bump", """s AS (SELECT item_id AS id, session_id, min(seq) AS seq FROM shown GROUP BY ALL),
a AS (SELECT i.id, i.occurrence_count, i.source_session, count(s.session_id) FILTER (s.session_id <> i.source_session) AS more, count(s.session_id) AS any_ FROM items i LEFT JOIN s ON s.id = i.id GROUP BY ALL)
SELECT id, (CASE WHEN any_ > 0 THEN 1 + more ELSE occurrence_count END)::INT AS occurrence_count FROM a""")
def bump(spark, d):
    seen = B.shown(spark, d).select(F.col("item_id").alias("id"), "session_id", "seq")
    return M.occurrence_bump(B.items(spark, d), seen).select("id", "occurrence_count")


@query("m05_first_shown", """o AS (SELECT session_id, item_id, 'before' AS hook_event FROM shown WHERE item_id % 4 = 0 GROUP BY ALL)
SELECT session_id, item_id, hook_event FROM o UNION ALL SELECT DISTINCT session_id, item_id, 'view' FROM shown WHERE item_id % 4 <> 0""")
def first_shown(spark, d):
    """What a session has been shown before keeps its first record."""
    s = B.shown(spark, d).select("session_id", "item_id", "hook_event", "seq")
    known = s.where("item_id % 4 = 0").select("session_id", "item_id", F.lit("before").alias("hook_event"), F.lit(0).cast("long").alias("seq")).distinct()
    return M.insert_or_ignore(known, s, ["session_id", "item_id"], ["seq"]).select("session_id", "item_id", "hook_event")


@query("m06_latest_audit", "SELECT session_id, max(ts) AS ts FROM log GROUP BY session_id")
def latest(spark, d):
    return M.latest_audit(B.log(spark, d).select("session_id", "ts", "event_type")).select("session_id", "ts")


@query("m07_m08_reject", "SELECT id, CASE WHEN pinned THEN coalesce(status, 0) | 3 ELSE status END AS status, deprecated OR pinned AS deprecated FROM items")
def reject(spark, d):
    i = B.items(spark, d)
    return M.set_status(i, i.where("pinned").select("id"), 3).select("id", "status", "deprecated")


@query("m11_refresh", "SELECT id, greatest(refreshed_s, coalesce(epoch(max_ts)::BIGINT, 0))::BIGINT AS refreshed_s FROM items LEFT JOIN (SELECT item_id AS id, date_trunc('second', max(shown_at)) AS max_ts FROM shown GROUP BY 1) USING (id)")
def refresh(spark, d):
    i = B.items(spark, d)
    log = B.shown(spark, d).select(F.col("item_id").alias("id"), F.date_trunc("second", F.col("shown_at").cast("timestamp")).alias("refreshed_at"))
    return M.refreshed(i, log).select("id", F.unix_timestamp("refreshed_at").alias("refreshed_s"))


@query("m16_category_move", "SELECT item_id, path FROM (SELECT id AS item_id, CASE WHEN deprecated THEN 'archive' ELSE category END AS path FROM items)")
def move(spark, d):
    i = B.items(spark, d)
    new = i.where("deprecated").select(F.col("id").alias("item_id"), F.lit("archive").alias("path"))
    return M.replace_set(M.bridge_of(i), new, "item_id")


@query("m24_update", "SELECT id, CASE WHEN toxic = 1 THEN 'x/y' ELSE category END AS category FROM items")
def update(spark, d):
    i = B.items(spark, d).select("id", "category", "toxic")
    return M.update_fields(i, i.where("toxic = 1").select("id", F.lit("x/y").alias("category")), ["category"]).select("id", "category")


@query("m26_audit_rows", "SELECT session_id, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS shown FROM shown GROUP BY session_id")
def audits(spark, d):
    first = M.insert_or_ignore(B.shown(spark, d).limit(0), B.shown(spark, d), ["session_id", "item_id"], ["seq"])
    rows = M.audit_rows(first.withColumn("query_text", F.lit("")), B.audit(spark, d))
    return rows.select("session_id", F.array_join(F.array_sort(F.transform("shown_ids", lambda x: x.cast("string"))), ",").alias("shown"))


@query("j19_missing_repo_tags", "SELECT i.id AS item_id, 'repo:' || a.repo AS tag FROM items i JOIN audit a ON a.session_id = i.source_session WHERE 'repo:' || a.repo <> 'repo:' || i.source")
def backfill(spark, d):
    return M.missing_repo_tags(B.items(spark, d), B.audit(spark, d), B.item_tags(spark, d))


@query("j20_log_texts", "SELECT event_id AS id, 0::INT AS pos, l.item_id, coalesce(i.text, '<deleted>') AS text FROM log l LEFT JOIN items i ON i.id = l.item_id AND NOT i.deprecated")
def log_texts(spark, d):
    log = B.log(spark, d).select(F.col("event_id").alias("id"), F.array("item_id").alias("item_ids"))
    live = B.items(spark, d).where("not deprecated").select("id", "text")
    return M.log_texts(log, live).select("id", "pos", "item_id", "text")


@query("t06_listing", "SELECT id, coalesce(max(round(score, 6)), 0) AS best FROM items LEFT JOIN rel ON item_id = id GROUP BY id ORDER BY 2 DESC, 1 LIMIT 50")
def listing(spark, d):
    from lodestone.operators import feedback as fb

    r = fb.relevance(B.verdict_events(spark, d)).groupBy("item_id").agg(F.max(F.round("score", 6)).alias("best"))
    j = B.items(spark, d).join(r, F.col("id") == F.col("item_id"), "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"))
    return j.orderBy(F.desc("best"), "id").limit(50)


@query("t08_category_listing", "SELECT category, id FROM items WHERE NOT deprecated AND category LIKE 'en%' ORDER BY category, id LIMIT 40 OFFSET 10")
def category_listing(spark, d):
    return M.category_listing(B.items(spark, d), "en", limit=40, offset=10).select("category", "id")


@query("m09_dedup_outcomes", """o AS (SELECT item_id AS id, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error, event_id AS seq FROM log WHERE event_type IN ('error', 'purchase')),
g AS (SELECT id, bool_or(error IS NULL) AS ok, count(error) AS n, arg_max(coalesce(error, ''), seq) AS last FROM o GROUP BY id)
SELECT id, dedup_verified OR coalesce(ok, false) AS dedup_verified, (id % 3 + coalesce(n, 0))::INT AS dedup_attempts, CASE WHEN n IS NULL THEN 'old' ELSE nullif(last, '') END AS dedup_last_error FROM items LEFT JOIN g USING (id)""")
def dedup_outcomes(spark, d):
    """Purchases are runs without an error; items carry attempts and an error from before."""
    i = B.items(spark, d).select("id", "dedup_verified", (F.col("id") % 3).cast("int").alias("dedup_attempts"), F.lit("old").alias("dedup_last_error"))
    runs = B.log(spark, d).where("event_type in ('error', 'purchase')").select(F.col("item_id").alias("id"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"), F.col("event_id").alias("seq"))
    return M.dedup_outcomes(i, runs)


@query("t09_tag_hint", "SELECT tag, count(DISTINCT item_id)::BIGINT AS freq FROM item_tags GROUP BY tag ORDER BY 2 DESC, 1 LIMIT 50")
def hint(spark, d):
    return files.tag_vocabulary(B.item_tags(spark, d)).orderBy(F.desc("freq"), "tag").limit(50)


# --- dedup of items ---------------------------------------------------------------------------------
_CAND = """u AS (SELECT v.* FROM vn v JOIN items USING (id) WHERE NOT dedup_verified), w AS (SELECT v.* FROM vn v JOIN items USING (id) WHERE dedup_verified),
c AS (SELECT u.id AS source_id, w.id AS target_id, list_inner_product(u.e, w.e) / (u.norm * w.norm) AS s FROM u, w WHERE u.id <> w.id),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(s, 9) DESC, target_id) - 1 AS rank0 FROM c WHERE round(s, 9) >= 0.3)
"""


def _pools(spark, d):
    i = B.items(spark, d).select("id", "dedup_verified").join(B.vectors(spark, d), "id")
    return i.where("not dedup_verified"), i.where("dedup_verified")


@query("j10_dedup_candidates", _CAND + "SELECT source_id, target_id, round(s, 6) AS similarity, rank0::INT AS rank0 FROM r WHERE rank0 < 8")
def dedup_candidates(spark, d):
    u, v = _pools(spark, d)
    return D.candidates(u, v, 0.3).select("source_id", "target_id", F.round("similarity", 6).alias("similarity"), "rank0")


@query("j11_self_candidates", """c AS (SELECT a.id AS source_id, b.id AS target_id, list_inner_product(a.e, b.e) / (a.norm * b.norm) AS s FROM vn a, vn b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(s, 9) DESC, target_id) - 1 AS rank0 FROM c WHERE round(s, 9) >= 0.3)
SELECT source_id, target_id, round(s, 6) AS similarity FROM r WHERE rank0 < 8""")
def self_candidates(spark, d):
    return D.self_candidates(B.vectors(spark, d), 0.3).select("source_id", "target_id", F.round("similarity", 6).alias("similarity"))


@query("x03_without_candidates", _CAND + "SELECT id FROM u WHERE id NOT IN (SELECT source_id FROM r)")
def lonely(spark, d):
    u, v = _pools(spark, d)
    return D.without_candidates(u, D.candidates(u, v, 0.3)).select("id")


@query("j21_first_by_text", "SELECT id, (row_number() OVER (ORDER BY id) - 1)::INT AS dense_id FROM (SELECT min(id) AS id FROM items GROUP BY text)")
def first_text(spark, d):
    return D.first_by_text(B.items(spark, d).select("id", "text"), ["id"]).select("id", F.col("dense_id").cast("int").alias("dense_id"))


def _map(spark, d):
    """Exact copies merge: groups of equal texts."""
    i = B.items(spark, d)
    g = i.groupBy("text").agg(F.collect_list("id").alias("ids"), F.min("id").alias("group_id")).where(F.size("ids") > 1).select("group_id", "ids")
    return i, D.survivors(g, i)


_MAP = """g AS (SELECT id, text, dedup_verified, occurrence_count, count(*) OVER (PARTITION BY text) AS n, first_value(id) OVER (PARTITION BY text ORDER BY dedup_verified DESC, occurrence_count DESC, id) AS survivor FROM items),
mp AS (SELECT id AS absorbed, survivor FROM g WHERE n > 1 AND id <> survivor)
"""


@query("t07_survivors", _MAP + "SELECT survivor, absorbed FROM mp")
def survivors(spark, d):
    return _map(spark, d)[1].select("survivor", "absorbed")


@query("m12_merge_items", _MAP + """, ss AS (SELECT o.survivor AS id, list(source_session ORDER BY (k.id <> o.survivor), k.id) AS l FROM items k JOIN g o USING (id) WHERE o.n > 1 GROUP BY 1),
sf AS (SELECT id, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS l FROM ss)
SELECT i.id, (CASE WHEN i.id IN (SELECT survivor FROM mp) THEN (SELECT sum(o.occurrence_count) FROM g o WHERE o.survivor = i.id) ELSE i.occurrence_count END)::INT AS occurrence_count,
(CASE WHEN i.id IN (SELECT survivor FROM mp) THEN (SELECT max(k.refreshed_s) FROM items k JOIN g o USING (id) WHERE o.survivor = i.id) ELSE i.refreshed_s END)::BIGINT AS refreshed_s,
i.deprecated OR i.id IN (SELECT absorbed FROM mp) AS deprecated, i.dedup_verified AND i.id NOT IN (SELECT survivor FROM mp) AS dedup_verified,
CASE WHEN i.id IN (SELECT survivor FROM mp) AND i.id % 2 = 0 THEN 'merged ' || i.id ELSE i.text END AS text, array_to_string(coalesce(sf.l, [i.source_session]), ',') AS sessions FROM items i LEFT JOIN sf USING (id)""")
def merged(spark, d):
    """Survivors with even ids get a new text; all get the sessions of their group."""
    i, m = _map(spark, d)
    m = m.select("survivor", "absorbed")
    texts = m.where("survivor % 2 = 0").select("survivor", F.concat(F.lit("merged "), F.col("survivor").cast("string")).alias("canonical_text")).distinct()
    out = D.merge_items(i, m, texts)
    return out.select("id", "occurrence_count", F.unix_timestamp("refreshed_at").alias("refreshed_s"), "deprecated", "dedup_verified", "text", F.array_join("source_sessions", ",").alias("sessions"))


@query("u04_merge_tags", _MAP + "SELECT DISTINCT coalesce(survivor, item_id) AS item_id, tag FROM item_tags LEFT JOIN mp ON absorbed = item_id")
def merged_tags(spark, d):
    m = _map(spark, d)[1].select("survivor", "absorbed")
    return D.merge_tags(B.item_tags(spark, d), m)


@query("a08_merged_relevance", _MAP + """, x AS (SELECT coalesce(survivor, item_id) AS item_id, item_id AS old, tag, score, pos, neg FROM rel LEFT JOIN mp ON absorbed = item_id)
SELECT item_id, tag, round(CASE WHEN sum(pos + neg) > 0 THEN sum(score * (pos + neg)) / sum(pos + neg) ELSE arg_min(score, (old <> item_id, old)) END, 6) AS score, sum(pos)::INT AS positive_evals, sum(neg)::INT AS negative_evals FROM x GROUP BY item_id, tag""")
def merged_rel(spark, d):
    from lodestone.operators import feedback as fb

    m = _map(spark, d)[1].select("survivor", "absorbed")
    return fb.merged_relevance(fb.relevance(B.verdict_events(spark, d)), m).withColumn("score", F.round("score", 6))


@query("m12_merge_log_ids", _MAP + """, e AS (SELECT l.session_id, min(seq) AS seq, coalesce(survivor, item_id) AS i FROM shown l LEFT JOIN mp ON absorbed = item_id GROUP BY l.session_id, 3)
SELECT session_id, string_agg(i::VARCHAR, ',' ORDER BY seq) AS ids FROM e GROUP BY session_id""")
def merged_log(spark, d):
    m = _map(spark, d)[1].select("survivor", "absorbed")
    log = B.shown(spark, d).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "item_id"))), lambda x: x["item_id"]).alias("ids"))
    out = D.merge_id_lists(log, m, "ids", "session_id")
    return out.select("session_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("x08_s27_snapshots", """g AS (SELECT id, occurrence_count, count(*) OVER (PARTITION BY text) AS n, first_value(id) OVER (PARTITION BY text ORDER BY dedup_verified DESC, occurrence_count DESC, id) AS survivor FROM items WHERE NOT deprecated),
mp AS (SELECT id AS absorbed, survivor FROM g WHERE n > 1 AND id <> survivor), so AS (SELECT survivor AS id, sum(occurrence_count) AS n FROM g WHERE n > 1 GROUP BY survivor),
v AS (SELECT 1 AS version, deprecated OR id IN (SELECT absorbed FROM mp) AS gone, coalesce(so.n, occurrence_count) AS n FROM items LEFT JOIN so USING (id) UNION ALL SELECT unnest([0, 2]), deprecated, occurrence_count FROM items),
t AS (SELECT v AS version, count(*) AS tags FROM item_tags, (SELECT unnest([0, 2]) AS v) GROUP BY v UNION ALL SELECT 1, count(*) FROM (SELECT DISTINCT coalesce(survivor, item_id), tag FROM item_tags LEFT JOIN mp ON absorbed = item_id))
SELECT version::INT AS version, count(*) FILTER (NOT gone)::BIGINT AS active, sum(n)::BIGINT AS occurrences, any_value(tags)::BIGINT AS tags, (SELECT count(*) FROM items WHERE NOT deprecated AND id % 50 = 0)::BIGINT AS put_aside FROM v JOIN t USING (version) GROUP BY version""")
def snapshots(spark, d):
    """Items and tags as version 0; groups of equal active texts merge as version 1, groups of one item are put aside; version 2 restores 0."""
    i = B.items(spark, d)
    store = Snapshots(spark, files.scratch(spark))
    store.commit({"items": i, "item_tags": B.item_tags(spark, d)}, -1)
    active = i.where("not deprecated")
    same = active.groupBy("text").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).select("ids", "text", F.array_min("ids").alias("pos"))
    alone = active.where("id % 50 = 0").select(F.array("id").alias("ids"), "text", (F.col("id") + (1 << 40)).alias("pos"))
    groups = same.unionByName(alone).select((F.col("pos") % 8).alias("batch"), "pos", "ids", F.col("text").alias("canonical_text"), F.lit(1.0).alias("confidence"), F.lit("same text").alias("reason"))
    _, aside = merge_groups(store, groups)
    n = aside.count()
    store.restore(0)
    out = None
    for version in (0, 1, 2):
        t = store.read(version)
        one = t["items"].agg(F.count_if(~F.col("deprecated")).alias("active"), F.sum("occurrence_count").alias("occurrences")).crossJoin(t["item_tags"].agg(F.count(F.lit(1)).alias("tags")))
        one = one.select(F.lit(version).alias("version"), "active", "occurrences", "tags", F.lit(n).cast("long").alias("put_aside"))
        out = one if out is None else out.unionByName(one)
    return out


@query("m12_merge_shown", _MAP + "SELECT session_id, coalesce(survivor, item_id) AS item_id, min(shown_at) AS shown_at FROM shown LEFT JOIN mp ON absorbed = item_id GROUP BY ALL")
def merged_shown(spark, d):
    m = _map(spark, d)[1].select("survivor", "absorbed")
    return D.merge_shown(B.shown(spark, d).select("session_id", "item_id", "shown_at"), m)


@query("x07_greedy_chunks", """w AS (SELECT 0 AS pos, (SELECT min(id) FROM vec) AS id, [(SELECT min(id) FROM vec)] AS seen
UNION ALL SELECT pos + 1, id, list_append(seen, id) FROM (SELECT w.pos, w.seen, arg_max(b.id, (round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 9), -b.id)) AS id FROM w JOIN vn a ON a.id = w.id, vn b WHERE NOT list_contains(w.seen, b.id) GROUP BY w.pos, w.seen))
SELECT id, pos::BIGINT AS pos, (pos // 20)::BIGINT AS chunk FROM w""", True)
def greedy(spark, d):
    return D.greedy_chunks(B.vectors(spark, d).select("id", "embedding"))


def _pass_sql(i):
    """Tables of one pass over v<i>: n<i> with norms, t<i> nearest of each from 0.3 on, m<i> mutual ones, v<i + 1> what is left."""
    return f"""n{i} AS (SELECT id, e::DOUBLE[] AS e, sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[])) + 1e-10 AS norm FROM v{i}_),
t{i} AS (SELECT a, arg_max(b, (s, -b)) AS b FROM (SELECT x.id AS a, y.id AS b, round(list_inner_product(x.e, y.e) / (x.norm * y.norm), 9) AS s FROM n{i} x, n{i} y WHERE x.id <> y.id) WHERE s >= 0.3 GROUP BY a),
m{i} AS (SELECT p.a AS survivor, p.b AS absorbed FROM t{i} p JOIN t{i} q ON q.a = p.b AND q.b = p.a WHERE p.a < p.b),
v{i + 1}_ AS (SELECT id, CASE WHEN m.absorbed IS NULL THEN x.e ELSE list_transform(range(1, len(x.e) + 1), lambda k: (x.e[k]::DOUBLE + y.e[k]::DOUBLE)::FLOAT) END AS e FROM v{i}_ x LEFT JOIN m{i} m ON m.survivor = x.id LEFT JOIN (SELECT id AS yid, e FROM v{i}_) y ON y.yid = m.absorbed WHERE x.id NOT IN (SELECT absorbed FROM m{i}))"""


@query("x09_passes", "v0_ AS (SELECT vec_id AS id, embedding AS e FROM embeddings), " + _pass_sql(0) + ", " + _pass_sql(1) + " SELECT 1::INT AS pass, survivor, absorbed FROM m0 UNION ALL SELECT 2, survivor, absorbed FROM m1")
def passes(spark, d):
    """Two passes in which each other's nearest merge, the second one over lists that carry over."""
    v = B.vectors(spark, d).select("id", "embedding")
    return P.dedup_passes(v, P.mutual_nearest, P.summed, 0.3, most=2)[1]


@query("x05_batches", _CAND + """, g AS (SELECT source_id, any_value(length(s.text)) AS chars, list(struct_pack(id := target_id, n := length(t.text))) AS near, row_number() OVER (ORDER BY source_id) AS n
  FROM r JOIN items s ON s.id = source_id JOIN items t ON t.id = target_id WHERE rank0 < 8 GROUP BY source_id),
walk AS (SELECT 0::BIGINT AS n, -1::BIGINT AS source_id, 0::BIGINT AS batch, 0::BIGINT AS used, []::BIGINT[] AS shown
UNION ALL SELECT n, source_id, CASE WHEN over THEN batch + 1 ELSE batch END, CASE WHEN over THEN whole ELSE used + cost END, CASE WHEN over THEN ids ELSE list_distinct(list_concat(shown, ids)) END FROM (
  SELECT *, len(shown) > 0 AND used + cost > 6000 AS over FROM (SELECT g.n, g.source_id, batch, used, shown, list_append(list_transform(near, lambda c: c.id), g.source_id) AS ids,
    chars + coalesce(list_sum(list_transform(near, lambda c: c.n)), 0)::BIGINT AS whole,
    CASE WHEN list_contains(shown, g.source_id) THEN 0 ELSE chars END + coalesce(list_sum(list_transform(list_filter(near, lambda c: NOT list_contains(shown, c.id)), lambda c: c.n)), 0)::BIGINT AS cost FROM walk JOIN g ON g.n = walk.n + 1)))
SELECT source_id, batch FROM walk WHERE n > 0""", True)
def batches(spark, d):
    u, v = _pools(spark, d)
    c = D.candidates(u, v, 0.3)
    n = B.items(spark, d).select("id", F.length("text").alias("chars"))
    near = c.join(n.withColumnRenamed("id", "target_id"), "target_id").groupBy("source_id").agg(F.collect_list(F.struct(F.col("target_id").alias("id"), "chars")).alias("candidates"))
    return D.batches(near.join(n.withColumnRenamed("id", "source_id"), "source_id"))


@query("m21_curation", "SELECT id, (CASE WHEN quality IS NULL THEN status ELSE coalesce(status, 0) | 1 | (CASE WHEN quality = 0 THEN 2 ELSE 0 END) END)::INT AS status FROM items")
def curated(spark, d):
    i = B.items(spark, d)
    verdicts = i.where("quality is not null").select("id", F.when(F.col("quality") == 0, "reject").otherwise("keep").alias("verdict"))
    return D.curation(i, verdicts).select("id", "status")


@query("j15_unmerged_pairs", """c AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.e, b.e) / (a.norm * b.norm) AS s FROM vn a, vn b WHERE a.id < b.id),
o AS (SELECT a, b, s FROM c WHERE round(s, 9) >= 0.3),
k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(s, 9) DESC, y) - 1 AS r FROM (SELECT a AS x, b AS y, s FROM o UNION ALL SELECT b, a, s FROM o))
SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, round(s, 6) AS similarity FROM k WHERE r < 8 AND (x + y) % 3 <> 0 ORDER BY 3 DESC, 1, 2 LIMIT 25""")
def unmerged(spark, d):
    """A third of the pairs has been merged already, in either direction."""
    p = D.self_candidates(B.vectors(spark, d), 0.3).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.round("similarity", 6).alias("similarity")).distinct()
    merged = p.where("(a + b) % 3 = 0").select(F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("survivor"), F.when(F.col("a") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("absorbed"))
    return D.unmerged_pairs(p, merged, 25)
