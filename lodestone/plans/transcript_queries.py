"""Transcripts, the query gate and prompts (S11-S19, P06-P11, J16, J17, X06, Z)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources import transcripts as X
from lodestone.streaming import sessions as Z

from . import base as B

QUERIES, ORACLES = {}, {}


def query(name, sql=None, recursive=False):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = B.sql(sql, recursive)
        return f

    return add


def _lines(spark, d):
    """conversations as JSON transcript lines; other roles get a type that transcripts skip."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    kind = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("summary")
    content = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text"))))
    value = F.to_json(F.struct(kind.alias("type"), F.concat(F.lit("/home/work/"), F.col("role")).alias("cwd"), F.struct("role", content.alias("content")).alias("message")))
    end = F.sum(F.octet_length("value") + 1).over
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("line_no")
    base = c.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("line_no"), value.alias("value"))
    return base.withColumn("end", end(w)).withColumn("start", F.col("end") - F.octet_length("value") - 1)


_CUT = r"t AS (SELECT session, line_no, role, left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 500) AS text FROM turns)"


@query("s11_s12_turns", _CUT + " SELECT session, line_no, role, text FROM t")
def turns(spark, d):
    return X.turns(_lines(spark, d)).select("session", "line_no", "role", "text")


_WHOLE = r"t AS (SELECT session, line_no, role, text FROM (SELECT session, line_no, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM turns) WHERE text <> '')"


@query("s12_turns", _WHOLE + " SELECT session, line_no, role, text FROM t")
def whole_turns(spark, d):
    """S12 keeps whole messages; the cut to 500 characters belongs to S11 and S13."""
    return X.turns(_lines(spark, d), None).select("session", "line_no", "role", "text")


@query("s11_transcript_text", _CUT + " SELECT session, right(string_agg(role || ': ' || text, chr(10) ORDER BY line_no), 800) AS text FROM t GROUP BY session")
def transcript(spark, d):
    return X.transcript_text(X.turns(_lines(spark, d)), 800)


@query("s13_user_prompts", _CUT + " SELECT session, line_no, text FROM t WHERE role = 'user' AND length(text) > 5")
def prompts(spark, d):
    return X.user_prompts(X.turns(_lines(spark, d)))


@query("s14_metadata", "SELECT session, '/home/work/' || arg_min(role, turn) AS cwd, arg_min(role, turn) AS repo, arg_min(role, turn) AS work_repo FROM (SELECT conv_id::VARCHAR AS session, turn, role FROM conversations) GROUP BY session")
def metadata(spark, d):
    return X.metadata(_lines(spark, d)).select("session", "cwd", "repo", "work_repo")


@query("s19_narration", _CUT + " SELECT session, arg_max(text, line_no) AS narration FROM t WHERE role = 'assistant' AND length(trim(text)) > 10 GROUP BY session")
def narration(spark, d):
    return X.latest_narration(X.turns(_lines(spark, d)))


_WS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))"


@query("j16_best_turn", _WHOLE + f""", u AS (SELECT session, line_no, list_slice({_WS}, 1, 20) AS tw, list_slice({_WS}, 1, 10) AS qw FROM t WHERE role = 'user'),
q AS (SELECT session, max(line_no) AS m FROM u GROUP BY session), k AS (SELECT u.session, u.line_no AS query_id, u.qw FROM u JOIN q ON q.session = u.session AND q.m = u.line_no)
SELECT session, query_id, turn, shared::INT AS shared FROM (SELECT k.session, k.query_id, u.line_no AS turn, len(list_intersect(qw, tw)) AS shared, row_number() OVER (PARTITION BY k.session, k.query_id ORDER BY len(list_intersect(qw, tw)) DESC, u.line_no) AS r FROM k JOIN u USING (session) WHERE len(list_intersect(k.qw, tw)) >= 2) WHERE r = 1""".replace("list_intersect(qw, tw)", "list_intersect(k.qw, u.tw)").replace("list_intersect(k.qw, tw)", "list_intersect(k.qw, u.tw)"))
def best_turn(spark, d):
    t = X.turns(_lines(spark, d), None)
    u = t.where("role = 'user'")
    last = u.groupBy("session").agg(F.max("line_no").alias("line_no"))
    return X.best_turn(u.join(last, ["session", "line_no"]).select("session", F.col("line_no").alias("query_id"), "text"), t)


@query("j17_turn_window", _WHOLE + """, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_no) AS idx FROM t),
b AS (SELECT session, min(idx) AS base, min(line_no) AS q FROM n WHERE role = 'user' GROUP BY session),
v AS (SELECT n.session, b.q AS query_id, n.line_no AS turn, n.role, n.idx, b.base, CASE WHEN n.idx = b.base THEN left(n.text, 300) ELSE n.text END AS text FROM b JOIN n ON n.session = b.session AND n.idx BETWEEN b.base AND b.base + 5),
w AS (SELECT *, coalesce(sum((role = 'user' AND idx > base)::INT) OVER p, 0) AS users, 900 - coalesce(sum(length(text)) OVER p, 0) AS rest FROM v WINDOW p AS (PARTITION BY session ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session, query_id, turn, role, left(text, greatest(rest, 0)::BIGINT) AS text FROM w WHERE users = 0 AND (idx = base OR rest >= 100)""")
def window(spark, d):
    t = X.turns(_lines(spark, d), None)
    first = t.where("role = 'user'").groupBy("session").agg(F.min("line_no").alias("turn")).withColumn("query_id", F.col("turn"))
    return X.turn_window(first, t, budget=900)


@query("x06_chunks", _WHOLE + """, m AS (SELECT session, line_no, role || ': ' || text AS x, row_number() OVER (PARTITION BY session ORDER BY line_no) - 1 AS k FROM t),
p AS (SELECT session, count(*) AS n, sum(length(x)) + count(*) - 1 <= 1500 AS one, list_prepend(0::HUGEINT, list(s ORDER BY k)) AS ps FROM (SELECT *, sum(length(x) + 1) OVER (PARTITION BY session ORDER BY k) AS s FROM m) GROUP BY session),
w AS (SELECT session, -1::BIGINT AS chunk, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS nxt FROM p
UNION ALL SELECT session, chunk + 1, i, j, CASE WHEN greatest(i, b - 1) > i THEN b - 1 ELSE j END FROM (SELECT *, len(list_filter(ps[1:j], lambda y: ps[j + 1] - y >= 225)) AS b FROM (
  SELECT p.session, chunk, nxt AS i, ps, CASE WHEN one THEN n ELSE nxt + greatest(1, len(list_filter(ps[nxt + 2:], lambda y: y - ps[nxt + 1] <= 1500))) END AS j, n FROM w JOIN p ON p.session = w.session WHERE w.j < n)))
SELECT w.session, chunk, min(line_no) AS first_line, max(line_no) AS last_line, string_agg(x, chr(10) ORDER BY k) AS text FROM w JOIN m ON m.session = w.session AND k >= i AND k < j WHERE chunk >= 0 GROUP BY w.session, chunk""", True)
def chunks(spark, d):
    return X.chunks(X.turns(_lines(spark, d), None), 1500)


_GATE = r"""g AS (SELECT session, line_no, text, trim(regexp_replace(text, '<[^>]+>.*?</[^>]+>', '', 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS b FROM turns WHERE role = 'user')
SELECT session, line_no, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN b = '' THEN 'only_ide_tags' WHEN regexp_matches(b, '(?i)^\[Request interrupted') THEN 'interruption' END AS reason FROM g"""


@query("p06_low_information", _GATE)
def gate(spark, d):
    return B.turns(spark, d).where("role = 'user'").select("session", "line_no", T.low_information("text").alias("reason"))


@query("p07_enriched_prompt", r"SELECT session, line_no, left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 300) AS query FROM turns WHERE role = 'user'")
def enriched(spark, d):
    p = F.concat(F.lit("<ide_opened_file>The user opened the file /a/b/c/d.py in the IDE.</ide_opened_file>\n"), "text", F.lit("<system-reminder>x\ny</system-reminder>"))
    return B.turns(spark, d).where("role = 'user'").select("session", "line_no", T.enriched_prompt(p).alias("query"))


@query("p08_tool_queries", """w AS (SELECT event_id, event_type, user_id FROM log)
SELECT event_id, CASE event_type WHEN 'click' THEN 'git commit conventions' WHEN 'view' THEN 'editing python b/c/f' || user_id || '.py' WHEN 'error' THEN 'testing pytest -q t' || user_id WHEN 'purchase' THEN 'Read /x' || user_id ELSE NULL END AS query FROM w""")
def tool_queries(spark, d):
    u = F.col("user_id").cast("string")
    e = F.col("event_type")
    tool = F.when(e.isin("click", "error", "signup"), "Bash").when(e == "view", "Edit").otherwise("Read")
    command = F.when(e == "click", "git commit -m x").when(e == "error", F.concat(F.lit("pytest -q t"), u, F.lit(" more"))).otherwise("")
    path = F.when(e == "view", F.concat(F.lit("/a/b/c/f"), u, F.lit(".py"))).otherwise(F.concat(F.lit("/x"), u))
    return B.log(spark, d).select("event_id", T.tool_query(tool, {"command": command, "file_path": path}).alias("query"))


@query("s16_after_offset", "SELECT session, count(*)::BIGINT AS n FROM (SELECT conv_id::VARCHAR AS session, turn FROM conversations) WHERE turn >= 2 GROUP BY session")
def after(spark, d):
    lines = _lines(spark, d)
    off = lines.where("line_no = 2").select("session", F.col("start").alias("offset"))
    return X.after_offset(lines.join(off.select("session"), "session", "left_semi"), off).groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@query("z04_coalesced_queue", "SELECT session_id AS session, arg_max('p' || item_id, event_id) AS path, min(event_id) AS first_seq FROM log GROUP BY session_id")
def queue(spark, d):
    return Z.coalesced_queue(B.log(spark, d).select(F.col("session_id").alias("session"), F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("path"), F.col("event_id").alias("seq")))


@query("z09_new_narrations", "SELECT session_id AS session, event_id AS seq FROM (SELECT *, lag(event_type) OVER (PARTITION BY session_id ORDER BY event_id) AS p FROM log) WHERE event_type IS DISTINCT FROM p")
def narrations(spark, d):
    return Z.new_narrations(B.log(spark, d).select(F.col("session_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("narration"))).select("session", "seq")
