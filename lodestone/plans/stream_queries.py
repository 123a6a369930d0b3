"""Streams over the given tables, run to the end of what is there.

A stream's watermark ends a day before the last event, so events of that day are still waiting;
the oracles leave them out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.sources import line_source
from lodestone.sources import transcripts as X
from lodestone.sources.files import scratch
from lodestone.streaming import ordered as O

from . import base as B

QUERIES, ORACLES = {}, {}


def query(name, sql=None, recursive=False):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = B.sql(sql, recursive)
        return f

    return add


_DONE = "done AS (SELECT *, epoch_ms(ts) AS ms FROM log WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) FROM log) - 86400000)"


def _events(spark, d):
    """events as a stream of what is in the table's files."""
    path = f"{d}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be one file
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("item_id"))


def _files(spark, d):
    """conversations as files of JSON lines, many sessions in each."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    kind = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("summary")
    value = F.to_json(F.struct(kind.alias("type"), F.col("conv_id").cast("string").alias("sessionId"), F.col("turn").alias("lineNo"), F.struct("role", F.col("text").alias("content")).alias("message")))
    path = scratch(spark)
    c.select(value.alias("value")).write.text(path)
    return path


def _turns(lines):
    """Turns of lines that name their session and place."""
    j = F.from_json("value", "sessionId string, lineNo long")
    return X.turns(lines.select(j["sessionId"].alias("session"), j["lineNo"].alias("line_no"), "value"), None).select("session", "line_no", "role", "text")


_TURNS = r"SELECT session, line_no, role, text FROM (SELECT session, line_no, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM turns) WHERE text <> ''"


@query("s11_line_source", _TURNS)
def line_batch(spark, d):
    """The data source in batch, over splits of 64 KB."""
    line_source.register(spark)
    return _turns(spark.read.format("transcript_lines").option("path", _files(spark, d)).option("splitBytes", 65536).load())


@query("z01_line_stream", _TURNS)
def line_stream(spark, d):
    """The same files as a stream."""
    line_source.register(spark)
    stream = spark.readStream.format("transcript_lines").option("path", _files(spark, d)).load()
    return _turns(O.finished(stream, scratch(spark)))


@query("z08_stream_relevance", _DONE + """, e AS (SELECT item_id, event_type AS tag, value / 250.0 - 1.0 AS raw, row_number() OVER (PARTITION BY item_id, event_type ORDER BY ms DESC, event_id DESC) - 1 AS n FROM done)
SELECT item_id, tag, round(sum(0.3 * raw * pow(0.7, n)), 6) AS score, count(*) FILTER (raw > 0)::INT AS positive_evals, count(*) FILTER (raw < 0)::INT AS negative_evals FROM e GROUP BY item_id, tag""")
def relevance(spark, d):
    """The last running average of each pair."""
    e = _events(spark, d).select("ts", "item_id", F.col("event_type").alias("tag"), (F.col("value") / 250.0 - 1.0).alias("raw"), F.lit(1.0).alias("weight"), F.col("event_id").alias("seq"))
    got = O.finished(O.running_relevance(e, "ts", "1 day"), scratch(spark))
    n = F.col("positive_evals") + F.col("negative_evals")
    last = got.groupBy("item_id", "tag").agg(F.max_by(F.struct("score", "positive_evals", "negative_evals"), F.struct(n, "seq")).alias("r")).select("item_id", "tag", "r.*")
    return last.withColumn("score", F.round("score", 6))


@query("z09_stream_narrations", _DONE + " SELECT session, seq, narration FROM (SELECT session_id AS session, event_id AS seq, event_type AS narration, lag(event_type) OVER (PARTITION BY session_id ORDER BY ms, event_id) AS p FROM done) WHERE narration IS DISTINCT FROM p")
def narrations(spark, d):
    rows = _events(spark, d).select("ts", "session", F.col("event_id").alias("seq"), F.col("event_type").alias("narration"))
    return O.finished(O.new_narrations(rows, "ts", "1 day"), scratch(spark))


@query("z01_z06_session_texts", _DONE + """, l AS (SELECT session_id AS session, event_id + 1 AS e, event_type AS t, row_number() OVER (PARTITION BY session_id ORDER BY ms, event_id) AS n FROM done),
w AS (SELECT DISTINCT session, 0::BIGINT AS n, '' AS held, 0::BIGINT AS start, 0::BIGINT AS from_offset, 0::BIGINT AS at_end, NULL::VARCHAR AS text FROM l
UNION ALL SELECT session, n, CASE WHEN full_text THEN '' ELSE x END, CASE WHEN full_text THEN e ELSE start END, start, e, CASE WHEN full_text THEN x END
  FROM (SELECT *, length(x) >= 60 AND e >= 500 AS full_text FROM (SELECT l.session, l.n, l.e, w.start, CASE WHEN w.held = '' THEN l.t ELSE w.held || chr(10) || l.t END AS x FROM w JOIN l ON l.session = w.session AND l.n = w.n + 1)))
SELECT session, from_offset, at_end AS "offset", text FROM w WHERE text IS NOT NULL""", True)
def sessions(spark, d):
    """Sessions' event types as lines; 60 characters make a text."""
    lines = _events(spark, d).select("ts", "session", (F.col("event_id") + 1).alias("end"), F.col("event_type").alias("text"))
    got = O.finished(O.session_texts(lines, "ts", "1 day", 60, 500, ttl_ms=400 * 86_400_000), scratch(spark))
    return got.where("kind = 'text'").select("session", "from_offset", "offset", "text")
