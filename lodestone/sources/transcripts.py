"""Conversation transcripts as tables: parsing, metadata, excerpts, chunks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

_LINE = "type string, cwd string, aiTitle string, timestamp string, message struct<role:string, content:string>"
_PARTS = "array<struct<type:string, text:string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """session, line_no, value, start, end (bytes) of JSON-lines files; one row per line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("session"), F.split("value", "\n").alias("ls"))
    e = whole.select("session", F.posexplode("ls").alias("line_no", "value"))
    w = Window.partitionBy("session").orderBy("line_no")
    size = F.octet_length("value") + 1
    return e.withColumn("end", F.sum(size).over(w)).withColumn("start", F.col("end") - size).where("trim(value) <> ''")


def turns(lines: DataFrame, most: int | None = 500) -> DataFrame:
    """session, line_no, role, text of user and assistant lines; other and malformed lines are left out.

    Content is a string or a list of parts; texts of parts are joined by a space. Injected blocks
    are taken out, and texts cut to ``most`` characters; None keeps them whole.
    """
    j = lines.select("session", "line_no", F.from_json("value", _LINE).alias("j")).where(F.col("j.type").isin("user", "assistant"))
    content = F.col("j.message.content")
    parts = F.filter(F.from_json(content, _PARTS), lambda p: (p["type"] == "text") & p["text"].isNotNull())
    text = F.when(content.startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), " ")).otherwise(content)
    clean = F.regexp_replace(T.strip_blocks(F.coalesce(text, content)), r"^\s+|\s+$", "")
    role = F.coalesce(F.col("j.message.role"), F.col("j.type"))
    return j.select("session", "line_no", F.to_timestamp("j.timestamp").alias("ts"), role.alias("role"), (clean if most is None else F.substring(clean, 1, most)).alias("text")).where("text <> ''")


def transcript_text(turn_rows: DataFrame, most: int = 8000) -> DataFrame:
    """session, text: `role: text` lines in order, the last characters of them."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    g = turn_rows.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return g.select("session", F.right("text", F.lit(most)).alias("text"))


def user_prompts(turn_rows: DataFrame) -> DataFrame:
    return turn_rows.where((F.col("role") == "user") & (F.length("text") > 5)).select("session", "line_no", F.substring("text", 1, 500).alias("text"))


def metadata(lines: DataFrame) -> DataFrame:
    """session, cwd, title, repo: first known working directory and title; repo is the directory's last segment."""
    j = lines.select("session", "line_no", F.from_json("value", _LINE).alias("j"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    g = j.select("session", "line_no", F.col("j.cwd").alias("cwd"), F.when(F.col("j.type") == "ai-title", F.col("j.aiTitle")).alias("title")).groupBy("session").agg(first("cwd").alias("cwd"), first("title").alias("title"))
    return g.withColumn("repo", F.element_at(F.split(F.regexp_replace("cwd", "/+$", ""), "/"), -1)).withColumn("work_repo", F.nullif(F.regexp_extract("cwd", "^.*/work/([^/]*)", 1), F.lit("")))


def after_offset(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """Lines that begin at or after the offset of their session (session, offset; 0 if unknown)."""
    return lines.join(offsets, "session", "left").where(F.col("start") >= F.coalesce("offset", F.lit(0))).drop("offset")


def before_offset(lines: DataFrame, offsets: DataFrame, most: int = 2000) -> DataFrame:
    """session, context: the last characters of turns that end by the offset."""
    old = lines.join(offsets, "session").where(F.col("end") <= F.col("offset"))
    return transcript_text(turns(old), most).withColumnRenamed("text", "context")


def latest_narration(turn_rows: DataFrame, last: int = 50, least: int = 10) -> DataFrame:
    """session, narration: the newest assistant text of more than ``least`` characters in the last lines."""
    w = Window.partitionBy("session").orderBy(F.desc("line_no"))
    near = turn_rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    return near.where((F.col("role") == "assistant") & (F.length(F.trim("text")) > least)).groupBy("session").agg(F.max_by("text", "line_no").alias("narration"))


def best_turn(shown: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """session, query_id, turn: the user turn that a shown query (session, query_id, text) came from.

    First ten words of the query against first twenty of the turn; at least two shared, the
    earliest of the best.
    """
    q = shown.select("session", "query_id", F.slice(T.word_set("text"), 1, 10).alias("qw"))
    t = turn_rows.where(F.col("role") == "user").select("session", F.col("line_no").alias("turn"), F.slice(T.word_set("text"), 1, 20).alias("tw"))
    m = q.join(t, "session").withColumn("shared", F.size(F.array_intersect("qw", "tw"))).where("shared >= 2")
    w = Window.partitionBy("session", "query_id").orderBy(F.desc("shared"), "turn")
    return m.withColumn("n", F.row_number().over(w)).where("n = 1").select("session", "query_id", "turn", "shared")


def turn_window(matches: DataFrame, turn_rows: DataFrame, follow: int = 5, budget: int = 1500, rest: int = 100) -> DataFrame:
    """session, query_id, turn, role, text: the matched turn and what follows it, up to the next user
    turn (included) and while at least ``rest`` characters of the budget are left.

    The matched turn may use a third of the budget, each later one what is left of it.
    """
    t = turn_rows.select("session", F.col("line_no").alias("at"), "role", "text")
    order = Window.partitionBy("session").orderBy("at")
    t = t.withColumn("idx", F.row_number().over(order))
    m = matches.select("session", "query_id", F.col("turn").alias("at")).join(t.select("session", "at", F.col("idx").alias("base")), ["session", "at"]).drop("at")
    j = m.join(t, "session").where((F.col("idx") >= F.col("base")) & (F.col("idx") <= F.col("base") + follow))
    w = Window.partitionBy("session", "query_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    users = F.coalesce(F.sum(((F.col("role") == "user") & (F.col("idx") > F.col("base"))).cast("int")).over(w), F.lit(0))
    own = F.col("idx") == F.col("base")
    j = j.withColumn("text", F.when(own, F.left("text", F.lit(budget // 3))).otherwise(F.col("text")))
    left = F.lit(budget) - F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    shown = j.withColumn("users", users).withColumn("left", left).where((F.col("users") == 0) & (own | (F.col("left") >= rest)))
    return shown.select("session", "query_id", F.col("at").alias("turn"), "role", F.substring("text", F.lit(1), F.col("left").cast("int")).alias("text"))


def chunks(turn_rows: DataFrame, most: int = 30_000, overlap: float = 0.15, cut: int | None = None) -> DataFrame:
    """session, chunk, first_line, last_line, text: runs of whole messages that overlap.

    A chunk takes messages while they fit; the next one begins so far back that it repeats at least
    the overlap's share of characters, or right after the chunk where that would be the chunk's own
    start. A session that fits is one chunk. Sessions are walked one by one.
    """

    def walk(g):
        import pandas as pd

        g = g.sort_values("line_no")
        lines = g["line_no"].tolist()
        msgs = [f"{r}: {t[:cut] if cut else t}" for r, t in zip(g["role"], g["text"], strict=True)]
        out, i, n = [], 0, len(msgs)
        whole = sum(map(len, msgs)) + n - 1 <= most
        while i < n:
            j, used = (n if whole else i), 0
            while j < n and (j == i or used + len(msgs[j]) + 1 <= most):
                used += len(msgs[j]) + 1
                j += 1
            out.append((g["session"].iloc[0], len(out), int(lines[i]), int(lines[j - 1]), "\n".join(msgs[i:j])))
            if j >= n:
                break
            back, k = 0, j
            while k > i and back < int(most * overlap):
                k -= 1
                back += len(msgs[k]) + 1
            i = k if k > i else j
        return pd.DataFrame(out, columns=["session", "chunk", "first_line", "last_line", "text"])

    return turn_rows.select("session", "line_no", "role", "text").groupBy("session").applyInPandas(walk, "session string, chunk long, first_line long, last_line long, text string")
