"""Batch rules of the incremental operators, and first showings (Z02-Z04, Z07, Z09); ``ordered.py`` has the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_shown(shown: DataFrame, event_time: str | None = None, within: str = "24 hours") -> DataFrame:
    """First showing of an item per session.

    On a stream, name the event time: a pair is then remembered for ``within``, after which the
    session is taken to be over, so state is bounded by the sessions of that time.
    """
    keys = ["session_id", "item_id"]
    if event_time is None:
        return shown.dropDuplicates(keys)
    return shown.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def new_narrations(rows: DataFrame) -> DataFrame:
    """Narrations (session, seq, narration) that differ from the session's one before; for micro-batches or tables."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("seq")
    return rows.withColumn("_last", F.lag("narration").over(w)).where(~F.col("narration").eqNullSafe(F.col("_last"))).drop("_last")


def coalesced_queue(requests: DataFrame) -> DataFrame:
    """session, path, first_seq: one job per session with its latest path, in order of first request."""
    return requests.groupBy("session").agg(F.max_by("path", "seq").alias("path"), F.min("seq").alias("first_seq")).orderBy("first_seq")


def needs_work(sizes: DataFrame, offsets: DataFrame, least_bytes: int = 10_240, covered: float = 0.9) -> DataFrame:
    """session, from_offset of transcripts large enough and less than covered (sizes: session, bytes; offsets: session, offset)."""
    j = sizes.join(offsets, "session", "left").withColumn("from_offset", F.coalesce("offset", F.lit(0)))
    return j.where((F.col("bytes") >= least_bytes) & (F.col("from_offset") < covered * F.col("bytes"))).select("session", "from_offset", "bytes")
