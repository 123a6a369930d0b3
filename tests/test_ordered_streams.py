"""Streams in order of events, over shuffled rows in several micro-batches and over restarts, against batch rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import feedback as fb
from lodestone.streaming import ordered as O
from lodestone.streaming import sessions as Z

START = datetime(2024, 1, 1)


def files(spark, folder, rows, schema, parts, last):
    """Rows dealt to parts, a micro-batch each, the last with a row that moves the watermark past all others."""
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] + ([last] if i == parts - 1 else []), schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def minutes(i):
    return START + timedelta(minutes=i)


@pytest.mark.parametrize("parts", [1, 3])
def test_running_relevance_follows_events_not_arrival(spark, tmp_path, parts):
    r = random.Random(1)
    events = [(r.randint(1, 3), r.choice("ab"), r.choice([-9.0, 0.5, 1.0]), 1.0, i, minutes(i)) for i in range(80)]
    r.shuffle(events)
    flush = (9, "flush", 0.0, 1.0, 999, minutes(100_000))
    schema = "item_id long, tag string, raw double, weight double, seq long, ts timestamp"
    got = O.finished(O.running_relevance(files(spark, tmp_path / "in", events, schema, parts, flush), "ts", "2 hours"), f"file://{tmp_path}/run")
    last = got.where("tag <> 'flush'").groupBy("item_id", "tag").agg(F.max_by("score", "seq").alias("score"), F.max_by("positive_evals", "seq").alias("p"), F.max("seq").alias("seq"))
    want = fb.relevance(spark.createDataFrame(events, schema))
    assert sorted((x.item_id, x.tag, round(x.score, 9), x.p, x.seq) for x in last.collect()) == sorted((x.item_id, x.tag, round(x.score, 9), x.positive_evals, x.last_seq) for x in want.collect())
    assert got.where("tag <> 'flush'").count() == 80


def test_narrations_remember_the_batch_before(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, r.choice("xy"), minutes(i)) for i in range(60)]
    r.shuffle(rows)
    schema = "session string, seq long, narration string, ts timestamp"
    stream = files(spark, tmp_path / "in", rows, schema, 3, ("flush", 999, "z", minutes(100_000)))
    got = O.finished(O.new_narrations(stream, "ts", "2 hours"), f"file://{tmp_path}/run").where("session <> 'flush'")
    want = Z.new_narrations(spark.createDataFrame(rows, schema))
    assert sorted(tuple(x) for x in got.collect()) == sorted((x.session, x.seq, x.narration) for x in want.collect())


def test_sessions_over_restarts(spark, tmp_path):
    """Thresholds, coverage, small transcripts and expiry; the second run goes on from the first one's state."""
    schema = "session string, end long, text string, ts timestamp"
    first = [("long", 60, "a" * 60, minutes(0)), ("small", 9, "tiny", minutes(0)), ("rest", 50, "r" * 30, minutes(1))]
    second = [("long", 140, "b" * 80, minutes(2)), ("rest", 120, "s" * 69, minutes(3)), ("rest", 220, "t", minutes(4)), ("flush", 1, "", minutes(100_000))]
    step = lambda: O.finished(O.session_texts(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "ts", "10 minutes", 100, 100, 0.9, 3_600_000), f"file://{tmp_path}/run")
    spark.createDataFrame(first, schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert step().count() == 0
    spark.createDataFrame(second, schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    got = sorted((tuple(x) for x in step().where("session <> 'flush'").collect()), key=lambda x: (x[0], x[1]))
    assert got == [
        ("long", "done", 140, 140, 140, ""),
        ("long", "text", 0, 140, 140, "a" * 60 + "\n" + "b" * 80),
        ("rest", "rest", 120, 220, 220, "t"),
        ("rest", "text", 0, 120, 120, "r" * 30 + "\n" + "s" * 69),
        ("small", "small", 0, 0, 9, ""),
    ]


@pytest.mark.parametrize("parts", [1, 4])
def test_queue_keeps_the_first_place_and_the_last_path(spark, tmp_path, parts):
    """A job ends when its session has been still for an hour, though all rows come at once or in any order."""
    schema = "session string, path string, seq long, ts timestamp"
    rows = [("a", "p4", 4, minutes(900)), ("a", "p3", 3, minutes(3)), ("b", "p2", 2, minutes(2)), ("a", "p1", 1, minutes(1))]
    stream = files(spark, tmp_path / "in", rows, schema, parts, ("flush", "", 9, minutes(100_000)))
    got = O.finished(O.queued_paths(stream, "ts", "1 day", 3_600_000), f"file://{tmp_path}/run")
    assert sorted((x.session, x.first_seq, x.path) for x in got.collect()) == [("a", 1, "p3"), ("a", 4, "p4"), ("b", 2, "p2")]


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with O.rocks(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
