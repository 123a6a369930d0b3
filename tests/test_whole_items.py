"""Exports and logs hold whole item texts."""

import pytest

from lodestone.plans import item_queries as IQ

LONG = "alpha " * 200 + "end"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("store"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put("documents", [(1, LONG, "en", "s", 7), (2, "short", "en", "s", 5), (3, "gone", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    put("labels", [(3, 0, 0)], "doc_id long, quality int, toxic int")
    put("events", [(i, "2024-01-01 00:00:00", 1, "view", 1.0, '{"k": %d}' % i) for i in (1, 2, 3)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    return d


def test_export_writes_whole_texts(spark, store):
    assert [r.block for r in IQ.QUERIES["s22_export_markdown"](spark, store).collect()] == [f"## en/s\n- {LONG}\n- short"]


def test_log_shows_whole_texts(spark, store):
    assert {r.id: r.text for r in IQ.QUERIES["j20_log_texts"](spark, store).collect()} == {1: LONG, 2: "short", 3: "<deleted>"}
