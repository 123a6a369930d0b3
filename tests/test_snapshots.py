"""Versions of linked tables: two writers, a writer that dies, merges that conflict, restores and pruning."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators.snapshots import Snapshots, merge_groups
from lodestone.sources import versions

ITEM = "id long, text string, occurrence_count int, source_sessions array<string>, refreshed_at long, dedup_verified boolean, deprecated boolean"
GROUP = "batch long, pos long, ids array<long>, canonical_text string, confidence double, reason string"


def items(spark, n=6):
    return spark.createDataFrame([(i, f"t{i}", 1, [f"s{i}"], i, False, False) for i in range(1, n + 1)], ITEM)


def tags(spark):
    return spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "c")], "item_id long, tag string")


def store(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/store")
    assert s.version() == -1 and s.read() == {} and s.history() == []
    assert s.commit({"items": items(spark), "item_tags": tags(spark)}, -1) == 0
    return s


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_a_version_is_whole_and_older_ones_stay(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.commit({"items": s.read()["items"].where("id < 3")}, 0, note="fewer") == 1
    assert ids(s.read()["items"]) == [1, 2] and ids(s.read(0)["items"]) == [1, 2, 3, 4, 5, 6] and s.read()["item_tags"].count() == 4
    assert s.restore(0) == 2 and ids(s.read()["items"]) == [1, 2, 3, 4, 5, 6]
    assert [(h["version"], h["note"], h["changed"]) for h in s.history()] == [(0, "", ["item_tags", "items"]), (1, "fewer", ["items"]), (2, "restore of 0", ["item_tags", "items"])]


def test_of_two_writers_the_later_one_conflicts_only_over_what_it_read(spark, tmp_path):
    s = store(spark, tmp_path)
    t = s.read(0)
    assert s.commit({"item_tags": t["item_tags"].where("tag = 'a'")}, 0, ["item_tags"]) == 1
    with pytest.raises(versions.Conflict):
        s.commit({"items": t["items"]}, 0, ["items", "item_tags"])
    with pytest.raises(versions.Conflict):
        s.commit({"items": t["items"]}, 0)
    assert s.commit({"items": t["items"].where("id = 1")}, 0, ["items"]) == 2
    assert ids(s.read()["items"]) == [1] and s.read()["item_tags"].count() == 2


def test_a_writer_that_dies_between_tables_changes_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    dies = F.udf(lambda x: 1 / 0, "double")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        s.commit({"items": items(spark, 2), "item_tags": tags(spark).withColumn("tag", dies("tag"))}, 0)
    assert s.version() == 0 and ids(s.read()["items"]) == [1, 2, 3, 4, 5, 6]
    folders = lambda: len(versions.folders(spark, f"file://{tmp_path}/store/data"))
    assert folders() == 2 and s.prune(5) == [] and folders() == 2  # too young
    assert s.prune(5, older_than=-1.0) == [] and folders() == 1
    s.commit({"items": items(spark, 1)}, 0)
    assert s.prune(1, older_than=-1.0) == [0] and ids(s.read()["items"]) == [1] and s.read()["item_tags"].count() == 4


def test_groups_that_fail_are_put_aside_and_others_commit(spark, tmp_path):
    s = store(spark, tmp_path)
    groups = spark.createDataFrame([(0, 0, [1, 2], "one two", 0.9, ""), (0, 1, [3], "x", 0.9, ""), (0, 2, [2, 4], "x", 0.9, ""), (0, 3, [4, 99], "x", 0.9, ""), (1, 0, [5, 6], " ", 0.9, ""), (1, 1, [3, 5], "x", 1.5, "")], GROUP)
    version, aside = merge_groups(s, groups)
    assert version == 1 and {(r.batch, r.pos): r.problem for r in aside.collect()} == {(0, 1): "size", (0, 2): "reused", (0, 3): "unknown", (1, 0): "text", (1, 1): "confidence"}
    t = s.read()
    one = t["items"].where("id = 1").first()
    assert (one.text, one.occurrence_count, one.source_sessions) == ("one two", 2, ["s1", "s2"]) and ids(t["items"].where("deprecated").select("id")) == [2]
    assert sorted(tuple(r) for r in t["item_tags"].collect()) == [(1, "a"), (1, "b"), (3, "c")]
    assert merge_groups(s, groups.where("pos = 1 and batch = 0"))[0] == 1


def test_a_merge_judges_again_what_another_writer_has_changed(spark, tmp_path):
    s = store(spark, tmp_path)
    groups = spark.createDataFrame([(0, 0, [1, 2], "m", 0.9, ""), (0, 1, [3, 4], "n", 0.9, "")], GROUP)
    calls = []

    def other():
        if not calls:
            now = s.read()["items"]
            s.commit({"items": now.withColumn("deprecated", F.col("deprecated") | (F.col("id") == 2))}, s.version())
        calls.append(1)

    version, aside = merge_groups(s, groups, before_commit=other)
    assert version == 2 and len(calls) == 2 and [(r.pos, r.problem) for r in aside.collect()] == [(0, "unknown")]
    assert ids(s.read()["items"].where("deprecated").select("id")) == [2, 4]
