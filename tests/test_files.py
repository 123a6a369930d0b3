"""Label files, session discovery and offset snapshots on temporary folders."""

import json

from pyspark.sql import functions as F

from lodestone.operators import state as M
from lodestone.sources import files


def test_labels_of_all_runs_are_one_table(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "x.jsonl").write_text("\n".join(json.dumps({"text": f"{run}{i}", "value": i}) for i in range(3)) + "\n")
        (tmp_path / run / "y.json").write_text(json.dumps({"good": [{"text": run, "value": 9}], "other": 1}))
    lines = files.labelled_rows(spark, f"file://{tmp_path}/*/x.jsonl", "text string, value int")
    assert sorted(tuple(r) for r in lines.collect()) == [(r, "x.jsonl", f"{r}{i}", i) for r in "ab" for i in range(3)]
    listed = files.labelled_rows(spark, f"file://{tmp_path}/*/y.json", "text string, value int", "good")
    assert sorted(tuple(r) for r in listed.collect()) == [("a", "y.json", "a", 9), ("b", "y.json", "b", 9)]


def test_sessions_are_found_by_size(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "big.jsonl").write_text("x" * 20_000)
    (tmp_path / "p" / "small.jsonl").write_text("x")
    got = files.sessions_found(spark, f"file://{tmp_path}/*/*.jsonl").collect()
    assert [(r.session, r.bytes) for r in got] == [("big", 20_000)]


def test_offsets_never_move_back_and_the_newest_complete_snapshot_counts(spark, tmp_path):
    path = f"file://{tmp_path}/offsets"
    assert files.read_offsets(spark, path).count() == 0
    a = spark.createDataFrame([("s", 10), ("t", 5)], "session string, offset long")
    b = files.moved_offsets(a, spark.createDataFrame([("s", 4), ("t", 9), ("u", 1)], "session string, offset long"))
    files.write_offsets(a, path, 1)
    files.write_offsets(b, path, 2)
    (tmp_path / "offsets" / "v=3").mkdir()
    assert sorted(tuple(r) for r in files.read_offsets(spark, path).collect()) == [("s", 10), ("t", 9), ("u", 1)]


def test_rows_are_numbered_without_one_task(spark):
    d = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(500)], "k long, v string").repartition(7)
    got = {r.k: r.n for r in M.numbered(d, ["k"], "n").collect()}
    assert got == {k: n for n, k in enumerate(sorted(got))} and len(got) == 500
    assert M.numbered(d.limit(0), ["k"], "n").count() == 0


def test_two_million_rows_get_each_number_once(spark):
    n = 2_000_000
    d = spark.range(n).select((F.col("id") * 1_000_003 % n).alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    got = M.numbered(d, ["k"], "n")
    assert got.where("n <> k").count() == 0 and got.select("n").distinct().count() == n


def test_many_equal_rows_are_numbered_in_several_files(spark):
    d = spark.range(200_000).select(F.lit(5).alias("k"), "id")
    got = M.numbered(d, ["k", F.rand(7)], "n")
    r = got.agg(F.countDistinct("n").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    assert (r.n, r.lo, r.hi) == (200_000, 0, 199_999)
