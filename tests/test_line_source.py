"""The data source of transcript lines: splits, streams, half lines, restarts."""

import random

import pytest

from lodestone.sources import line_source as L
from lodestone.sources import transcripts as X


def written(folder, seed=0, files=4):
    r = random.Random(seed)
    for k in range(files):
        lines = [r.choice(["", " ", "é" * r.randint(1, 30), "x" * r.randint(1, 200), '{"type": "user"}']) for _ in range(r.randint(0, 60))]
        (folder / f"s{k}.jsonl").write_bytes(("\n".join(lines) + ("\n" if k % 2 else "")).encode())
    (folder / "empty.jsonl").write_bytes(b"")
    (folder / "_hidden").write_bytes(b"no\n")


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_batch_equals_whole_files_in_any_split(spark, tmp_path, size):
    written(tmp_path)
    L.register(spark)
    got = spark.read.format("transcript_lines").option("path", f"file://{tmp_path}").option("splitBytes", size).load()
    want = X.read_lines(spark, f"file://{tmp_path}/*.jsonl").where("value rlike '\\\\S'").select("session", "start", "value")
    assert sorted((r.session, r.start, r.value) for r in got.collect()) == sorted((r.session, r.start, r.value) for r in want.collect())
    assert all(r.end - r.start - len(r.value.encode()) in (0, 1) for r in got.collect())


def test_splits_read_every_line_once(tmp_path):
    written(tmp_path, 3)
    for f in tmp_path.glob("*.jsonl"):
        held = f.read_bytes()
        for size in range(1, 40):
            got = [x for s in L._splits(f.name, 0, len(held), size) for x in L.lines_of(str(tmp_path), s)]
            assert [x[3] for x in got] == [x.decode() for x in held.split(b"\n") if x.strip()] and all(held[a:b].rstrip(b"\n").decode() == v for _, a, b, v in got)


def test_missing_folder_has_no_lines(spark, tmp_path):
    L.register(spark)
    assert spark.read.format("transcript_lines").option("path", f"file://{tmp_path}/none").load().count() == 0


def test_stream_leaves_half_lines_and_goes_on_after_a_restart(spark, tmp_path):
    L.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    lines = lambda: sorted((r.session, r.start, r.end, r.value) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    def step():
        stream = spark.readStream.format("transcript_lines").option("path", f"file://{folder}").option("splitBytes", 9).load()
        q = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    (folder / "a.jsonl").write_bytes("one\ntwö\nhal".encode())
    (folder / "b.jsonl").write_bytes(b"no line feed yet")
    step()
    assert lines() == [("a.jsonl", 0, 4, "one"), ("a.jsonl", 4, 9, "twö")]
    with open(folder / "a.jsonl", "ab") as f:
        f.write(b"f\n\nlast\n")
    (folder / "b.jsonl").write_bytes(b"no line feed yet\n")
    (folder / "c.jsonl").write_bytes(b"new\n")
    step()
    step()
    batch = spark.read.format("transcript_lines").option("path", f"file://{folder}").load()
    assert lines() == sorted((r.session, r.start, r.end, r.value) for r in batch.collect()) and len(lines()) == 6
