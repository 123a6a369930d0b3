"""Stored postings against the scan, over segments, removals and merges."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import postings as P
from lodestone.operators import search as S
from lodestone.sources import versions


def corpus(seed=1, n=500, vocabulary=300):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6)) % vocabulary}" for _ in range(3000)]
    text = lambda most: " ".join(r.choice(words) for _ in range(r.randint(0, most)))
    return [(i * 7 - 50, None if i == 3 else text(60)) for i in range(n)], [(i, None if i == 40 else text(9)) for i in range(41)] + [(90, "nothing known")]


@pytest.fixture(scope="module")
def tables(spark):
    docs, questions = corpus()
    return spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(questions, "query_id long, text string")


def ranked(found):
    return sorted((r.query_id, r.rank0, r.id, round(r.score, 9)) for r in found.collect())


def test_index_equals_the_scan_while_items_come_and_go(spark, tables, tmp_path):
    d, q = tables
    index = P.Postings(spark, f"file://{tmp_path}/index", 4, 60)
    assert index.search(q).count() == 0 and index.version() == -1
    a, b = d.where("id < 1500"), d.where("id >= 1500")
    index.add(a)
    index.add(b)
    assert ranked(index.search(q)) == ranked(S.bm25(d, q))
    gone = d.where("id % 3 = 0")
    index.remove(gone)
    assert ranked(index.search(q, 5, block=7)) == ranked(S.bm25(d.where("id % 3 <> 0"), q, 5))
    index.add(gone.where("id % 2 = 0"))
    now = d.where("id % 3 <> 0 or id % 2 = 0")
    want = ranked(S.bm25(now, q))
    assert ranked(index.search(q)) == want
    merged = index.merge()
    assert len(merged["segments"]) == 1 and not merged["removals"] and ranked(index.search(q)) == want
    assert ranked(index.search(q, version=1)) == ranked(S.bm25(d, q))


def test_a_question_reads_the_folders_of_its_terms_alone(spark, tables, tmp_path):
    d, _ = tables
    index = P.Postings(spark, f"file://{tmp_path}/index", 32, 60)
    index.add(d)
    one = spark.createDataFrame([(1, "w7")], "query_id long, text string")
    found = index.search(one)
    assert ranked(found) == ranked(S.bm25(d, one))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and index._asked(index._read(f"{index.manifest()['segments'][0]}/postings", P._POSTINGS), spark.createDataFrame([("w7",)], "term string").select(index._bucket(), "term"), [spark.createDataFrame([("w7",)], "term string").select(index._bucket()).first()[0]]).select("term").distinct().collect() == [("w7",)]


def test_of_two_writers_of_a_version_one_fails_and_may_try_again(spark, tables, tmp_path):
    d, q = tables
    one, two = (P.Postings(spark, f"file://{tmp_path}/index", 4) for _ in range(2))
    old = two.manifest()
    one.add(d.where("id < 1500"))
    with pytest.raises(versions.Conflict):
        two._commit(old, old | {"n": 1})
    two.add(d.where("id >= 1500"))
    assert ranked(one.search(q)) == ranked(S.bm25(d, q)) and versions.listed(spark, f"file://{tmp_path}/index/manifests") == [0, 1]


def test_numbers_round_trip_in_the_least_width():
    for x in ([0], [255, 3], [256], [1 << 16, 0], [1 << 32], [(1 << 62) + 5, 1]):
        held = P._bytes(np.array(x))
        assert P._numbers(held).tolist() == x and len(held) == 1 + len(x) * np.dtype(P._WIDTHS[held[0]]).itemsize


def lists_of(rows):
    """Lists over one stripe: rows are (term, [(id, tf, len)])."""
    import pyarrow as pa

    entries = pa.array([[{"id": i, "tf": t, "len": n} for i, t, n in x] for _, x in rows], pa.list_(pa.struct([("id", pa.int64()), ("tf", pa.int32()), ("len", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), pa.array([t for t, _ in rows]), pa.array([0] * len(rows), pa.int32()), entries], names=["bucket", "term", "stripe", "entries"])
    table = pa.Table.from_batches(P._packed([batch])).append_column("seg", pa.array([0] * sum(-(-len(x) // 128) for _, x in rows), pa.int32()))
    return P.Lists(table, {}, 1.5, 0.75, 20.0)


def test_blocks_that_cannot_matter_are_not_decoded():
    r = random.Random(4)
    rare = [(i * 1000, 9, 5) for i in range(12)]
    common = [(i, r.randint(1, 2), r.randint(20, 60)) for i in range(20_000)]
    lists = lists_of([("rare", rare), ("common", common)])
    weights = {"rare": 6.0, "common": 0.01}
    ids, scores = P.best_of(lists, weights, 10)
    share = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 20.0))
    want: dict = {}
    for term, x in (("rare", rare), ("common", common)):
        for i, tf, n in x:
            want[i] = want.get(i, 0.0) + weights[term] * share(tf, n)
    best = sorted(want, key=lambda i: (-round(want[i], 9), i))[:10]
    got = dict(zip(ids.tolist(), scores.tolist(), strict=True))
    assert sorted(got, key=lambda i: (-round(got[i], 9), i))[:10] == best and all(got[i] == pytest.approx(want[i]) for i in best)
    assert lists.decoded < 20 < 20_000 // 128


def test_lists_are_packed_as_they_stream_whatever_the_batches():
    r = random.Random(2)
    rows = [(1, t, s, i, r.choice([1, 300, 70000]), r.randint(1, 400)) for t, n in (("a", 300), ("b", 1), ("c", 128)) for s in (0, 2) for i in sorted(r.sample(range(-50, 1 << 34), n))]
    names = ["bucket", "term", "stripe", "id", "tf", "len"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    cut = lambda k: [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + k]), types)], names=names) for i in range(0, len(rows), k)]
    want = [x for t, n in (("a", [128, 128, 44]), ("b", [1]), ("c", [128])) for _ in (0, 2) for x in [(t, k, v) for k, v in enumerate(n)]]
    for k in (1, 100, 128, 5000):
        blocks = pa.Table.from_batches(P._streamed(iter(cut(k))))
        assert list(zip(*(blocks[c].to_pylist() for c in ("term", "block", "n")))) == want
        back = pa.Table.from_batches(P._unpacked(iter(blocks.to_batches())))
        assert list(zip(*(back[c].to_pylist() for c in ("term", "id", "tf", "len")))) == [(x[1], x[3], x[4], x[5]) for x in rows]
