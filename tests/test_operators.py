"""Operators on small tables with values derived by hand, and streams against their batch form."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dedup as D
from lodestone.operators import evaluation as E
from lodestone.operators import feedback as fb
from lodestone.operators import search as S
from lodestone.operators import state as M
from lodestone.sources import files
from lodestone.sources import transcripts as X
from lodestone.streaming import sessions as Z

EV = "item_id long, tag string, raw double, weight double, seq long"


def test_fusion_order(spark):
    rows = [(1, 0, 1), (1, 1, 2), (1, 2, 3)], [(1, 0, 2), (1, 1, 4), (1, 2, 1)]
    lists = [spark.createDataFrame(r, "query_id long, rank0 int, id long") for r in rows]
    got = [(r.id, round(r.rrf, 6)) for r in S.top_k(S.fuse(lists, spark.createDataFrame([(60, 1.0, 0.0)], "k int, ceiling double, floor double")), 9).orderBy("rank0").collect()]
    assert got == [(2, 0.032522), (1, 0.032266), (4, 0.016129), (3, 0.015873)]


def test_bm25_gives_nothing_without_shared_tokens(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "id long, text string")
    q = spark.createDataFrame([(1, "delta"), (2, "alpha alpha"), (3, None)], "query_id long, text string")
    assert [(r.query_id, r.id) for r in S.bm25(items, q).collect()] == [(2, 1)]


def test_nearest_takes_queries_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(40)] + [(99, None)], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(7)], "query_id long, embedding array<float>")
    key = lambda d: sorted((r.query_id, r.rank0, r.id) for r in d.collect())
    assert key(S.nearest(v, q, 3, block=2)) == key(S.nearest(v, q, 3))
    assert S.nearest(v, q.limit(0), 3).count() == 0 and S.nearest(v.limit(0), q, 3).count() == 0


@pytest.mark.parametrize("events,want", [([(1, 1)] * 2, 0.51), ([(1, 2)], 0.6), ([(1, 1), (-0.5, 1), (0.9, 1), (2, 1), (-1, 1), (0.3, 1)], 0.281016), ([(100, 1)], 3.0)])
def test_relevance_fold(spark, events, want):
    df = spark.createDataFrame([(1, "t", float(x), float(w), i) for i, (x, w) in enumerate(events)], EV)
    assert fb.relevance(df).first().score == pytest.approx(want)


def test_bounded_fold_equals_the_ordered_one(spark):
    df = spark.createDataFrame([(i % 3, f"t{i % 2}", ((i * 37) % 21 - 10) / 10, 1.0, i) for i in range(200)], EV)
    a = {(r.item_id, r.tag): r.score for r in fb.relevance(df).collect()}
    b = {(r.item_id, r.tag): r.score for r in fb.relevance_bounded(df).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_means_differ_by_their_denominator(spark):
    rel = spark.createDataFrame([(1, "ts", 0.3, 1, 0)], "item_id long, tag string, score double, positive_evals int, negative_evals int")
    items = spark.createDataFrame([(1,), (2,)], "id long")
    assert fb.mean_over_rows(rel, ["ts", "react"]).first().avg_score == pytest.approx(0.3)
    got = {r.item_id: (r.avg_score, r.evidence) for r in fb.mean_over_requested(items, rel, ["ts", "react"]).collect()}
    assert got == {1: (pytest.approx(0.15), 1), 2: (0.0, 0)}


def test_pins_come_with_evidence_and_history(spark):
    ev = spark.createDataFrame([(1, "t", 1.0, 2.0, i) for i in range(5)] + [(2, "t", 1.0, 2.0, i) for i in range(4)] + [(1, "t", -1.0, 3.0, i) for i in range(5, 9)], EV)
    assert [(r.item_id, r.seq, r.pinned) for r in fb.pin_history(ev).orderBy("seq").collect()] == [(1, 4, True), (1, 6, False)]
    items = spark.createDataFrame([(1, False, False), (2, False, False), (3, True, False)], "id long, pinned boolean, auto_pinned boolean")
    state = {r.id: r.pinned for r in fb.pin_state(fb.relevance(ev.where("seq < 5")), items).collect()}
    assert state == {1: True, 2: False, 3: True}


def test_feedback_drops_only_with_enough_evaluations(spark):
    c = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5)], "query_id long, id long, score double")
    tags = spark.createDataFrame([(1, "t"), (2, "t")], "item_id long, tag string")
    rel = spark.createDataFrame([(1, "t", -0.3, 0, 1), (2, "t", -0.657, 0, 3)], "item_id long, tag string, score double, positive_evals int, negative_evals int")
    assert {r.id: round(r.score, 3) for r in S.feedback(c, tags, rel).collect()} == {1: 0.44, 3: 0.5}


def test_half_penalty_for_untagged_items(spark):
    c = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id long, id long")
    tags = spark.createDataFrame([(1, "a"), (1, "b")], "item_id long, tag string")
    prompt = spark.createDataFrame([(1, "p")], "query_id long, tag string")
    pairs = spark.createDataFrame([("a", "p", 0.9), ("b", "p", 0.6)], "tag string, other string, sim double")
    assert {(r.query_id, r.id): round(r.affinity, 4) for r in S.affinity(c, tags, prompt, pairs, penalty=-0.1).collect()} == {(1, 1): 0.17, (1, 2): -0.05}


def test_pending_queue(spark):
    a = spark.createDataFrame([(f"s{i}", i, f"r{i}") for i in range(5)], "session_id string, ts long, repo string")
    p = spark.createDataFrame([("s1", "completed", 0), ("s2", "failed", 2), ("s3", "failed", 3)], "session_id string, status string, retry_count int")
    assert [r.session_id for r in fb.pending(a, p).collect()] == ["s0", "s2", "s4"]
    assert [r.session_id for r in fb.pending(a, p, 2, ["r0"]).collect()] == ["s2"]


def test_merged_relevance_weighs_by_evidence(spark):
    rel = spark.createDataFrame([(1, "t", 0.8, 4, 0), (2, "t", -0.4, 0, 2), (1, "u", 0.1, 0, 0), (2, "u", 0.9, 0, 0), (2, "v", 0.5, 1, 0)], "item_id long, tag string, score double, positive_evals int, negative_evals int")
    m = spark.createDataFrame([(2, 1)], "absorbed long, survivor long")
    assert {r.tag: round(r.score, 6) for r in fb.merged_relevance(rel, m).collect()} == {"t": 0.4, "u": 0.1, "v": 0.5}


def test_explicit_feedback_and_events(spark):
    tags = spark.createDataFrame([(1, "a"), (1, "b")], "item_id long, tag string")
    f = spark.createDataFrame([(1, True, {"a": 1.0, "x:y": 2.0, "zz": 3.0}, 1), (1, False, None, 2)], "item_id long, applicable boolean, tag_scores map<string,double>, seq long")
    assert sorted((r.tag, r.raw, r.weight) for r in fb.explicit_feedback(f, tags).collect()) == [("a", -0.5, 1.0), ("a", 1.0, 2.0), ("b", -0.5, 1.0), ("x:y", 2.0, 2.0)]
    v = spark.createDataFrame([(1, "r", 3, "quote", 1), (1, "r", 3, "NO", 2), (1, None, 0, "q", 3)], "item_id long, repo string, score int, found string, seq long")
    assert sorted((r.tag, round(r.raw, 3), r.seq) for r in fb.attribution_events(v, tags).collect()) == [("a", 0.333, 2), ("a", 1.0, 1), ("b", 0.333, 2), ("b", 1.0, 1), ("repo:r", 0.333, 2), ("repo:r", 1.0, 1)]


def test_survivor_order_and_merge(spark):
    items = spark.createDataFrame([(7, True, 1), (3, False, 9), (5, True, 1)], "id long, dedup_verified boolean, occurrence_count int")
    g = spark.createDataFrame([(1, [7, 3, 5])], "group_id long, ids array<long>")
    assert {(r.survivor, r.absorbed) for r in D.survivors(g, items).collect()} == {(5, 7), (5, 3)}


def test_group_validation(spark):
    g = [(1, 0, [1, 2], "t", 0.9, "r"), (1, 1, [2, 3], "t", 0.9, "r"), (1, 2, [3, 99], "t", 0.9, "r"), (1, 3, [3], "t", 0.9, "r"), (1, 4, [3, 4], " ", 0.9, "r"), (1, 5, [3, 4], "t", 1.5, "r"), (1, 6, [3, 4], "t", 0.5, "x" * 300), (1, 7, [5, 6], "t", 0.5, "r")]
    df = spark.createDataFrame(g, "batch long, pos long, ids array<long>, canonical_text string, confidence double, reason string")
    known = spark.range(1, 10).select("id")
    got = {r.pos: r.problem for r in D.validated(df, known, known.where("id < 5")).collect()}
    assert got == {0: None, 1: "reused", 2: "unknown", 3: "size", 4: "text", 5: "confidence", 6: None, 7: "verified"}


def test_batches_share_candidates(spark):
    g = spark.createDataFrame([(1, 40, [(10, 30)]), (2, 40, [(10, 30)]), (3, 40, [(11, 30)])], "source_id long, chars long, candidates array<struct<id:long,chars:long>>")
    assert {r.source_id: r.batch for r in D.batches(g, 120).collect()} == {1: 0, 2: 0, 3: 1}


def test_merge_tables(spark):
    m = spark.createDataFrame([(2, 1)], "absorbed long, survivor long")
    shown = spark.createDataFrame([("s", 2, 1, "q"), ("s", 1, 2, None)], "session_id string, item_id long, shown_at long, query_text string")
    assert [tuple(r) for r in D.merge_shown(shown, m).collect()] == [("s", 1, 1, "q")]
    log = spark.createDataFrame([(1, [2, 3, 1]), (2, [])], "id long, item_ids array<long>")
    assert {r.id: r.item_ids for r in D.merge_id_lists(log, m, "item_ids").collect()} == {1: [1, 3], 2: []}
    pre = "id long, prerequisites struct<os:array<string>,repos:array<string>,paths:array<string>,mcp_servers:array<string>,auto_pinned:boolean>"
    items = spark.createDataFrame([(1, (["a"], None, None, ["x", "y"], False)), (2, (["b"], None, None, ["y"], True)), (3, None)], pre)
    got = {r.id: (r.os, r.mcp_servers, r.auto_pinned) for r in D.merge_prerequisites(items, m).collect()}
    assert got[1] == (["a", "b"], ["y"], True)


def test_word_pairs_and_passes(spark):
    items = spark.createDataFrame([(1, "a b c d"), (2, "a b c x"), (3, "q")], "id long, text string")
    assert [(r.a, r.b, r.overlap) for r in D.word_pairs(items).collect()] == [(1, 2, 0.75)]
    n = iter([3, 1, 0, 5])
    assert D.bootstrap_mode(2)


def test_subset_support(spark):
    s = spark.createDataFrame([(1, ["frontend", "acme", "typescript"], 6), (1, ["frontend", "acme", "react"], 5), (1, ["frontend", "personal", "typescript"], 4)], "item_id long, tag_set array<string>, times_matched int")
    r = E.tag_subsets(s).first()
    assert (r.subset, r.support) == (["frontend"], 15)


def test_reduction_and_metrics(spark):
    g = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4]), (3, [4, 5, 6])], "pos long, ids array<long>")
    r = E.reduction(g).first()
    assert (r.n_groups, r.n_ids) == (2, 6)


LABELS = [(1, "relevant", [10], None), (2, "abstain", [], "tool"), (3, "useful", [], "tool"), (4, "useful", [], None), (5, "abstain", [], None), (6, "abstain", [], None), (7, "relevant", [], "tool"), (8, "useful", [], None)]
HITS = [(1, 0, 11, 1.9), (1, 1, 10, 0.8), (2, 0, 5, 0.3), (3, 0, 5, 0.4), (4, 0, 5, 0.39), (5, 0, 6, 0.29), (7, 0, 8, 0.7)]


def test_metrics_follow_the_thresholds(spark):
    """Useful from 0.40 on, abstain below 0.30, separation of 1 at most, a filtered query scores 0."""
    import statistics

    lab = spark.createDataFrame(LABELS, "query_id long, expect string, expected array<long>, type string")
    res = spark.createDataFrame(HITS, "query_id long, rank0 int, id long, score double")
    m = E.retrieval_metrics(res, lab).first()
    assert (m.p1, m.p3, m.n_labels) == (0.0, 1.0, 7)
    assert (m.useful, m.abstain) == (pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert m.score_std == pytest.approx(statistics.stdev([1.9, 0.3, 0.4, 0.39, 0.29, 0.0, 0.7, 0.0]))
    assert m.separation == pytest.approx(1.9 - 0.59 / 3)
    assert m.composite == pytest.approx(1 - (0.20 + 0.25 * 2 / 3 + 0.10 + 0.10 / 3))
    assert m.hook == pytest.approx(1 - (0.15 + 0.35 * 2 / 3 + 0.10 + 0.10 / 3)) and m.interactive == pytest.approx(1 - (0.30 + 0.10 * 2 / 3 + 0.10 + 0.25 / 3))
    b = {r.bucket: r for r in E.bucket_metrics(res, lab).collect()}
    assert set(b) == {"expect:relevant", "expect:useful", "expect:abstain", "type:prompt", "type:tool"}
    assert (b["type:tool"].useful, b["type:tool"].abstain, b["type:tool"].p1, b["type:tool"].n_labels) == (1.0, 0.0, 0.0, 2)
    assert (b["type:prompt"].useful, b["type:prompt"].abstain, b["type:prompt"].p3) == (0.0, 1.0, 1.0)


def test_yield_tiers(spark):
    rows = [("a", None, {"x": 0.9, "y": -0.1}), ("a", "", {"x": 0.3}), ("a", None, {"x": 0.0}), ("a", None, {"x": -0.1}), ("a", None, {"x": -0.2}), ("a", None, {}), ("a", None, None), ("b", "applied", {"x": -1.0}), ("b", "unknown", {"x": 1.0}), ("b", "negative", None)]
    got = {r.k: tuple(r)[1:] for r in E.yield_tiers(spark.createDataFrame(rows, "k string, relevance string, tag_scores map<string, double>"), ["k"]).collect()}
    assert got == {"a": (7, 1, 1, 4, 1, 0.2857), "b": (3, 1, 0, 1, 1, 0.3333)}


def test_trajectory_summary(spark):
    rows = [(1, i, x) for i, x in enumerate([5, 3, 1, 1])] + [(2, i, x) for i, x in enumerate([2, 2, 2, 2])] + [(3, i, x) for i, x in enumerate([1, None, 4, 6])]
    s = E.trajectory_summary(E.trajectory(spark.createDataFrame(rows, "query_id long, round int, rank int")), 4).first()
    assert (s.total, s.improved, s.top1_gain, s.top3_gain) == (3, 1, 0, 0) and s.avg_improvement == pytest.approx(-1 / 3)
    assert s.avg_convergence == pytest.approx((2 + 1 + 3) / 3) and s.composite == pytest.approx(5 / 3 - 1 / 3)


def test_sets_and_status(spark):
    items = spark.createDataFrame([(1, None, False), (2, 1, False)], "id long, status int, deprecated boolean")
    got = {r.id: (r.status, r.deprecated) for r in M.set_status(items, items.select("id"), M.REJECTED).collect()}
    assert got == {1: (2, True), 2: (3, True)}
    assert [r.id for r in M.uncurated(items).collect()] == [1]
    old = spark.createDataFrame([(1, "a")], "id long, text string")
    new = spark.createDataFrame([], "id long, text string, pinned boolean, level int")
    assert tuple(M.migrated(old, new, {"pinned": False, "level": 3}).first()) == (1, "a", False, 3)
    log = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(10)], "id long, k string")
    assert [r.id for r in M.log_page(log, 2, 0, F.col("k") == "a").collect()] == [9, 7]
    assert [r.id for r in M.log_page(log, 2, 0, F.col("k") == "a", limit_first=True).collect()] == [9]


def transcript(tmp_path):
    lines = [{"type": "summary"}, {"type": "ai-title", "aiTitle": "T"}, {"type": "user", "cwd": "/home/work/acme/x", "message": {"role": "user", "content": "please fix the failing index build"}}]
    lines += [{"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "looking at it"}, {"type": "tool_use"}, {"type": "text", "text": "now"}]}}, {"type": "user", "message": {"role": "user", "content": "<system-reminder>z</system-reminder>ok"}}]
    body = "\n".join(json.dumps(x) for x in lines) + "\nnot json\n"
    (tmp_path / "s1.jsonl").write_text(body)
    return str(tmp_path / "s1.jsonl")


def test_transcripts(spark, tmp_path):
    lines = X.read_lines(spark, transcript(tmp_path))
    assert [(r.line_no, r.role, r.text) for r in X.turns(lines).orderBy("line_no").collect()] == [(2, "user", "please fix the failing index build"), (3, "assistant", "looking at it now"), (4, "user", "ok")]
    m = X.metadata(lines).first()
    assert (m.cwd, m.title, m.repo, m.work_repo) == ("/home/work/acme/x", "T", "x", "acme")
    off = lines.where("line_no = 3").select("session", F.col("start").alias("offset"))
    assert [r.line_no for r in X.after_offset(lines, off).orderBy("line_no").collect()] == [3, 4, 5]
    assert "please fix" in X.before_offset(lines, off).first().context
    assert X.latest_narration(X.turns(lines)).first().narration == "looking at it now"
    shown = spark.createDataFrame([("s1.jsonl", 1, "fix failing index please")], "session string, query_id long, text string")
    b = X.best_turn(shown, X.turns(lines))
    assert b.first().turn == 2
    assert [r.turn for r in X.turn_window(b, X.turns(lines)).orderBy("turn").collect()] == [2, 3, 4]


def test_chunks_overlap_and_end(spark):
    t = spark.createDataFrame([("s", i, "user", "x" * 90) for i in range(20)], "session string, line_no long, role string, text string")
    rows = X.chunks(t, most=500, overlap=0.25).orderBy("chunk").collect()
    assert rows[0].first_line == 0 and rows[-1].last_line == 19
    assert all(a.last_line + 1 >= b.first_line > a.first_line and len(a.text) <= 500 for a, b in zip(rows, rows[1:], strict=False))


def test_parsers(spark):
    t = 'noise [1] ```json\n[{"text": "a ] \\" b", "n": 1}] tail'
    assert files.first_json_array(t) == [{"text": 'a ] " b', "n": 1}] and files.first_json_array("none") is None and files.first_json_array(None) is None
    df = spark.createDataFrame([(t,), ("x {\"k\": 2} y",), (None,)], "v string")
    assert [r.items[0].text if r.items else None for r in files.parsed_arrays(df, "v", "struct<text:string>").collect()] == ['a ] " b', None, None]
    assert df.where("v like 'x%'").transform(lambda d: files.parsed_objects(d, "v", "struct<k:int>")).first().object.k == 2


def test_files_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(1, [3.0, 4.0])], "id long, embedding array<float>")
    files.write_index(v, f"file://{tmp_path}/ix")
    assert files.read_index(spark, f"file://{tmp_path}/ix").first().norm == 5.0 and files.read_index(spark, f"file://{tmp_path}/none") is None
    (tmp_path / "s.json").write_text(json.dumps({"items": [{"text": "a", "category": "x"}, {"text": "b", "category": "y/z"}, {"text": "c"}]}))
    assert [r.category for r in files.import_state(spark, f"file://{tmp_path}/s.json").collect()] == ["general/x", "y/z", "general/general"]
    (tmp_path / "s.md").write_text("# t\n- one\n  - two\ntext\n")
    assert [r.text for r in files.import_markdown(spark, f"file://{tmp_path}/s.md").collect()] == ["one", "two"]


# --- streams against batch --------------------------------------------------------------------------
def run_stream(spark, df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/ck_{name}").start()
    try:
        for _ in range(200):  # until all input has gone through
            time.sleep(0.2)
            if q.exception() or q.lastProgress and q.lastProgress["numInputRows"] == 0 and not q.status["isTriggerActive"]:
                break
        assert q.exception() is None
        return spark.table(name).collect()
    finally:
        q.stop()


def test_first_showings_on_a_stream(spark, tmp_path):
    schema = "session_id string, item_id bigint, at timestamp"
    for n in range(2):
        spark.sql(f"select * from values ('a', 1L, timestamp'2024-01-01 0{n}:00:00'), ('a', {n + 2}L, timestamp'2024-01-01 0{n}:00:00'), ('b', 1L, timestamp'2024-01-01 0{n}:30:00') as t(session_id, item_id, at)").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/shown")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/shown")
    got = run_stream(spark, Z.first_shown(stream, "at"), tmp_path, "first", "append")
    assert sorted((r.session_id, r.item_id) for r in got) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_queue_and_coverage(spark):
    r = spark.createDataFrame([("a", "p1", 1), ("b", "p2", 2), ("a", "p3", 3)], "session string, path string, seq long")
    assert [(x.session, x.path) for x in Z.coalesced_queue(r).collect()] == [("a", "p3"), ("b", "p2")]
    s = spark.createDataFrame([("a", 20_000), ("b", 5_000), ("c", 20_000)], "session string, bytes long")
    o = spark.createDataFrame([("a", 19_000), ("c", 3_000)], "session string, offset long")
    assert [(x.session, x.from_offset) for x in Z.needs_work(s, o).collect()] == [("c", 3000)]
