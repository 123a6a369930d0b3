"""Joins and scans over pairs of vectors against brute force."""

import numpy as np
import pytest

from lodestone.operators import metric_join as M
from lodestone.plans import item_queries as IQ
from lodestone.plans import report_queries as RQ


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    """120 vectors, of which only three are questions; the nearest pair is not one of theirs."""
    d = str(tmp_path_factory.mktemp("space"))
    e = np.random.default_rng(5).normal(size=(120, 8)).astype(np.float32)
    e[80] = e[70] * 2
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(e)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, "q") for i in (1, 2, 3)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    u = e.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True) + 1e-10
    return d, np.round(u @ u.T, 9)


def test_summary_and_top_pairs_cover_the_upper_triangle(spark, space):
    d, s = space
    upper = s[np.triu_indices(len(s), 1)]
    r = RQ.QUERIES["a28_similarity_summary"](spark, d).first()
    assert (r.mean_sim, r.max_sim, r.n_above) == (pytest.approx(upper.mean(), abs=1e-6), 1.0, (upper >= 0.3).sum())
    want = sorted((-s[a, b], a, b) for a in range(len(s)) for b in range(a + 1, len(s)))[:10]
    got = [(r.a, r.b, r.similarity) for r in RQ.QUERIES["a28_top_pairs"](spark, d).collect()]
    assert got[0][:2] == (70, 80) and got == [(a, b, pytest.approx(-x, abs=1e-6)) for x, a, b in want]


def test_parts_do_not_depend_on_blocks(spark, space):
    d, s = space
    v = spark.read.parquet(f"{d}/embeddings.parquet").withColumnRenamed("vec_id", "id").repartition(3)
    parts = M.pair_parts(v, 0.3, k=4, block=17, per_cell=9).collect()
    assert sum(p.n or 0 for p in parts) == 120 * 119 // 2 and sum(p.n_above for p in parts) == (s[np.triu_indices(120, 1)] >= 0.3).sum()
    assert sorted((-x.similarity, x.a, x.b) for p in parts for x in p.best)[:4] == sorted((-s[a, b], a, b) for a in range(120) for b in range(a + 1, 120))[:4]
    assert not M.pair_parts(v.limit(0), 0.3).collect()


def test_attribution_has_every_pair_and_ranks_none(spark, space):
    d, s = space
    got = IQ.QUERIES["p17_p18_attribution"](spark, d)
    assert {(r.query_id, r.id): r.sim for r in got.collect()} == {(q, i): pytest.approx((s[q, i] + 1) / 2, abs=1e-6) for q in (1, 2, 3) for i in range(120)}
    assert "Window" not in got._jdf.queryExecution().toString()


def cloud(copies=200):
    """900 vectors around 12 centres: 200 copies of one, zeros, one that is short, a multiple and rows without a vector."""
    r = np.random.default_rng(0)
    e = (r.normal(size=(12, 8))[r.integers(0, 12, 900)] + 0.15 * r.normal(size=(900, 8))).astype(np.float32)
    e[100 : 100 + copies] = e[5]
    e[400:405], e[405], e[406] = 0, 1e-4 * e[6], 3 * e[7]
    u = e.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True) + 1e-10
    return e, np.arange(900) * 3 + 1, np.round(u @ u.T, 9)


@pytest.fixture(scope="module")
def crowd(spark):
    e, ids, s = cloud()
    rows = [(int(i), x.tolist()) for i, x in zip(ids, e, strict=True)]
    odd = [(90_000, None), (90_001, [float("nan")] * 8), (90_002, []), (90_003, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    return spark.createDataFrame(rows + odd, "id long, embedding array<float>").repartition(5), ids, s


def nearest_by_definition(s, ids, left, right, least, k):
    out = set()
    for i in left:
        near = sorted((-s[i, j], ids[j]) for j in right if j != i and s[i, j] >= least)[:k]
        out |= {(ids[i], b, n) for n, (_, b) in enumerate(near)}
    return out


@pytest.mark.parametrize(("least", "k", "block", "per_cell"), [(0.5, 8, 2000, 500), (0.9, 3, 50, 20), (-1.0, 2, 100, 40)])
def test_best_pairs_equal_brute_force(crowd, least, k, block, per_cell):
    v, ids, s = crowd
    got = {(x.source_id, x.target_id, x.rank0) for x in M.best_pairs(v, v, least, k, block, per_cell).collect()}
    assert got == nearest_by_definition(s, ids, range(900), range(900), least, k)


def test_best_pairs_of_two_sets_and_of_none(crowd):
    v, ids, s = crowd
    left, right = v.where("(id - 1) / 3 % 3 = 0"), v.where("(id - 1) / 3 % 3 <> 0")
    got = {(x.source_id, x.target_id, x.rank0) for x in M.best_pairs(left, right, 0.4, 4, 70, 25).collect()}
    assert got == nearest_by_definition(s, ids, range(0, 900, 3), [i for i in range(900) if i % 3], 0.4, 4)
    assert M.best_pairs(v.limit(0), v).count() == 0 and M.best_pairs(v, v.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.95, 1.5])
def test_parts_with_copies_equal_brute_force(crowd, least):
    v, ids, s = crowd
    parts = M.pair_parts(v, least, 7, 90, 40).collect()
    upper = np.triu_indices(900, 1)
    assert sum(p.n or 0 for p in parts) == len(upper[0]) and sum(p.total or 0 for p in parts) == pytest.approx(s[upper].sum(), abs=1e-4)
    assert max(p.top for p in parts if p.top is not None) == s[upper].max() and sum(p.n_above for p in parts) == (s[upper] >= least).sum()
    want = sorted((-x, ids[a], ids[b]) for x, a, b in zip(s[upper], *upper, strict=True) if x >= least)[:7]
    assert sorted((-x.similarity, x.a, x.b) for p in parts for x in p.best)[:7] == want


def test_cells_out_of_reach_are_skipped(crowd):
    v, ids, s = crowd
    members = M.stored(M.folded(v, 9))
    n = members.count()
    assert n == 900 - 200 - 4  # copies and zeros are folded, rows without an id or a vector are left out
    cells = M.measured(members, M.choose_pivots(members, n, 30, 1024), 9)
    assert M.visit_counts(members, cells, 0.8).sum() < n * (cells.size > 0).sum() / 4


def test_the_plan_does_not_grow_with_the_rows(spark, crowd):
    v, _, _ = crowd
    size = lambda d: [d._jdf.queryExecution().optimizedPlan().toString().count(x) for x in ("Join", "Union", "CoGroup", "Window")]
    assert size(M.best_pairs(v.limit(40), v.limit(40), block=5, per_cell=5)) == size(M.best_pairs(v, v, block=5, per_cell=5))


def test_vectors_are_shipped_by_blocks_not_by_cells(spark):
    """Random vectors skip nothing: each goes to every block of members, however many cells there are."""
    e = np.random.default_rng(2).normal(size=(600, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "id long, embedding array<float>").repartition(2)
    members = M.stored(M.folded(v, 3))
    cells = M.measured(members, M.choose_pivots(members, 600, 10, 1024), 3)
    visitors, _ = M._grid(members, members, cells, -1.0, 200, True)
    assert visitors.selectExpr("sum(length(reps) / 8) AS n").first().n <= 600 * 4


def test_best_of_a_session_is_found_in_blocks(spark, crowd):
    """Most rows lie in one session, which is dealt to many blocks; ties go to the smaller id."""
    from lodestone.operators import retrieval as R

    v, ids, s = crowd
    side = v.where("id < 90000").selectExpr("id", "(id - 1) / 3 AS n", "embedding", "CASE WHEN id % 10 < 8 THEN 'a' ELSE 'b' END AS session_id")
    left, right = side.where("n % 3 = 0").withColumnRenamed("id", "label_id"), side.where("n % 3 <> 0")
    got = {(x.label_id, round(x.s, 9), x.id) for x in M.best_in_groups(left, right, "session_id", ["label_id"], block=1000).collect()}
    home = ["a" if i % 10 < 8 else "b" for i in ids.tolist()]
    best = {i: min((-s[i, j], int(ids[j])) for j in range(900) if j % 3 and home[j] == home[i]) for i in range(0, 900, 3)}
    assert got == {(int(ids[i]), -x, j) for i, (x, j) in best.items()}
    many = M.best_in_groups(left, right, "session_id", ["label_id"], block=40).groupBy("label_id").agg({"s": "max"}).collect()
    assert {x[0]: round(x[1], 9) for x in many} == {int(ids[i]): -x for i, (x, _) in best.items()}
    labels = left.selectExpr("label_id", "'good' AS kind", "session_id", "embedding")
    assert "CoGroups" in R.best_in_session(labels, right)._jdf.queryExecution().optimizedPlan().toString()
