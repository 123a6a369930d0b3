"""Dedup passes against passes that join everything anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import metric_join as M
from lodestone.operators import passes as P


def chains(spark, n=60):
    """Chains of vectors that grow closer as they merge, copies and loners."""
    r = np.random.default_rng(3)
    base = r.normal(size=(8, 6))
    e = np.concatenate([base[i % 8] + 0.35 * r.normal(size=6) for i in range(n)]).reshape(n, 6).astype(np.float32)
    e[10] = e[2]
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)] + [(999, None)], "id long, embedding array<float>")


def from_scratch(vectors, least, k, most):
    now, log, out = vectors.where("embedding is not null"), [], []
    for _ in range(most):
        lists = M.best_pairs(now, now, least, k).select("source_id", "target_id", "similarity")
        merges = P.mutual_nearest(lists).persist()
        got = sorted((r.survivor, r.absorbed) for r in merges.collect())
        out.append(len(got))
        if not got:
            break
        log.append(got)
        new = P.summed(merges, now)
        now = now.join(merges.select(F.col("absorbed").alias("id")), "id", "left_anti").join(new.select("id"), "id", "left_anti").unionByName(new)
        now = M.stored(now)
    return log, out, sorted(r.id for r in now.collect())


def test_passes_equal_those_from_scratch_and_join_less(spark):
    v = chains(spark)
    left, log, done = P.dedup_passes(v, P.mutual_nearest, P.summed, 0.6, 3, most=4)
    want, sizes, ids = from_scratch(v, 0.6, 3, 4)
    assert [sorted((r.survivor, r.absorbed) for r in log.where(F.col("pass") == i + 1).collect()) for i in range(len(want))] == want
    assert [d.absorbed for d in done] == sizes and sorted(r.id for r in left.collect()) == ids
    assert done[0].joined == 60 and all(a.joined > b.joined for a, b in zip(done, done[1:]))


def test_passes_stop(spark):
    v = chains(spark)
    _, log, done = P.dedup_passes(v, P.mutual_nearest, P.summed, 0.6, 3, scan_only=True)
    left, _, one = P.dedup_passes(v, P.mutual_nearest, P.summed, 0.6, 3, single=True)
    assert len(done) == len(one) == 1 and log.count() == done[0].absorbed > 0 and left.count() == 60 - one[0].absorbed
    none = lambda lists: P.mutual_nearest(lists).where("false")
    left, log, done = P.dedup_passes(v, none, P.summed, 0.6, 3)
    assert [d.absorbed for d in done] == [0] and left.count() == 60 and log.count() == 0
