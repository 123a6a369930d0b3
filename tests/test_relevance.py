"""The clamped average as a composition of clamped lines, against the fold in order."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import feedback as fb

SCHEMA = "item_id long, tag string, raw double, weight double, seq long"


def folded(events, alpha, limit):
    out = {}
    for item, tag, raw, weight, seq in sorted(events, key=lambda e: e[4]):
        s, pos, neg, _ = out.get((item, tag), (0.0, 0, 0, None))
        s = max(-limit, min(limit, (1 - alpha) * s + alpha * raw * weight))
        out[item, tag] = s, pos + (raw > 0), neg + (raw < 0), seq
    return out


def drawn(seed, n, spread):
    """A third of the events are those of one pair; seq is sparse and comes in any order."""
    r = random.Random(seed)
    seqs = r.sample(range(-spread, spread), n)
    return [(*((1, "hot") if r.random() < 0.34 else (r.randint(1, 9), r.choice("ab"))), r.choice([-1.0, 0.0, 0.4, 1.0, 9.0, -40.0]), r.choice([1.0, 2.0]), s) for s in seqs]


@pytest.mark.parametrize(("alpha", "limit", "width"), [(0.3, 3.0, 4), (0.9, 0.5, 3), (1.0, 3.0, 7), (0.3, 3.0, 4096), (0.05, 1e300, 5)])
def test_composition_equals_the_ordered_fold(spark, alpha, limit, width):
    events = drawn(width, 900, 3000)
    got = fb.relevance(spark.createDataFrame(events, SCHEMA).repartition(7), alpha, limit, width).collect()
    want = folded(events, alpha, limit)
    assert {(r.item_id, r.tag): (r.positive_evals, r.negative_evals, r.last_seq) for r in got} == {k: v[1:] for k, v in want.items()}
    assert all(r.score == pytest.approx(want[r.item_id, r.tag][0], abs=1e-9) for r in got) and len(got) == len(want)


def test_a_hot_pair_is_many_bounded_groups(spark):
    events = spark.range(200_000).select(F.lit(1).cast("long").alias("item_id"), F.lit("hot").alias("tag"), ((F.col("id") % 7) / 2.0 - 1).alias("raw"), F.lit(1.0).alias("weight"), F.col("id").alias("seq"))
    plan = fb.relevance(events, width=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 3 and "Window" not in plan
    want = folded([(1, "hot", (i % 7) / 2.0 - 1, 1.0, i) for i in range(200_000)], 0.3, 3.0)[1, "hot"]
    got = fb.relevance(events, width=1000).first()
    assert (got.positive_evals, got.negative_evals, got.last_seq) == want[1:] and got.score == pytest.approx(want[0], abs=1e-12)


def test_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fb.relevance(none).count() == 0 and fb.relevance_bounded(none).count() == 0
