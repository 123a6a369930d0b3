"""The greedy count of groups, against its definition."""

import random

from lodestone.operators import evaluation as E


def test_reduction_streams_groups_in_order(spark):
    r = random.Random(6)
    rows = [(i, sorted(r.sample(range(900), r.randint(1, 4)))) for i in range(1200)]
    seen, kept = set(), 0
    for _, ids in rows:
        if len(set(ids) - seen) >= 2:
            seen, kept = seen | set(ids), kept + 1
    got = E.reduction(spark.createDataFrame(r.sample(rows, len(rows)), "pos long, ids array<long>").repartition(4))
    assert tuple(got.first()) == (kept, len(seen), len(seen) - kept)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(E.reduction(spark.createDataFrame([], "pos long, ids array<long>")).first()) == (0, 0, 0)
