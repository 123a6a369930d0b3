"""What the set join writes between its steps."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import set_join


def test_written_sets_hold_lowest_tokens_alone(spark, monkeypatch):
    r = random.Random(3)
    texts = [[f"w{r.randrange(5000)}" for _ in range(400)] for _ in range(12)]
    rows = []
    for t in texts[:2]:  # every token of these groups is frequent, so prefixes come from whole sets
        for _ in range(6):
            c = list(t)
            c[r.randrange(400)] = "other"
            rows.append((len(rows), " ".join(c)))
    rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts[2:])]
    sets = {i: set(set_join.shingles(t).tolist()) for i, t in rows}
    held, write = {}, set_join.written

    def seen(df, name="t"):
        out = write(df, name)
        if name == "sets":
            held.update({x.doc_id: x.n // 8 for x in out.select("doc_id", F.length("tokens").alias("n")).collect()})
        return out

    monkeypatch.setattr(set_join, "written", seen)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in set_join.set_components(d, least_frequent=3).collect()}
    linked = {i: {j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])} for i in sets}
    distinct = {i: {frozenset(sets[j]) for j in js} - {frozenset(sets[i])} for i, js in linked.items()}
    assert got == {i: (len(sets[i]), min([i, *linked[i]]), len(distinct[i])) for i in sets}
    assert sum(held.values()) < 0.4 * sum(map(len, sets.values()))


def test_parts_meet_whenever_sets_reach_the_threshold():
    r = np.random.default_rng(4)
    tokens = lambda n: r.integers(0, 1 << 64, n, dtype=np.uint64)
    met = 0
    for pct in (85, 80, 50):
        for _ in range(1500):
            a = np.unique(tokens(int(r.integers(1, 300))))
            b = np.unique(np.concatenate([r.permutation(a)[int(r.integers(0, len(a) * (100 - pct) // 100 + 2)) :], tokens(int(r.integers(0, len(a) * (100 - pct) // 100 + 2)))]))
            both = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and 100 * both >= pct * (len(a) + len(b) - both):
                met += 1
                assert len(np.intersect1d(set_join.parts(a, pct), set_join.parts(b, pct)))
    assert met > 1000


def test_common_tokens_do_not_make_one_component_of_all_texts(spark, monkeypatch):
    r = random.Random(5)
    pool = [" ".join(f"s{i}x{k}" for k in range(8)) for i in range(2000)]
    rows = [(i, " ".join(r.sample(pool, 20))) for i in range(2000)]
    rows += [(3000 + i, rows[i][1] + " more") for i in range(20)]
    placed, write = [], set_join.written

    def seen(df, name="t"):
        out = write(df, name)
        if name == "placed":
            placed.append(out.count())
        return out

    monkeypatch.setattr(set_join, "written", seen)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in set_join.one_of_each(d, small=8).collect()}
    assert kept == set(range(2000))
    assert 40 <= placed[0] < 400  # a token is in 20 texts here; by single tokens all are candidates
