"""Passages of long items are found wherever they start in the item."""

import random

import numpy as np
import pytest

from lodestone.llm import decontamination as C


def texts(seed):
    r = random.Random(seed)
    some = lambda n: C.normal("".join(r.choice("abcdefghijklmnop ") for _ in range(2 * n)))[:n].strip().ljust(n, "z")
    return r, some


@pytest.mark.parametrize("length", [74, 80, 95])
def test_verbatim_passages_at_every_offset(length):
    _, some = texts(length)
    item = some(300)
    w = C.Windows([(1, item)])
    missed = [a for a in range(300 - length + 1) if not w.find(C.codes(some(90).replace("z", "q") + item[a : a + length] + some(90)))]
    assert not missed


def least_edits(p, t):
    row = np.zeros(len(t) + 1, int)
    for i, a in enumerate(p):
        new = np.minimum(row[:-1] + (t != a), row[1:] + 1)
        new = np.r_[i + 1, new]
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return row.min()


def test_edited_passages_equal_brute_force_over_all_windows():
    r, some = texts(3)
    found = 0
    for _ in range(40):
        item = some(130)
        a, n = r.randrange(45), r.randint(76, 86)
        q = list(item[a : a + n])
        for _ in range(r.randint(0, 9)):
            j = r.randrange(len(q))
            r.choice([lambda: q.__setitem__(j, "x"), lambda: q.__delitem__(j), lambda: q.insert(j, "y")])()  # noqa: B023
        t = C.codes(some(60) + "".join(q) + some(60))
        w = C.Windows([(1, item)])
        best = min(least_edits(C.codes(item[s : s + 80]), t) for s in range(len(item) - 79))
        got = w.find(t)
        assert bool(got) == (best <= 6) and (not got or min(x[3] for x in got) == best)
        found += bool(got)
    assert 5 < found < 40


def test_passages_stay_in_their_document(spark):
    _, some = texts(7)
    item = some(200)
    rows = [(1, some(150)), (2, item[60:138]), (3, some(150)), (4, some(40) + item[:90] + some(60) + item[100:190])]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.start) for r in C.contaminated(d, b).collect())
    assert [i for i, _ in got] == [2, 4, 4] and got[0][1] == 0
