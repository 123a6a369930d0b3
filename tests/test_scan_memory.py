"""What a task of the scans holds does not grow with its Arrow batches."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lodestone.operators import postings, search


def peak_mb(run) -> float:
    tracemalloc.start()
    run()
    mb = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return mb


def items(n, words):
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([[f"w{j}" for j in range(words)]] * n)], names=["id", "tokens"])


def test_matches_of_frequent_words_are_counted_in_parts():
    n_q, words = 200, 40
    terms = sorted(f"w{j}" for j in range(words))
    starts, q = np.arange(words + 1) * n_q, np.tile(np.arange(n_q), words)
    shared = SimpleNamespace(value=(np.arange(n_q), terms, starts, q, np.ones(len(q))))
    scan, batch = search._bm25_scan(shared, 3, 1.5, 0.75, float(words)), items(3000, words)
    found = []
    assert peak_mb(lambda: found.extend(scan([batch]))) < 60
    got = pa.Table.from_batches(found)
    assert got.num_rows == n_q * 3 and set(got["id"].to_pylist()) == {0, 1, 2} and np.allclose(got["score"].to_numpy(), words)


def test_postings_of_a_batch_are_counted_in_parts():
    b = items(20_000, 40)
    b = pa.RecordBatch.from_arrays([b.column(0), pa.array([40] * 20_000, pa.int32()), b.column(1)], names=["id", "len", "tokens"])
    rows = []
    assert peak_mb(lambda: rows.extend(x.num_rows for x in postings._terms(iter([b])))) < 20
    assert sum(rows) == 20_000 * 40
