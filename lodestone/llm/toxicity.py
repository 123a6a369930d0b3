"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Labelled documents are the examples; all of them are in the index. Terms are whole lower-case words
and the prefixes of words (4 and 6 letters, so that compounds of one stem meet). Every term that two
examples hold is in the vocabulary. Its weight in a text is sublinear TF times IDF times relevance
frequency, log2(2 + a / max(1, c)) for a toxic and c other examples that hold it: a factor of 1 for
filler, which grows smoothly for terms that toxic examples favour. Vectors have length 1.

The index is a list of examples by term. Lists of terms that more than one in eight examples hold
carry the largest weight within each block of examples. For a query the short lists are added up
first; a block's bound is its largest sum so far plus query weight times block maximum over the long
lists. Blocks are scored exactly in descending order of bound, and the search ends when the next
bound cannot reach the k-th best: the result is the exact top k. Votes are weighted by cosine, and a
table fitted on the examples by leaving each one out maps the vote to the observed rate of toxic
labels. The neighbours' doc_ids, cosines and labels are the evidence.

The number of examples is bounded by ``max_examples`` (by hash of doc_id over all held-in labels)
and what the driver holds of one by ``max_terms`` (the most frequent first), so the model and what
each task loads stay the same at any input size; every document is scored, over all its words.

Defined cases: a null or empty text, or one without a term of the vocabulary, has no neighbour and
gets the rate of the examples without neighbours; documents without label are scored alike; null
labels are ignored; a doc_id with several labels is toxic if any label says so; of rows that repeat
a labelled doc_id the one whose text has the least hash is the example; an empty table gives an
empty result; without any example the score is 0; a null doc_id is scored with held_out false;
other columns are ignored. Ties of cosine go to the example that comes first in the index.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, documents_only, rows, tidy

_LETTERS = re.compile(r"[^\W\d_]+")
BLOCK = 64
BATCH = 16  # texts whose blocks are scored together


def word_terms(w: str) -> list[str]:
    """Terms of a lower-case word."""
    return ["=" + w, *(w[:k] for k in (4, 6) if len(w) > k)]


def terms(text: str | None) -> tuple[list[str], list[int]]:
    """Distinct terms of a whole text and their counts."""
    out: Counter = Counter()
    for w, n in Counter(_LETTERS.findall((text or "").lower())).items():
        for t in word_terms(w):
            out[t] += n
    return list(out), list(out.values())


Example = tuple[int, "list[str] | pa.Array", "list[int] | np.ndarray", int]  # doc_id, terms, counts, label


class Neighbours:
    """Block-max inverted index over labelled examples."""

    def __init__(self, examples: list[Example], k: int = 15, least_df: int = 2, long_share: float = 1 / 8):
        self.k = k
        self.n = n = len(examples)
        labels = np.array([y for *_, y in examples], np.int64)
        self.prior = float(labels.mean()) if n else 0.0
        flat = pa.concat_arrays([pa.array([], pa.string()), *(t if isinstance(t, pa.Array) else pa.array(t, pa.string()) for _, t, _, _ in examples)]).dictionary_encode()
        at, sizes = flat.indices.to_numpy(), [len(c) for _, _, c, _ in examples]
        owner = np.repeat(np.arange(n), sizes)
        df = np.bincount(at, minlength=len(flat.dictionary))
        toxic = np.bincount(at, weights=labels[owner], minlength=len(df))
        chosen = df >= least_df
        self.vocabulary = flat.dictionary.filter(pa.array(chosen)).to_pylist()
        self.weight = (np.log((1 + n) / (1 + df)) * np.log2(2 + toxic / np.maximum(1, df - toxic)))[chosen]
        self._place, self._memo = {w: i for i, w in enumerate(self.vocabulary)}, {}
        place = np.where(chosen, np.cumsum(chosen) - 1, -1)[at]
        held = []
        for p, (_, _, c, _) in zip(np.split(place, np.cumsum(sizes)[:-1]), examples, strict=True) if n else ():
            held.append(self._unit(p[p >= 0], np.asarray(c, np.int64)[p >= 0]))
        # examples that share their heaviest term stand together, so that blocks differ in their maxima
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in held]
        order = sorted(range(n), key=lambda i: (heaviest[i], i))
        held = [held[i] for i in order]
        self.labels = labels[order].astype(np.int8)
        self.doc_ids = np.array([examples[i][0] for i in order], np.int64)
        self.n_blocks = -(-n // BLOCK)
        sizes = [len(t) for t, _ in held]
        term = np.concatenate([t for t, _ in held]) if n else np.zeros(0, np.int64)
        value = np.concatenate([w for _, w in held]) if n else np.zeros(0)
        example = np.repeat(np.arange(n, dtype=np.int32), sizes)
        by_term = np.argsort(term, kind="stable")
        self.starts = np.searchsorted(term[by_term], np.arange(len(self.vocabulary) + 1))
        self.lists, self.values = example[by_term], value[by_term].astype(np.float32)
        long = np.flatnonzero(np.diff(self.starts) > long_share * n)
        self.long = np.full(len(self.vocabulary), -1, np.int32)
        self.long[long] = np.arange(len(long))
        rows_ = np.zeros((len(long), self.n_blocks * BLOCK), np.float32)
        for r, t in enumerate(long):
            lo, hi = self.starts[t], self.starts[t + 1]
            rows_[r, self.lists[lo:hi]] = self.values[lo:hi]
        rows_ = rows_.reshape(len(long), self.n_blocks, BLOCK)
        self.bounds = rows_.max(2)
        self.rows = np.ascontiguousarray(rows_.transpose(1, 0, 2))  # block, long list, example
        self.scored = 0  # blocks scored so far
        self._calibrate(held)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_place", "_memo")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._place, self._memo = {w: i for i, w in enumerate(self.vocabulary)}, {}

    def _unit(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[at]
        norm = np.sqrt((w * w).sum())
        return (at, w / norm) if norm > 0 else (at[:0], w[:0])

    def vector_of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The same from a whole text, with a bounded memo of words."""
        memo, place = self._memo, self._place
        if len(memo) > 150_000:
            memo.clear()
        counts = Counter(_LETTERS.findall((text or "").lower()))
        for w in itertools.filterfalse(memo.__contains__, counts):
            memo[w] = tuple(place[t] for t in word_terms(w) if t in place)
        known = [memo[w] for w in counts]
        sizes = list(map(len, known))
        ids = np.fromiter(itertools.chain.from_iterable(known), np.int64, sum(sizes))
        times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), sizes)
        distinct, at = np.unique(ids, return_inverse=True)
        return self._unit(distinct, np.bincount(at, weights=times, minlength=len(distinct)))

    def top(self, v: tuple[np.ndarray, np.ndarray], without: int = -1) -> list[tuple[float, int]]:
        """Exact k nearest examples by cosine, ties by example number."""
        cos, at = self.top_many([v], None if without < 0 else [without])[0]
        return list(zip(cos.tolist(), at.tolist(), strict=True))

    def top_many(self, vs: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(cosines, example numbers) of top() for several queries, whose blocks are scored together."""
        d, pad = len(vs), self.n_blocks * BLOCK
        if not self.n:
            return [(np.zeros(0), np.zeros(0, np.int64))] * d
        doc = np.repeat(np.arange(d), [len(t) for t, _ in vs])
        t, w = np.concatenate([t for t, _ in vs]), np.concatenate([w for _, w in vs])
        row = self.long[t]
        short = row < 0
        lo = self.starts[t[short]]
        size = self.starts[t[short] + 1] - lo
        entry = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        sums = np.bincount(self.lists[entry] + np.repeat(doc[short] * pad, size), weights=self.values[entry] * np.repeat(w[short], size), minlength=d * pad)
        if without is not None:
            sums[np.arange(d) * pad + without] = -2.0
        sums = sums.reshape(d, self.n_blocks, BLOCK)
        asked = np.zeros((d, len(self.bounds)), np.float32)
        asked[doc[~short], row[~short]] = w[~short]
        bound = sums.max(2) + asked @ self.bounds
        score = np.full((d, self.n_blocks, BLOCK), -1.0)
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :4], True, 1)
        least = np.zeros(d)
        for now in (first, ~first):
            now &= bound + 1e-6 >= least[:, None]
            self.scored += int(now.sum())
            for b in np.flatnonzero(now.any(0)).tolist():
                q = np.flatnonzero(now[:, b])
                score[q, b] = sums[q, b] + asked[q] @ self.rows[b]
            least = np.maximum(0.0, np.partition(score.reshape(d, pad), pad - min(self.k, pad), axis=1)[:, pad - min(self.k, pad)])
        out = []
        for s, x in zip(score.reshape(d, pad), least.tolist(), strict=True):
            at = np.flatnonzero((s >= x) & (s > 0))
            at = at[np.lexsort((at, -s[at]))[: self.k]]
            out.append((s[at], at))
        return out

    def vote(self, cos: np.ndarray, at: np.ndarray) -> float:
        return float(((cos * self.labels[at]).sum() + self.prior * 0.1) / (cos.sum() + 0.1))

    def _calibrate(self, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Isotonic fit of label on leave-one-out vote, and the rate of examples without neighbours."""
        self.cut, self.rate, self.bare = [0.0], [self.prior], self.prior
        pairs, bare = [], []
        for i in range(0, len(held), BATCH):
            without = list(range(i, min(i + BATCH, len(held))))
            for n, (cos, at) in zip(without, self.top_many(held[i : i + BATCH], without), strict=True):
                if len(at):
                    pairs.append((self.vote(cos, at), int(self.labels[n])))
                else:
                    bare.append(int(self.labels[n]))
        self.bare = (sum(bare) + self.prior) / (len(bare) + 1)
        pools = isotonic(pairs)
        if pools:
            self.cut = [x for x, _, _ in pools]
            self.rate = [(y + self.prior) / (m + 1) for _, y, m in pools]
        self.scored = 0

    def score_many(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, cosines and example numbers of each text's neighbours."""
        out = []
        for i in range(0, len(texts), BATCH):
            for cos, at in self.top_many([self.vector_of(t) for t in texts[i : i + BATCH]]):
                if not len(at):
                    out.append((self.bare, cos, at))
                    continue
                vote = self.vote(cos, at)
                rate = float(np.interp(vote, self.cut, self.rate))
                # the vote itself orders documents within a pool
                out.append((min(1.0, max(0.0, 0.95 * rate + 0.05 * vote)), cos, at))
        return out

    def score(self, text: str | None) -> float:
        return self.score_many([text])[0][0]


def isotonic(pairs: list[tuple[float, int]]) -> list[tuple[float, float, int]]:
    """(mean vote, sum of labels, size) of the pools of the least-squares monotone fit of label on vote."""
    pools: list[list[float]] = []
    for x, y in sorted(pairs):
        pools.append([x, y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            x1, y1, n1 = pools.pop()
            pools[-1] = [pools[-1][0] + x1, pools[-1][1] + y1, pools[-1][2] + n1]
    return [(x / m, y, int(m)) for x, y, m in pools]


def held_out(doc_id):
    """crc32 of the decimal id, remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, label: str, max_examples: int, max_terms: int) -> list[Example]:
    """At most max_examples held-in examples, the smallest by hash of doc_id, in that order.

    The sample is drawn on ids alone; then only its texts are read.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col(label).cast("int").alias("y")).where("y is not null and l_id is not null")
    y = y.groupBy("l_id").agg(F.max("y").alias("y")).where(~held_out("l_id"))
    drawn = y.withColumn("h", F.xxhash64(F.lit(7), "l_id")).orderBy("h", "l_id").limit(max_examples)
    ids = F.broadcast(drawn)  # max_examples rows at most
    text = F.col("text").cast("string")
    got = docs.select("doc_id", text.alias("text")).join(ids, F.col("doc_id") == F.col("l_id")).select("h", "l_id", "y", "text")

    def shrink(batches):
        schema = pa.schema([("h", pa.int64()), ("l_id", pa.int64()), ("y", pa.int32()), ("x", pa.int64()), ("t", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])

        def made():
            for h, d, yy, text in rows(batches, "h", "l_id", "y", "text"):
                most = sorted(zip(*terms(text), strict=True), key=lambda x: (-x[1], x[0]))[:max_terms]
                yield h, d, yy, xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 1, [t for t, _ in most], [n for _, n in most]

        yield from chunked(made(), schema, 200)

    shrunk = got.mapInArrow(shrink, "h long, l_id long, y int, x long, t array<string>, n array<long>")
    one = shrunk.groupBy("h", "l_id").agg(F.min_by(F.struct("y", "t", "n"), "x").alias("e")).select("h", "l_id", "e.*").toArrow()
    order = np.lexsort((one.column("l_id").to_numpy(), one.column("h").to_numpy()))
    one = one.take(pa.array(order)).combine_chunks()
    ids_, ys = one.column("l_id").to_pylist(), one.column("y").to_pylist()
    return [(i, t.values, n.values.to_numpy(), yy) for i, t, n, yy in zip(ids_, one.column("t"), one.column("n"), ys, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_examples: int = 2500, max_terms: int = 3000, **settings) -> Neighbours:
    """The index over held-in labelled rows, at most max_examples of them."""
    return Neighbours(examples(docs, labels, label, max_examples, max_terms), **settings)


_SCORED = "doc_id long, score double, neighbours array<struct<doc_id: long, cosine: double, label: int>>"


def score_documents(docs: DataFrame, model: Neighbours) -> DataFrame:
    """doc_id, score and neighbours (doc_id, cosine, label; nearest first) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    near = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("neighbours", pa.list_(near))])

    def run(batches):
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                got = m.score_many(part.column("text").to_pylist())
                at = np.concatenate([x for *_, x in got])
                flat = pa.StructArray.from_arrays([pa.array(m.doc_ids[at]), pa.array(np.concatenate([c for _, c, _ in got])), pa.array(m.labels[at].astype(np.int32))], fields=list(near))
                ends = np.concatenate([[0], np.cumsum([len(x) for *_, x in got])])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, *_ in got]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidy(run), _SCORED)


def without_toxic(docs: DataFrame, model: Neighbours, threshold: float = 0.5) -> DataFrame:
    """Rows of docs whose score is below the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        for text in texts:
            got = shared.value.score_many([None if pd.isna(t) else t for t in text])
            yield pd.Series([s < threshold for s, *_ in got], dtype=bool)

    clean = tidy(run)
    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(clean, "boolean")(F.col("text").cast("string")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, fit(docs, labels))
    near = F.col("neighbours")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), near["doc_id"].alias("neighbour_ids"), F.coalesce(F.get(near, F.lit(0))["cosine"], F.lit(0.0)).alias("best_cosine"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
