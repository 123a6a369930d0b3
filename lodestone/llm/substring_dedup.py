"""Substring dedup: repeated word windows found by backward search in FM-indexes of shards.

A window is ``k`` consecutive words. Its minimiser is the first least hash of the word ``m``-grams
in it; consecutive windows that share that very m-gram form a segment, so no segment holds a window
twice. Equal windows have equal minimisers, so all places of a window lie in segments of one
minimiser value, and shards by minimiser need no document to be searched in more than its own
shards.

1. Segments whose minimiser occurs once are dropped; equal segments are folded to their first
   place (all later ones repeat it from end to end).
2. Where different segments share a minimiser, their words are brought together in shards. A shard
   is an FM-index over word codes (wavelet matrix); all its segments are streamed through it by
   backward search, which gives matching statistics: for each word the length of the longest run
   that ends there and stands at an earlier place too. Runs of k words and more are reported.
3. Minimisers with more than ``most_segments`` different segments (a passage that very many
   documents hold, in different surroundings) go another exact way, as one of them would not fit a
   shard: their windows are reduced to least places by aggregation, which combines before the
   shuffle.
4. The runs found are gathered by row, and their words removed.

Place means (doc_id, hash of the text, number of the first word). Windows are judged on the input.

Defined cases: a null text has no words; a null doc_id comes first (doc_ids are above
-2**63 + 2**32); rows with equal doc_id are told apart by their texts, each loses what is repeated
in it alone, and rows that are equal in both are one row in several copies and come back alike;
texts of fewer than k words stay whole; an empty table gives an empty result; other columns stay as
they are, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, discard, documents_only, mix, rolling, rows, signed, word_hashes, words, written
from .fm_index import FMIndex

NO_ID = -(1 << 63)


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each window of width entries."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, low, step = np.arange(len(x)), x, 1

    def less(i: int, j: int, size: int):
        left = low[i : i + size] <= low[j : j + size]
        return np.where(left, at[i : i + size], at[j : j + size]), np.where(left, low[i : i + size], low[j : j + size])

    while step * 2 <= width:
        at, low = less(0, step, len(low) - step)
        step *= 2
    return less(0, width - step, n)[0] if step < width else at[:n]


_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 15)
        bases = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        for x in bases:
            x[0] = 1
        _powers, _inverses = (np.cumprod(x) for x in bases)
    return _powers[:n], _inverses[:n]


def segments(ws: list[str], k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, content hash, first word and number of windows of each segment of a text."""
    if len(ws) < k:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z
    h = word_hashes(ws)
    g = rolling(h, m)
    at = sliding_argmin(g, k - m + 1)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(start, len(at)))
    mv = g[at[start]]
    # polynomial hash of a run of words, from prefix sums modulo 2**64
    power, inverse = _grown(len(h))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h) * power)])
    content = mix((sums[start + n + k - 1] - sums[start]) * inverse[start] + n.astype(np.uint64))
    return mv, content, start, n


_SEG = "mv long, content long, doc long, at long, n int"


def _row(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two numbers that name a row: doc_id, and 31 bits of the text's hash in front of word numbers.

    Where doc_id is null, further 32 bits of the hash stand for it, in front of all doc_ids.
    """
    h = F.xxhash64(text)
    doc = F.when(doc_id.isNull(), F.lit(NO_ID) + F.shiftrightunsigned(h, 32)).otherwise(doc_id.cast("long"))
    return doc, F.shiftleft(h.bitwiseAND((1 << 31) - 1), 32)


def _segments_of(k: int, m: int):
    schema = pa.schema([("mv", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])

    def run(batches):
        held, size = [], 0

        def batch():
            cols = [np.concatenate([x[i] for x in held]) for i in range(len(schema))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for d, r, text in rows(batches, "doc", "row", "text"):
            mv, c, start, n = segments(words(text), k, m)
            if len(mv):
                held.append((signed(mv), signed(c), np.full(len(mv), d), r + start, n.astype(np.int32)))
                size += len(mv)
                if size >= 100_000:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    return run


def _contents(k: int):
    """Words of the asked segments of each text."""
    schema = pa.schema([("mv", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("words", pa.string())])

    def run(batches):
        def made():
            for text, asked in rows(batches, "text", "asked"):
                ws = words(text)
                for a in asked:
                    start = a["at"] & 0xFFFFFFFF
                    yield a["mv"], a["doc"], a["at"], " ".join(ws[start : start + a["n"] + k - 1])

        yield from chunked(made(), schema)

    return run


def repeated(doc: np.ndarray, at: np.ndarray, texts: list[list[str]], k: int) -> list[tuple[int, int, int]]:
    """(segment, first word, words) of the longest runs of k words or more that stand earlier in the shard."""
    codes: dict[str, int] = {}
    parts = [np.array([0, *(codes.setdefault(w, len(codes) + 1) for w in t)], np.int32) for t in texts]
    sizes = np.array([len(p) for p in parts])
    text = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), sizes)
    within = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - 1
    d, a = doc[owner], at[owner] + within
    same = np.lexsort((a, d))
    # equal places (copies of a row) get equal ranks
    new = np.concatenate([[False], (d[same][1:] != d[same][:-1]) | (a[same][1:] != a[same][:-1])])
    place = np.empty(len(text), np.int64)
    place[same] = np.cumsum(new)
    index = FMIndex(text, int(sizes.max()) - 1, place)
    ends = np.flatnonzero(within >= k - 1)
    out = []
    for i in range(0, len(ends), 1 << 16):
        e = ends[i : i + (1 << 16)]
        length = index.matching(text, e, within[e] + 1, place, k)
        # a run that goes on with the next word is reported there
        goes_on = np.concatenate([(e[1:] == e[:-1] + 1) & (length[1:] == length[:-1] + 1), [False]])
        hit = (length >= k) & ~goes_on
        e, length = e[hit], length[hit]
        out += list(zip(owner[e].tolist(), (within[e] - length + 1).tolist(), length.tolist(), strict=True))
    return out


_RANGE = "doc long, at long, n int"


def _search_shard(k: int):
    def run(table: pa.Table) -> pa.Table:
        doc, at = table.column("doc").to_numpy(), table.column("at").to_numpy()
        found = repeated(doc, at, [t.split(" ") for t in table.column("words").to_pylist()], k)
        return pa.table({"doc": pa.array([int(doc[s]) for s, _, _ in found], pa.int64()), "at": pa.array([int(at[s]) + w for s, w, _ in found], pa.int64()), "n": pa.array([n for *_, n in found], pa.int32())})

    return run


def _windows(k: int):
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for b in batches:
            cols = [[], [], [], []]
            for doc, at, text in zip(*(b.column(c).to_pylist() for c in ("doc", "at", "words")), strict=True):
                h = word_hashes(text.split(" "))
                a = rolling(h, k)
                cols[0].append(signed(a))
                cols[1].append(signed(rolling(h, k, 1)))
                cols[2].append(np.full(len(a), doc))
                cols[3].append(at + np.arange(len(a)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def repeated_runs(docs: DataFrame, k: int = 20, m: int = 5, most_segments: int = 2000, shard_segments: int = 10_000) -> DataFrame:
    """doc, at, n: runs of n words that stand earlier elsewhere, by _row and number of the first word."""
    doc, row = _row(F.col("doc_id"), F.col("text"))
    slim = docs.select(doc.alias("doc"), row.alias("row"), F.col("text").cast("string").alias("text"))
    every = written(slim.mapInArrow(_segments_of(k, m), _SEG), "every")
    often = every.groupBy("mv").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("mv").alias("o"))
    often = written(often, "often")  # so that both sides of the join are dealt anew and a hot minimiser can be split
    seg = written(every.join(often, every["mv"] == F.col("o"), "left_semi"), "segments")
    discard(every)
    discard(often)
    place = F.struct("doc", "at")
    kinds = written(seg.groupBy("mv", "content", "n").agg(F.min(place).alias("first")), "kinds")
    firsts = kinds.select(F.col("mv").alias("m_"), F.col("content").alias("c_"), F.col("n").alias("n_"), "first")
    copies = seg.join(firsts, (seg["mv"] == F.col("m_")) & (seg["content"] == F.col("c_")) & (seg["n"] == F.col("n_"))).where(place != F.col("first"))
    copies = written(copies.select("doc", "at", (F.col("n") + (k - 1)).alias("n")), "copies")
    discard(seg)
    contested = kinds.groupBy("mv").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(F.col("mv").alias("m_"), "kinds")
    asked = kinds.join(contested, kinds["mv"] == F.col("m_")).select("mv", "kinds", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), "n")
    asked = written(asked, "asked")
    discard(kinds)
    own_row = F.shiftleft(F.shiftright("at", 32), 32)
    lists = asked.groupBy(F.col("doc").alias("asker"), own_row.alias("asker_row")).agg(F.collect_list(F.struct("mv", "doc", "at", "n")).alias("asked"))
    texts = slim.join(lists, (F.col("doc") == F.col("asker")) & (F.col("row") == F.col("asker_row"))).select("text", "asked")
    content = written(texts.mapInArrow(_contents(k), "mv long, doc long, at long, words string"), "contents")
    hot = asked.where(F.col("kinds") > most_segments).select(F.col("mv").alias("h")).distinct()
    n_shards = max(1, -(-asked.count() // shard_segments))
    sharded = content.join(hot, content["mv"] == F.col("h"), "left_anti").groupBy(F.pmod(F.xxhash64("mv"), F.lit(n_shards)).alias("shard"))
    searched = sharded.applyInArrow(_search_shard(k), _RANGE)
    win = content.join(hot, content["mv"] == F.col("h"), "left_semi").select("doc", "at", "words").mapInArrow(_windows(k), "w1 long, w2 long, doc long, at long")
    lead = win.groupBy("w1", "w2").agg(F.min(place).alias("first")).select(F.col("w1").alias("v1"), F.col("w2").alias("v2"), "first")
    later = win.join(lead, (win["w1"] == F.col("v1")) & (win["w2"] == F.col("v2"))).where(place != F.col("first")).select("doc", "at", F.lit(k).alias("n"))
    found = written(searched.unionAll(later), "found")
    discard(content)
    discard(asked)
    return copies.unionAll(found)


def _kept(ws: list[str], ranges: list[tuple[int, int]]) -> list[str]:
    edge = np.zeros(len(ws) + 1, np.int64)
    for start, n in ranges:
        edge[start] += 1
        edge[start + n] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(ws, gone.tolist(), strict=True) if not g] if gone.any() else ws


def with_ranges(docs: DataFrame, **settings) -> DataFrame:
    """docs with column _ranges: array of (first word, words), null where nothing repeats."""
    found = repeated_runs(documents_only(docs, "doc_id", "text"), **settings)
    start = F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("start")
    found = found.groupBy(F.col("doc").alias("_ranges_doc"), F.shiftleft(F.shiftright("at", 32), 32).alias("_ranges_row")).agg(F.collect_set(F.struct(start, "n")).alias("_ranges"))
    doc, row = _row(docs["doc_id"], docs["text"])
    return docs.join(found, (doc == F.col("_ranges_doc")) & (row == F.col("_ranges_row")), "left").drop("_ranges_doc", "_ranges_row")


def dedup_substrings(docs: DataFrame, k: int = 20, **settings) -> DataFrame:
    """docs whose text holds the kept words, joined by single spaces; texts without repeats are unchanged."""
    import pandas as pd

    def strip(text: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([None if rs is None else " ".join(_kept(words(t), [(r["start"], r["n"]) for r in rs])) for t, rs in zip(text, ranges, strict=True)])

    strip.__annotations__ = {"text": pd.Series, "ranges": pd.Series, "return": pd.Series}
    strip = F.pandas_udf(strip, "string")
    out = with_ranges(docs, k=k, **settings)
    text = F.when(F.col("_ranges").isNull() | F.col("text").isNull(), F.col("text")).otherwise(strip("text", "_ranges"))
    return out.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def _digest():
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        def made():
            for d, text, ranges in rows(batches, "doc_id", "text", "_ranges"):
                ws = words(text)
                kept = _kept(ws, [(r["start"], r["n"]) for r in ranges or ()])
                yield d, len(ws), len(ws) - len(kept), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()

        yield from chunked(made(), schema)

    return run


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return with_ranges(docs).mapInArrow(_digest(), "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM v) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(20)) AS k)),
x AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
g AS (SELECT x.doc_id, count(*) FILTER (c.i IS NOT NULL) AS gone, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL), '') AS t
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
