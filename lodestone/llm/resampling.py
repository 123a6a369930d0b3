"""Importance resampling towards a target distribution of hashed n-grams.

Every run of 1 to n consecutive words is a feature; its bucket is the CRC-32 of its bytes. One scan
of a text keeps a ring of the running CRC states of its last n starts: a word extends each state by
a space and itself and opens a new one, so a run of any length costs one extension and no run is
ever built as a string. The scan is written once as bucket codes; counts of source and target
buckets come from it by partial counts per task (at most n_buckets rows each), and the gain of each
bucket goes back to the tasks, which is n_buckets numbers whatever the size of the corpus.

A document's score is its mean gain plus Gumbel noise of its id, so the best scores are a sample
without replacement by importance. Places are numbered over ranges of (score, doc_id): no task
holds all rows, and equal scores, or a doc_id that repeats, are split as well.

Defined cases: a null text has no word, so no feature and weight 0; a null doc_id is hashed as the
seed with nothing after it and comes first among equal scores; rows that repeat are each scored and
take a place each, in any order among equals; very long texts are scanned whole; an empty target
table makes all gains follow from add-one smoothing alone, empty documents give no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.state import numbered

from .common import chunked, discard, documents_only, rows, written

#: Bytes of words once A-Z are lower case: digits, letters and all beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def feature_crcs(text: str | None, n: int) -> tuple[int, list[int]]:
    """Number of words, and the CRC-32 of every run of 1 to n consecutive words joined by one space."""
    ws = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    crc, out = zlib.crc32, []
    if n == 1:  # a ring of one state
        return len(ws), list(map(crc, ws))
    ring: list[int] = []
    for w in ws:
        spaced = b" " + w
        ring = [crc(spaced, state) for state in ring[-(n - 1) :]]
        ring.append(crc(w))
        out += ring
    return len(ws), out


def features(texts: DataFrame, key: str, n: int, n_buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, codes (buckets as little-endian unsigned integers of two or four bytes)."""
    code = _code(n_buckets)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("codes", pa.binary())])

    def one(doc_id, text):
        n_words, crcs = feature_crcs(text, n)
        return doc_id, n_words, len(crcs), (np.array(crcs, np.uint32) % np.uint32(n_buckets)).astype(code).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from chunked((one(i, t) for i, t in rows(batches, "doc_id", "text")), schema, 2000)

    slim = documents_only(texts, key, "text").select(F.col(f"`{key}`").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, codes binary")


def _code(n_buckets: int) -> np.dtype:
    return np.dtype("<u2" if n_buckets <= 1 << 16 else "<u4")


def bucket_counts(found: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, n: features of each bucket, counted in the tasks before the shuffle."""
    code, schema = _code(n_buckets), pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer() or b"", code), minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    return found.select("codes").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, gain: 1000 times the log ratio of smoothed shares, target (bucket, n) to source, rounded down; a row per bucket."""
    spark = source.sparkSession
    ids = spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    each = ids.join(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket", "left").na.fill(0)
    sums = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    size = F.lit(float(n_buckets))
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + size)) / ((F.col("s") + 1.0) * (F.col("all_t") + size))
    return each.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weights(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the mean gain of each row of features(), rounded down."""
    code = _code(len(gains))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    shared = found.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = (np.frombuffer(x.as_buffer() or b"", code) for x in b.column(3))
            w = np.array([int(shared.value[c].sum()) // len(c) if len(c) else 0 for c in codes], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(w)], schema=schema)

    return found.select("doc_id", "n_words", "n_features", "codes").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def importance_resample(docs: DataFrame, target: DataFrame, n: int = 1, n_buckets: int = 10_000, seed: str = "2024", percent: int = 10, min_words: int = 20, key: str = "doc_id", target_key: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row for each row of docs.

    Of the N rows with min_words words or more, the floor(percent * N / 100) of the highest score
    have a rank (from 1; equal scores by doc_id); rank is null for the others.
    """
    found = written(features(docs, key, n, n_buckets), "features")
    source, wanted = bucket_counts(found, n_buckets), bucket_counts(features(target, target_key, n, n_buckets), n_buckets)
    gains = np.zeros(n_buckets, np.int64)
    for r in bucket_gains(source, wanted, n_buckets).collect():  # n_buckets rows
        gains[r.bucket] = r.gain
    drawn_by = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(drawn_by, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weights(found, gains).withColumn("score", F.col("weight") + noise)
    placed = numbered(scored, [F.col("n_words") < min_words, F.col("score").desc(), F.col("doc_id"), F.rand(7)], "_place")
    drawn = found.where(F.col("n_words") >= min_words).count() * percent // 100
    discard(found)
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def drawn_documents(docs: DataFrame, ranks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose id has a rank."""
    ids = ranks.where("rank is not null").select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(ids, docs[key].cast("long").eqNullSafe(F.col("_drawn_id")), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, wanted = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_resample(docs, wanted).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k)) AS entry),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
sw AS (SELECT w, sum(c)::BIGINT AS s, 0::BIGINT AS t FROM dw GROUP BY w),
tw AS (SELECT w, 0::BIGINT AS s, count(*) AS t FROM (SELECT unnest(ws) AS w FROM b) GROUP BY w),
words AS (SELECT w, hex(encode(w)) AS hx, sum(s) AS s, sum(t) AS t FROM (SELECT * FROM sw UNION ALL SELECT * FROM tw) GROUP BY w),
crc AS (SELECT w, s, t, xor(list_reduce(list_transform(range(1, len(hx), 2), lambda i: ('0x' || hx[i:i+1])::BIGINT), lambda c, x: xor(c >> 8, tab.entry[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM words, tab),
k AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM crc GROUP BY bucket),
z AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM k),
g AS (SELECT bucket, floor(1000.0 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM k, z),
m AS (SELECT doc_id, sum(c)::BIGINT AS n, sum(c * gain)::BIGINT AS total FROM dw JOIN crc USING (w) JOIN g USING (bucket) GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
             ('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, n_features, weight, weight + floor(-1000.0 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0)))::BIGINT AS score FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS p, count(*) FILTER (WHERE n_features >= 20) OVER () AS n_all FROM r)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN n_features >= 20 AND p <= (10 * n_all) // 100 THEN p::BIGINT END AS rank
FROM o
"""
