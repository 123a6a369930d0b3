"""Packing along a space-filling curve.

Each document becomes a hashed count vector of its token ids, which fixed pseudo-random directions
project to a few dimensions; the quantised point's place on the Hilbert curve is its key. Encoded
documents are sorted by that key through range partitioning, and each task cuts its run of ids
into full sequences, so neighbours on the curve share sequences. What is left at the end of a task
is cut into sequences whose lengths are powers of two. No sequence needs padding.

Pieces never leave their task, so nothing but the range sort moves data.

Defined cases: a null text is empty and holds the end id alone; a null doc_id is packed as any
other; repeated rows are packed each; very long texts span as many sequences as they need; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, documents_only, mix, rows, tidy, written
from .encoding import encoder, vocabulary

BUCKETS, DIMS, BITS = 256, 3, 10


def directions(buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """Fixed +1/-1 directions, the same in every process."""
    bits = mix(np.arange(1, buckets * dims + 1, dtype=np.uint64)) & np.uint64(1)
    return np.where(bits.reshape(buckets, dims) == 1, 1.0, -1.0)


_DIRECTIONS = directions()


def points(docs: list[np.ndarray]) -> np.ndarray:
    """Quantised coordinates of documents, a row each: projections of their unit count vectors."""
    sizes = [len(d) for d in docs]
    flat = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
    at = _BUCKET_OF[flat & 0xFFFF] + np.repeat(np.arange(len(docs)) * BUCKETS, sizes)
    v = np.log1p(np.bincount(at, minlength=len(docs) * BUCKETS).reshape(len(docs), BUCKETS))
    norm = np.sqrt((v * v).sum(1))
    v = ((v - v.mean(1, keepdims=True)) @ _DIRECTIONS) / np.where(norm == 0, 1, norm)[:, None]
    return np.clip((np.tanh(v) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


_BUCKET_OF = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def hilbert(p: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points, a row each: axes are turned level by level from the
    coarsest, Gray-coded, and their bits interleaved."""
    x = p.T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


_ENCODED = "curve long, doc_id long, width int, ids binary"


def encoded(docs: DataFrame, vocab: str, end_id: int) -> DataFrame:
    """curve, doc_id, width (bytes an id), ids (bytes, with the end id) of each document."""
    schema = pa.schema([("curve", pa.int64()), ("doc_id", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        enc = encoder(vocab, False)
        end = np.array([end_id], enc.dtype).tobytes()

        def made():
            for b in batches:
                for i in range(0, b.num_rows, 500):
                    part = b.slice(i, 500)
                    ids = enc.many([t or "" for t in part.column(1).to_pylist()])
                    curve = hilbert(points([np.frombuffer(e, enc.dtype) for e in ids])).tolist()
                    for c, k, e in zip(curve, part.column(0).to_pylist(), ids, strict=True):
                        yield c, k, enc.dtype.itemsize, e + end

        yield from chunked(made(), schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidy(run, "encoders"), _ENCODED)


def cuts(total: int, most: int) -> list[int]:
    """Lengths of the sequences for a run of total ids: full ones, then powers of two."""
    out = [most] * (total // most)
    left = total % most
    while left:
        out.append(1 << (left.bit_length() - 1))
        left -= out[-1]
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocab: str, end_id: int = 1, most: int = 2048) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, curve, ids."""
    return _packed(docs, vocab, end_id, most, False)


def pieces(docs: DataFrame, vocab: str, end_id: int = 1, most: int = 2048) -> DataFrame:
    """pack() with a checksum in place of the ids and of their place on the curve."""
    return _packed(docs, vocab, end_id, most, True)


def _packed(docs: DataFrame, vocab: str, end_id: int, most: int, checked: bool) -> DataFrame:
    out = PIECES if checked else "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, curve long, ids binary"
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in out.split(", ")])
    ready = written(encoded(docs, vocab, end_id), "encoded")

    def run(batches):
        first = TaskContext.get().partitionId() << 40

        def piece(curve, doc_id, width, ids, at, lo, hi):
            if checked:
                crc = zlib.crc32(np.frombuffer(ids, f"<u{width}", hi - lo, lo * width).astype("<u4"))
                return doc_id, lo, hi - lo, crc, len(ids) // width, first + at[0], at[1]
            return doc_id, lo, hi - lo, len(ids) // width, first + at[0], at[1], curve, ids[lo * width : hi * width]

        def made():
            seq, offset, tail = 0, 0, []
            for curve, doc_id, width, ids in rows(batches, "curve", "doc_id", "width", "ids"):
                n, lo = len(ids) // width, 0
                while lo < n:
                    hi = min(n, lo + most - offset)
                    tail.append((curve, doc_id, width, ids, (seq, offset), lo, hi))
                    offset += hi - lo
                    lo = hi
                    if offset == most:
                        for p in tail:
                            yield piece(*p)
                        seq, offset, tail = seq + 1, 0, []
            sizes = cuts(offset, most)
            used = 0
            for curve, doc_id, width, ids, _, lo, hi in tail:
                while lo < hi:
                    take = min(hi - lo, sizes[0] - used)
                    yield piece(curve, doc_id, width, ids, (seq, used), lo, lo + take)
                    lo, used = lo + take, used + take
                    if used == sizes[0]:
                        sizes, seq, used = sizes[1:], seq + 1, 0

        yield from chunked(made(), schema)

    placed = ready.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")
    return placed.mapInArrow(tidy(run), out)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return pieces(docs, vocabulary("word_bpe_49k.json"))
