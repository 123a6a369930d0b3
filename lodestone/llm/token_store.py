"""Token-id shards with a minimal perfect hash index.

Documents are encoded in ascending doc_id order (range partitioned and sorted) and stored as
shards. A shard is one row of a Parquet table in shared storage: the raw little-endian ids of its
documents one after another, where each document begins, its keys, and an index blob. The index is
a minimal perfect hash over the distinct keys (bit arrays of cascading levels with popcount ranks)
that gives a key's slot, where its first row and a 32-bit fingerprint are kept. A lookup touches a
few words of the bit arrays, one slot and the payload; a key that was never stored fails the
fingerprint test, up to one chance in 2**32.

The position of a shard among all ids needs only one total per range partition. A lookup finds the
shards of its keys in the key ranges alone, and reads the row groups that hold those.

Defined cases: a null text holds the end id alone; a null doc_id is stored first, under a reserved
key; rows with equal doc_id are stored next to each other, by hash of their texts, however many
shards and partitions they fill, and a lookup gives them all; repeated rows are stored each; an empty
table gives an empty store; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunked, documents_only, mix, rows, shared_dir, tidy
from .encoding import encoder, vocabulary

NULL_KEY = -(1 << 63)
_SEEDS = 64


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        counts = np.bitwise_count(bits).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = mix(np.array([level + 1], np.uint64))[0]
        return mix(keys ^ salt) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left, sizes, parts, level = keys.astype(np.uint64), [], [], 0
        while len(left):
            if level > _SEEDS:
                raise ValueError("keys are not distinct")
            size = max(64, -(-int(len(left) * gamma) // 64) * 64)
            at = cls._at(left, level, size)
            hits = np.bincount(at.astype(np.int64), minlength=size)
            words = np.packbits(hits == 1, bitorder="little").view("<u8").astype(np.uint64)
            sizes.append(size)
            parts.append(words)
            left = left[hits[at.astype(np.int64)] > 1]
            level += 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1 where no level holds it."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = self._at(keys[todo], level, size).astype(np.int64) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            got = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slot = self.rank[word] + np.bitwise_count(below).astype(np.int64)
            out[todo[got]] = slot[got]
            todo = todo[~got]
            base += size
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(32)).astype("<u4")


def pack_index(keys: np.ndarray) -> bytes:
    """Index blob of a shard whose rows have these sorted keys."""
    distinct, first = np.unique(keys, return_index=True)
    h = PerfectHash.build(distinct.view(np.uint64))
    slot = h.slots(distinct.view(np.uint64))
    row, mark = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    row[slot], mark[slot] = first, fingerprint(distinct.view(np.uint64))
    head = struct.pack(f"<II{len(h.sizes)}Q", len(distinct), len(h.sizes), *h.sizes)
    return head + h.bits.astype("<u8").tobytes() + row.tobytes() + mark.tobytes()


class Shard:
    """A shard as read back."""

    def __init__(self, keys: bytes, starts: bytes, payload: bytes, index: bytes, width: int):
        self.keys, self.starts = np.frombuffer(keys, "<i8"), np.frombuffer(starts, "<u8").astype(np.int64)
        self.ids = np.frombuffer(payload, f"<u{width}")
        n, levels = struct.unpack_from("<II", index)
        sizes = list(struct.unpack_from(f"<{levels}Q", index, 8))
        at = 8 + 8 * levels
        words = sum(sizes) // 64
        self.hash = PerfectHash(sizes, np.frombuffer(index, "<u8", words, at).astype(np.uint64))
        self.row = np.frombuffer(index, "<u4", n, at + 8 * words)
        self.mark = np.frombuffer(index, "<u4", n, at + 8 * words + 4 * n)

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key; -1 where the key is not stored."""
        slot = self.hash.slots(keys.view(np.uint64))
        ok = slot >= 0
        ok[ok] = self.mark[slot[ok]] == fingerprint(keys[ok].view(np.uint64))
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.row[slot[ok]]
        return out

    def span(self, row: int) -> tuple[int, int]:
        return int(self.starts[row]), int(self.starts[row + 1])


_SHARDS = "part int, shard long, base long, n_docs long, n_tokens long, first_key long, last_key long, width int, keys binary, starts binary, payload binary, index binary"


def write_store(docs: DataFrame, path: str, vocab: str, end_id: int, shard_tokens: int = 1 << 20) -> None:
    """Encodes docs (doc_id, text) and writes their shards to path."""
    types = [pa.int32(), *[pa.int64()] * 6, pa.int32(), *[pa.binary()] * 4]
    schema = pa.schema(list(zip([c.split()[0] for c in _SHARDS.split(", ")], types, strict=True)))

    def run(batches):
        enc = encoder(vocab, True)
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        part = TaskContext.get().partitionId()

        def shards():
            keys, parts, held, base, n = [], [], 0, 0, 0

            def flush():
                lens = np.array([len(p) // width for p in parts], np.int64)
                k = np.array(keys, "<i8")
                starts = np.concatenate([[0], np.cumsum(lens)]).astype("<u8")
                return (part, (part << 32) + n, base, len(keys), held, keys[0], keys[-1], width, k.tobytes(), starts.tobytes(), b"".join(parts), pack_index(k))

            for b in batches:
                for i in range(0, b.num_rows, 2000):
                    rows_ = b.slice(i, 2000)
                    for k, e in zip(rows_.column(0).to_pylist(), enc.many([t or "" for t in rows_.column(1).to_pylist()]), strict=True):
                        k = NULL_KEY if k is None else k
                        if held >= shard_tokens:
                            yield flush()
                            base, keys, parts, held, n = base + held, [], [], 0, n + 1
                        keys.append(k)
                        parts.append(e + end)
                        held += len(e) // width + 1
            if keys:
                yield flush()

        yield from chunked(shards(), schema, 4)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.withColumn("h", F.xxhash64("text"))  # rows of one doc_id, or of none, are dealt too
    placed = slim.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    # row groups of a few shards, so that a lookup reads little besides
    placed.mapInArrow(tidy(run, "encoders"), _SHARDS).write.option("compression", "uncompressed").option("parquet.block.size", 8 << 20).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, found through the index."""
    shards = spark.read.schema(_SHARDS).parquet(path)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    bases = totals.select("part", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32())])

    def run(batches):
        def made():
            for part, base, width, keys, starts, payload, index in rows(batches, "part", "base", "width", "keys", "starts", "payload", "index"):
                s = Shard(keys, starts, payload, index, width)
                distinct = np.unique(s.keys)
                first = s.rows_of(distinct)
                if (first < 0).any():
                    raise ValueError("a stored key is not in the index")
                for k, r in zip(distinct.tolist(), first.tolist(), strict=True):
                    while r < len(s.keys) and s.keys[r] == k:
                        a, b = s.span(r)
                        yield None if k == NULL_KEY else k, base + a, b - a, zlib.crc32(s.ids[a:b].astype("<u4").tobytes()), part
                        r += 1

        yield from chunked(made(), schema)

    # one row per range partition: as many as the writer had tasks
    found = shards.drop("shard", "n_docs", "n_tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame, most_pushed: int = 5000) -> DataFrame:
    """(doc_id, ids) of the stored documents among keys (doc_id); unknown keys give no row.

    Shards are found in their key ranges, without any payload. The numbers of up to ``most_pushed``
    asked shards go down to the scan, which then reads the row groups that hold them; more are
    joined after a scan of all. Either way only asked shards are moved.
    """
    shards = spark.read.schema(_SHARDS).parquet(path)
    spans = shards.select("part", "shard", "first_key", "last_key")
    parts = spans.groupBy("part").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"))
    ask = keys.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    # one row per range partition: as many as the writer had tasks
    near = ask.join(F.broadcast(parts), (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))).select("key", F.col("part").alias("p"))
    wanted = near.join(spans, (F.col("p") == F.col("part")) & (F.col("key") >= F.col("first_key")) & (F.col("key") <= F.col("last_key"))).select("key", "shard")
    asked = [r.shard for r in wanted.select("shard").distinct().limit(most_pushed + 1).collect()]
    if len(asked) <= most_pushed:
        held = shards.where(F.col("shard").isin(asked)) if asked else shards.limit(0)
    else:
        held = shards.join(wanted.select("shard").distinct(), "shard", "left_semi")

    def get(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, out = [], []
        if left.num_rows and right.num_rows:
            r = right.slice(0, 1).to_pylist()[0]
            s = Shard(r["keys"], r["starts"], r["payload"], r["index"], r["width"])
            ks = np.array(left.column("key").to_pylist(), np.int64)
            for k, row in zip(ks.tolist(), s.rows_of(ks).tolist(), strict=True):
                while 0 <= row < len(s.keys) and s.keys[row] == k:
                    a, b = s.span(row)
                    ids.append(None if k == NULL_KEY else k)
                    out.append(s.ids[a:b].tolist())
                    row += 1
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(out, pa.list_(pa.int64()))})

    return wanted.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(get, "doc_id long, ids array<long>")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    path = f"{shared_dir(spark)}/store"
    write_store(docs, path, vocabulary("byte_bpe_50k.json"), 2)
    return read_documents(spark, path)
