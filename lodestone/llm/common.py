"""Shared storage, text splitting and hashing for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
_SEPARATORS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all machines share.

    Where the setting is absent (tests, a single machine), a folder below the warehouse serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{root.rstrip('/')}/lodestone/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again with its schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    _made.append(path)
    release(spark)
    return out


_made: list[str] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def clear(spark: SparkSession) -> None:
    """Deletes all tables that written() has made in this driver; call it once no result that reads them is needed."""
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files that no plan refers to any more."""
    for _ in range(2):  # the listener bus lets go of a finished query a moment later
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
    give_back()  # else the driver keeps what its largest table took


def give_back() -> None:
    """Hands this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: What a Python worker keeps from task to task, by kind.
_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    return _kept.setdefault(kind, {})


def forget_all_but(kind: str | None) -> None:
    for k in [k for k in _kept if k != kind]:
        del _kept[k]
    give_back()


def tidy(run: Callable, kind: str | None = None) -> Callable:
    """The same function of batches, for a worker that other steps used before and will use again.

    Workers stay, so a step would run beside the memos of earlier steps and what those had freed.
    Before the first batch all kept things but those of this kind go; after the last one freed
    memory goes back.
    """

    def alone(batches):
        forget_all_but(kind)
        try:
            yield from run(batches)
        finally:
            give_back()

    return alone


def small_batches(spark: SparkSession, most: int = 2000) -> None:
    """Keeps what Python workers hold at a time small: texts are long, Spark's default is 10000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


def discard(df: DataFrame) -> None:
    """Deletes a table made by written() that no later plan reads."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, _SEPARATORS))


def word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes that hold across processes; equal words have equal hashes."""
    return _stable(ws)


class WordHashes:
    """word -> stable 64-bit hash with a bounded memo (the hash itself never depends on the memo)."""

    def __init__(self, most: int = 150_000):
        import xxhash

        self._digest, self._memo, self._most = xxhash.xxh3_64_intdigest, {}, most

    def __call__(self, ws: list[str]) -> np.ndarray:
        memo, digest = self._memo, self._digest
        if len(memo) > self._most:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            for w in set(ws).difference(memo):
                memo[w] = digest(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))


def _stable(ws: list[str]) -> np.ndarray:
    held = kept("words")
    if not held:
        held[None] = WordHashes()
    return held[None](ws)


_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixer: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, k: int, odd: int = 0) -> np.ndarray:
    """Order-dependent hashes of all windows of k consecutive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = _ODD[odd]
    out = h[:n].copy()
    for i in range(1, k):
        out *= b
        out += h[i : n + i]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Tuples of the named columns, a thousand rows in Python's memory at a time."""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(n)) for n in names]
        for i in range(0, b.num_rows, 1000):
            yield from zip(*(c.slice(i, 1000).to_pylist() for c in cols), strict=True)


def chunked(make: Iterator[tuple], schema: pa.Schema, most: int = 20_000, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of the tuples that make yields, by rows and bytes of their binary and text values."""
    held: list[tuple] = []
    size = 0
    for r in make:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, (bytes, str)))
        if len(held) >= most or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def documents_only(docs: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, so that further columns of any name cannot clash."""
    return docs.select(*(F.col(f"`{c}`") for c in cols))


def only_marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows without most of those whose key (a long) is not in ids (id), before they are moved.

    ids are marked in 2**26 bits, as 2**20 words at most: what is broadcast has that bound at any
    size, and the more ids there are the more rows pass. What passes is still to be joined.
    """
    return _by_marks(rows, key, ids, "inner").where(_marked(key) == 1).drop("_mark_word", "_mark_bits")


def none_marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows that only_marked() leaves out, and those without a key: none of them is in ids."""
    return _by_marks(rows, key, ids, "left").where(F.col(key).isNull() | (F.coalesce(_marked(key), F.lit(0)) == 0)).drop("_mark_word", "_mark_bits")


def _mark_word(h):
    return F.pmod(h, F.lit(1 << 20))


def _mark_bit(h):
    return F.shiftright(h, 20).bitwiseAND(63).cast("int")


def _marked(key: str):
    return F.call_function("shiftright", F.col("_mark_bits"), _mark_bit(F.xxhash64(F.col(key)))).bitwiseAND(1)


def _by_marks(rows: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    of = F.xxhash64(F.col("id"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _mark_bit(of))
    marks = ids.select(_mark_word(of).alias("_mark_word"), one.alias("bit")).groupBy("_mark_word").agg(F.bit_or("bit").alias("_mark_bits"))
    return rows.join(F.broadcast(marks), _mark_word(F.xxhash64(F.col(key))) == F.col("_mark_word"), how)
