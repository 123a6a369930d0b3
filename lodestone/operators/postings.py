"""A stored inverted index for keyword search, in segments that come and go.

An index is a folder in shared storage. Items are dealt to stripes by a hash of their id, so that
the postings of a term within a stripe have a bound whatever the term's frequency. A segment holds,
for each term and stripe, blocks of postings in order of id (differences of ids, term frequencies,
item lengths) with the largest frequency and the least length of the block, from which a bound on
the block's score follows for any mean length. Folders by a hash of the term let a question read
its terms' blocks and nothing else.

A search scores stripe by stripe. In a stripe a question takes its terms from the one that may
score most; once the terms that are left cannot lift a new item over the k-th best so far, only
blocks that hold a candidate which still can reach it are decoded. What is skipped provably
changes no result: ids, scores and ties are those of ``search.bm25`` over the items that are in.

Versions are manifests, created without overwriting: of two writers of one version the later one
fails and may try again; a writer that dies leaves no manifest, so readers never see its segment.
Questions are taken in blocks of at most ``block``; a block and the document frequencies of its
terms are what the driver holds.

Defined cases: null texts and texts without a token are items without postings; they count in the
number of items. An id may be in once: adding one that is in needs its removal before. Removing
takes the rows (id, text) as they were added. Empty questions and empty indexes give no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources import versions

from .search import _blocks_of, _slices, top_k

_BLOCK = 128
_POSTINGS = "bucket int, term string, stripe int, block int, n int, max_tf int, min_len int, first long, last long, ids binary, tfs binary, lens binary"
_FOUND = "query_id long, id long, score double"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


class Postings:
    """The index in one folder; every method reads the version that is the latest when it is called."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, items_per_stripe: int = 20_000, least_stripes: int = 8):
        self._spark, self._path = spark, path.rstrip("/")
        self._buckets, self._per_stripe, self._least = buckets, items_per_stripe, least_stripes

    # --- versions ---------------------------------------------------------------------------
    def version(self) -> int:
        """The latest version, -1 for a folder without one."""
        return versions.latest(self._spark, f"{self._path}/manifests")

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v < 0:
            return {"version": -1, "segments": [], "removals": [], "stripes": self._least, "n": 0, "length": 0, "mean_idf": 0.0}
        return versions.read(self._spark, f"{self._path}/manifests", v)

    def _commit(self, old: dict, new: dict) -> dict:
        """new as the version after old. The statistics of its vocabulary are taken here, once for all searches."""
        new = new | {"version": old["version"] + 1}
        new["mean_idf"] = self._frequencies(new).agg(F.avg(_idf(new["n"])).alias("m")).first()["m"] or 0.0
        versions.commit(self._spark, f"{self._path}/manifests", new["version"], new)
        return new

    # --- writing ----------------------------------------------------------------------------
    def add(self, items: DataFrame) -> dict:
        """A segment of items (id, text); gives the new manifest."""
        old = self.manifest()
        docs = _counted(items)
        n, length = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        stripes = old["stripes"] if old["n"] else max(self._least, -(-n // self._per_stripe))
        name = self._segment(docs.select("id", "len", "tokens").mapInArrow(_terms, "term string, id long, len int, tf int"), stripes)
        return self._commit(old, old | {"segments": [*old["segments"], name], "stripes": stripes, "n": old["n"] + n, "length": old["length"] + length})

    def remove(self, items: DataFrame) -> dict:
        """Takes items (id, text, as they were added) out of all segments that are in; gives the new manifest."""
        old = self.manifest()
        docs = _counted(items)
        n, length = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        name = f"r{uuid.uuid4().hex}"
        docs.select("id", _stripe(old["stripes"])).write.parquet(f"{self._path}/{name}/ids")
        gone = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        self._dictionary(gone, name)
        return self._commit(old, old | {"removals": [*old["removals"], [name, len(old["segments"])]], "n": old["n"] - n, "length": old["length"] - length})

    def merge(self) -> dict:
        """All segments as one, without what has been removed; older folders stay for readers of older versions."""
        old = self.manifest()
        stripes = max(self._least, -(-old["n"] // self._per_stripe))
        rows = None
        for k, s in enumerate(old["segments"]):
            own = self._spark.read.parquet(f"{self._path}/{s}/postings").drop("bucket").mapInArrow(_unpacked, "term string, id long, len int, tf int")
            for r, before in old["removals"]:
                if k < before:
                    own = own.join(self._spark.read.parquet(f"{self._path}/{r}/ids").select("id"), "id", "left_anti")
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return old
        name = self._segment(rows, stripes)
        return self._commit(old, old | {"segments": [name], "removals": [], "stripes": stripes})

    def _segment(self, rows: DataFrame, stripes: int) -> str:
        """Writes postings (term, id, len, tf) and their dictionary."""
        name = f"s{uuid.uuid4().hex}"
        dealt = rows.select(self._bucket(), "term", _stripe(stripes), "id", "tf", "len").repartition("bucket", "stripe")
        packed = dealt.sortWithinPartitions("bucket", "term", "stripe", "id").mapInArrow(_streamed, _POSTINGS)
        packed.sortWithinPartitions("bucket", "term", "stripe", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self._path}/{name}/postings")
        held = self._read(f"{name}/postings", _POSTINGS)
        self._dictionary(held.groupBy("term").agg(F.sum("n").alias("df")), name)
        return name

    def _dictionary(self, df: DataFrame, name: str) -> None:
        rows = df.select(self._bucket(), "term", F.col("df").cast("long").alias("df"))
        rows.repartition(self._buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self._path}/{name}/terms")

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self._buckets)).cast("int").alias("bucket")

    # --- reading ----------------------------------------------------------------------------
    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self._spark.read.schema(schema).parquet(f"{self._path}/{name}")
        except AnalysisException:  # a table without rows has no folder of a bucket
            return self._spark.createDataFrame([], schema)

    def _frequencies(self, manifest: dict) -> DataFrame:
        """bucket, term, df over all segments and removals."""
        out = self._spark.createDataFrame([], "bucket int, term string, df long")
        for name in [*manifest["segments"], *(r for r, _ in manifest["removals"])]:
            out = out.unionByName(self._read(f"{name}/terms", "bucket int, term string, df long"))
        return out.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def _asked(self, rows: DataFrame, terms: DataFrame, buckets: list[int]) -> DataFrame:
        """Rows of the asked terms: only their buckets' folders are read."""
        return rows.where(F.col("bucket").isin(buckets)).join(F.broadcast(terms), ["bucket", "term"], "left_semi")

    def search(self, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, block: int = 2000, version: int | None = None) -> DataFrame:
        """query_id, id, score, rank0: as search.bm25() over the items of the index, for queries (query_id, text)."""
        m = self.manifest(version)
        out = self._spark.createDataFrame([], _FOUND)
        if not m["n"] or not m["length"]:
            return top_k(out, k)
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce(T.tokens("text"), F.array().cast("array<string>")).alias("tokens"))
        low, avgdl = floor * m["mean_idf"], m["length"] / m["n"]
        for rows in _blocks_of(asked, block):
            counts = {r.query_id: Counter(r.tokens) for r in rows if r.tokens}
            words = sorted(set().union(*counts.values()))
            if not words:
                continue
            terms = self._spark.createDataFrame([(w,) for w in words], "term string").select(self._bucket(), "term").coalesce(1)
            buckets = sorted({r.bucket for r in terms.select("bucket").distinct().collect()})
            df = self._asked(self._frequencies(m), terms, buckets).select("term", _idf(m["n"]).alias("raw"))
            idf = {r.term: low if r.raw < 0 else r.raw for r in df.collect()}
            weights = {q: {w: c * idf[w] for w, c in cs.items() if w in idf} for q, cs in counts.items()}
            held = None
            for i, s in enumerate(m["segments"]):
                own = self._asked(self._read(f"{s}/postings", _POSTINGS), terms, buckets).withColumn("seg", F.lit(i))
                held = own if held is None else held.unionByName(own)
            shared = self._spark.sparkContext.broadcast(weights)
            meet = _stripe_search(shared, k, k1, b, avgdl)
            gone = self._spark.createDataFrame([], "id long, stripe int, before int")
            for name, before in m["removals"]:
                gone = gone.unionByName(self._spark.read.parquet(f"{self._path}/{name}/ids").select("id", "stripe", F.lit(before).alias("before")))
            part = held.drop("bucket").groupBy("stripe").cogroup(gone.groupBy("stripe")).applyInArrow(meet, _FOUND)
            out = out.unionAll(part)
        return top_k(out, k)


def _counted(items: DataFrame) -> DataFrame:
    """id, tokens, len."""
    return items.select(F.col("id").cast("long").alias("id"), F.coalesce(T.tokens("text"), F.array().cast("array<string>")).alias("tokens")).withColumn("len", F.size("tokens"))


def _idf(n: int):
    return F.log(F.lit(n + 0.5) - F.col("df")) - F.log(F.col("df") + 0.5)


def _stripe(stripes: int):
    return F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int").alias("stripe")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, id, len, tf of items (id, len, tokens): tokens are counted where they lie."""
    for b in _slices(batches, 500):
        words = b.column(2).flatten().dictionary_encode()
        if not len(words):
            continue
        row, code = np.repeat(np.arange(b.num_rows), b.column(1).to_numpy()), words.indices.to_numpy()
        key, tf = np.unique(row * len(words.dictionary) + code, return_counts=True)
        row, code = pa.array(key // len(words.dictionary)), pa.array(key % len(words.dictionary))
        yield pa.RecordBatch.from_arrays([words.dictionary.take(code), b.column(0).take(row), b.column(1).take(row), pa.array(tf.astype(np.int32))], names=["term", "id", "len", "tf"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted postings (bucket, term, stripe, id, tf, len); a list may go on in the next batch."""
    rest = None
    for b in batches:
        now = pa.Table.from_batches([b])
        now = (pa.concat_tables([rest, now]) if rest is not None else now).combine_chunks()
        starts = _list_starts(now)
        end = int(starts[-1]) if len(starts) else 0
        if end:
            yield _blocks(now.slice(0, end), starts[:-1])
        rest = now.slice(end)
    if rest is not None and rest.num_rows:
        yield _blocks(rest, np.zeros(1, np.int64))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole lists (bucket, term, stripe, sorted entries of id, tf, len)."""
    for b in _slices(batches, 500):
        n = pa.compute.list_value_length(b.column(3)).to_numpy()
        if not n.sum():
            continue
        entries, row = b.column(3).flatten(), pa.array(np.repeat(np.arange(len(n)), n))
        flat = pa.table([*(b.column(i).take(row) for i in range(3)), *entries.flatten()], names=["bucket", "term", "stripe", "id", "tf", "len"])
        yield _blocks(flat, (np.cumsum(n) - n)[n > 0])


def _list_starts(rows: pa.Table) -> np.ndarray:
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    code = rows.column(1).combine_chunks().dictionary_encode().indices.to_numpy()
    bucket, stripe = rows.column(0).to_numpy(), rows.column(2).to_numpy()
    new = (code[1:] != code[:-1]) | (stripe[1:] != stripe[:-1]) | (bucket[1:] != bucket[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _blocks(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Blocks of whole lists that start at the given rows."""
    n = rows.num_rows
    pos = np.arange(n) - np.repeat(starts, np.diff(starts, append=n))
    at = np.flatnonzero(pos % _BLOCK == 0)
    ends = np.append(at[1:], n)
    ids, tfs, lens = (rows.column(i).to_numpy().astype(np.int64) for i in (3, 4, 5))
    steps = np.diff(ids, prepend=ids[0])
    steps[at] = 0
    head = rows.select([0, 1, 2]).take(pa.array(at)).combine_chunks()
    cols = [(ends - at).astype(np.int32), np.maximum.reduceat(tfs, at).astype(np.int32), np.minimum.reduceat(lens, at).astype(np.int32), ids[at], ids[ends - 1]]
    out = pa.table([*head.columns, (pos[at] // _BLOCK).astype(np.int32), *cols, *(pa.array(_coded(x, at, ends), pa.binary()) for x in (steps, tfs, lens))], names=["bucket", "term", "stripe", "block", "n", "max_tf", "min_len", "first", "last", "ids", "tfs", "lens"])
    return out.combine_chunks().to_batches()[0]


_WIDTHS = ("<u1", "<u2", "<u4", "<u8")


def _coded(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The non-negative integers of each block in the least width of 1, 2, 4 or 8 bytes that holds the largest, after that width's number."""
    width = np.searchsorted([1 << 8, 1 << 16, 1 << 32], np.maximum.reduceat(x, starts), side="right")
    held = {w: (bytes([w]), x.astype(_WIDTHS[w]).tobytes()) for w in np.unique(width).tolist()}
    return [held[w][0] + held[w][1][a << w : b << w] for w, a, b in zip(width.tolist(), starts.tolist(), ends.tolist(), strict=True)]


def _decoded(held: list[bytes], n: np.ndarray) -> np.ndarray:
    """The integers of coded blocks of n each, in order."""
    width, out = np.array([x[0] for x in held]), np.empty(int(n.sum()), np.int64)
    for w in np.unique(width).tolist():
        own = width == w
        out[np.repeat(own, n)] = np.frombuffer(b"".join([held[i][1:] for i in np.flatnonzero(own).tolist()]), _WIDTHS[w])
    return out


def _bytes(x: np.ndarray) -> bytes:
    """One block, coded."""
    return _coded(x, np.zeros(1, np.int64), np.array([len(x)]))[0]


def _numbers(held: bytes) -> np.ndarray:
    return np.frombuffer(held, _WIDTHS[held[0]], offset=1).astype(np.int64)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, id, len, tf of stored blocks."""
    for b in _slices(batches, 5000):
        col = lambda c: b.column(b.schema.get_field_index(c))
        n = col("n").to_numpy()
        if not len(n):
            continue
        steps, lens, tfs = (_decoded(col(c).to_pylist(), n) for c in ("ids", "lens", "tfs"))
        run = np.cumsum(steps)
        ids = run + np.repeat(col("first").to_numpy() - run[np.cumsum(n) - n], n)
        yield pa.RecordBatch.from_arrays([col("term").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(ids), pa.array(lens.astype(np.int32)), pa.array(tfs.astype(np.int32))], names=["term", "id", "len", "tf"])


class Lists:
    """The asked blocks of one stripe; a block is decoded when it is first needed."""

    def __init__(self, rows: pa.Table, gone: dict[int, np.ndarray], k1: float, b: float, avgdl: float):
        rows = rows.sort_by([("seg", "ascending"), ("term", "ascending"), ("first", "ascending")])
        self.decoded = 0
        self._ids, self._tfs, self._lens = (rows.column(c) for c in ("ids", "tfs", "lens"))
        self.first, self.last, self._seg = (rows.column(c).to_numpy() for c in ("first", "last", "seg"))
        self._share = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))
        self.bound = self._share(rows.column("max_tf").to_numpy(), rows.column("min_len").to_numpy())
        self._gone, self._held = gone, {}
        #: term -> its blocks of each segment, in order of id
        self.of: dict[str, list[np.ndarray]] = {}
        terms = rows.column("term").to_pylist()
        edges = [i for i in range(len(terms)) if i == 0 or terms[i] != terms[i - 1] or self._seg[i] != self._seg[i - 1]]
        for i, j in zip(edges, [*edges[1:], len(terms)], strict=True):
            self.of.setdefault(terms[i], []).append(np.arange(i, j))

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and shares (score by unit of weight) of block i, without removed items."""
        if i not in self._held:
            self.decoded += 1
            ids = self.first[i] + np.cumsum(_numbers(self._ids[i].as_py()))
            share = self._share(_numbers(self._tfs[i].as_py()), _numbers(self._lens[i].as_py()))
            gone = self._gone.get(int(self._seg[i]))
            if gone is not None and len(gone):
                stay = ~np.isin(ids, gone)
                ids, share = ids[stay], share[stay]
            self._held[i] = ids, share
        return self._held[i]


def best_of(lists: Lists, weights: dict[str, float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the items that may be among the k best for a question (term -> weight), exact scores."""
    terms = [(w * max(float(lists.bound[x].max()) for x in lists.of[t]), t, w) for t, w in sorted(weights.items()) if t in lists.of]
    terms.sort(key=lambda x: (-x[0], x[1]))
    skip = all(w > 0 for _, _, w in terms)
    rest = np.concatenate([np.cumsum([u for u, _, _ in terms][::-1])[::-1], [0.0]])
    ids, scores = np.zeros(0, np.int64), np.zeros(0)
    for n, (_, term, weight) in enumerate(terms):
        bar = float(np.partition(scores, -k)[-k]) - 1e-8 if skip and len(scores) > k else -np.inf
        blocks = np.concatenate(lists.of[term])
        if rest[n] < bar:  # no item that is not held can come in
            stay = scores + rest[n] >= bar
            ids, scores = ids[stay], scores[stay]
            use = []
            for own in lists.of[term]:
                at = np.searchsorted(lists.first[own], ids, side="right") - 1
                inside = (at >= 0) & (ids <= lists.last[own[at]]) & (scores + weight * lists.bound[own[at]] + rest[n + 1] >= bar)
                use.append(own[np.unique(at[inside])])
            blocks = np.concatenate(use)
        if not len(blocks):
            continue
        new, share = (np.concatenate(x) for x in zip(*map(lists.block, blocks.tolist()), strict=True))
        if rest[n] < bar:
            held = np.isin(new, ids)
            new, share = new[held], share[held]
        both, at = np.unique(np.concatenate([ids, new]), return_inverse=True)
        total = np.zeros(len(both))
        np.add.at(total, at, np.concatenate([scores, weight * share]))
        ids, scores = both, total
    return ids, scores


def _stripe_search(shared, k: int, k1: float, b: float, avgdl: float):
    def run(rows: pa.Table, gone: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _FOUND_ARROW.empty_table()
        rows = rows.combine_chunks()
        out_ids, before = gone["id"].to_numpy(), gone["before"].to_numpy()
        segments = np.unique(rows["seg"].to_numpy())
        lists = Lists(rows, {int(s): out_ids[before > s] for s in segments}, k1, b, avgdl)
        found = []
        for q, weights in shared.value.items():
            ids, scores = best_of(lists, weights, k)
            if len(ids):
                first = np.lexsort((ids, -np.round(scores, 9)))[:k]
                found.append((np.full(len(first), q), ids[first], scores[first]))
        if not found:
            return _FOUND_ARROW.empty_table()
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], schema=_FOUND_ARROW)

    return run
