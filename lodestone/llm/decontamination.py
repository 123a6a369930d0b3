"""Benchmark decontamination by q-gram filtering in diagonal bands and banded alignment.

Item and document texts are compared in a normal form (lower case; runs of anything but letters
and digits are one space). An item is searched by windows: itself if short, else each of its
stretches of ``width`` characters. A window matches where the document has a stretch within
``rate * width`` edits.

If a window of length w occurs with at most k edits, at least w + 1 - q - k*q of its q-grams
stand unchanged on diagonals that lie within 2k + 1 of each other. So a document is scanned once
with a rolling hash against a table of the items' q-grams, each held once; stretches without enough
hits for any window are dropped; unbroken runs of hits on a diagonal are verbatim regions; hits of
the others are taken by item and overlapping diagonal band in order of their place in the item, and
the windows that hold enough of them are aligned exactly within their band, many at a time.

The benchmark is taken in blocks of at most ``block_chars`` characters, each a broadcast index of
bounded size and one scan of the documents. Documents are never shuffled.

Defined cases: null or empty texts and items match nothing; items shorter than ``least`` normal
characters are searched without edits, shorter than q not at all; repeated rows are each reported;
null ids are kept as null; an empty table on either side gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, documents_only, mix, tidy

_GAP = re.compile(r"[\W_]+")
_RUN = re.compile(r"[^\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def normal(text: str | None) -> str:
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(c: np.ndarray, q: int) -> np.ndarray:
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = c[:n].astype(np.uint64)
    for i in range(1, q):
        out *= _MUL
        out += c[i : n + i]
    return mix(out)


def banded(pattern: np.ndarray, text: np.ndarray, lo: int, hi: int, k: int) -> tuple[int, int] | None:
    """Least edits of pattern against a stretch of text whose start lies in [lo, hi], and where it
    ends; None above k. Only diagonals within k of that range are filled."""
    d0, d1 = lo - k, hi + k
    width = d1 - d0 + 1
    far = k + 1
    diag = np.arange(d0, d1 + 1)
    row = np.where((diag >= max(lo, 0)) & (diag <= min(hi, len(text))), 0, far).astype(np.int64)
    step = np.arange(width)
    pad = np.concatenate([np.zeros(max(0, -d0), np.uint32), text, np.zeros(len(pattern) + width, np.uint32)])
    at = d0 + max(0, -d0)
    for i, p in enumerate(pattern):
        # cell (i + 1, diagonal d) stands at text position i + 1 + d
        same = row + (pad[at + i : at + i + width] != p)
        same[1:] = np.minimum(same[1:], far + np.zeros(width - 1, np.int64))
        down = np.empty(width, np.int64)
        down[:-1], down[-1] = row[1:] + 1, far
        v = np.minimum(same, down)
        v = np.minimum.accumulate(v - step) + step
        pos = diag + i + 1
        v[(pos < 0) | (pos > len(text))] = far
        row = np.minimum(v, far)
        if row.min() > k:
            return None
    j = int(row.argmin())
    return int(row[j]), int(diag[j]) + len(pattern)


class Windows:
    """Search index over one block of benchmark items: every window of ``width`` characters of each."""

    def __init__(self, items: list[tuple[int, str | None]], q: int = 9, width: int = 80, rate: float = 0.075, least: int = 30):
        self.q = q
        self.items, self.patterns, self.size, self.k, self.need = [], [], [], [], []
        for item, text in items:
            n = normal(text)
            if len(n) < q:
                continue
            # an item hardly longer than a window is searched as a whole too: its edits may be more
            for size in sorted({min(len(n), width), len(n) if len(n) <= width * 6 // 5 else width}):
                k = int(rate * size) if size >= least else 0
                k = min(k, (size - q) // q)
                self.items.append(item)
                self.patterns.append(codes(n))
                self.size.append(size)
                self.k.append(k)
                self.need.append(size + 1 - q - k * q)
        self.size, self.k, self.need = (np.array(x, np.int64) for x in (self.size, self.k, self.need))
        self.chars = np.concatenate(self.patterns) if self.patterns else np.zeros(0, np.uint32)
        self.len = np.array([len(p) for p in self.patterns], np.int64)
        self.base = np.cumsum(self.len) - self.len
        hashes = [grams(p, q) for p in self.patterns]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        win = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        pos = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.win, self.pos = h[order], win[order], pos[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.least = int(self.need.min()) if len(self.need) else 1
        self.reach = int((self.size + self.k).max()) if len(self.k) else q

    def find(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item's number, start, end, edits) of matching windows and of verbatim runs of windows in a code array."""
        h = grams(c, self.q)
        if not len(h) or not len(self.hash):
            return []
        hit = np.nonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])[0]
        if len(hit) < self.least:
            return []
        # a hit stays if some stretch of reach characters around it holds enough hits
        span = self.reach - self.q + 1
        t = self.least
        close = hit[t - 1 :] - hit[: len(hit) - t + 1] < span
        edge = np.zeros(len(hit) + 1, np.int64)
        np.add.at(edge, np.nonzero(close)[0], 1)
        np.add.at(edge, np.nonzero(close)[0] + t, -1)
        hit = hit[np.cumsum(edge[:-1]) > 0]
        if not len(hit):
            return []
        lo, hi = np.searchsorted(self.hash, h[hit], "left"), np.searchsorted(self.hash, h[hit], "right")
        n = hi - lo
        at = np.repeat(hit, n)
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        win, pos = self.win[entry], self.pos[entry]
        runs = self._verbatim(c, win, pos, at - pos)
        w, band, s = self._starts(win, pos, at - pos)
        for w_, d, first, n_ in runs:
            b = d // (2 * self.k[w_] + 1)
            keep = (w != w_) | ((band != b) & (band != b - 1)) | (s < first) | (s > first + n_ - self.size[w_])
            w, band, s = w[keep], band[keep], s[keep]
        out = [(w_, d + first, d + first + n_, 0) for w_, d, first, n_ in runs]
        last = None
        for row in self._aligned(c, w, band, s):
            # the same window at the same place, from two bands that overlap
            if last and last[:2] == row[:2] and row[3] - last[3] <= self.size[row[0]] // 2:
                last = min(last, row, key=lambda x: x[4])
                out[-1] = (last[0], *last[2:])
            else:
                last = row
                out.append((row[0], *row[2:]))
        return out

    def _verbatim(self, c, win, pos, diagonal) -> list[tuple[int, int, int, int]]:
        """(item's number, diagonal, first place in the item, length) of unbroken runs that hold a window."""
        order = np.lexsort((pos, diagonal, win))
        w, d, p = win[order], diagonal[order], pos[order]
        first = np.nonzero(np.r_[True, (w[1:] != w[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])[0] if len(w) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(w)]) + self.q - 1
        first, n = first[n >= self.size[w[first]]], n[n >= self.size[w[first]]]
        found = zip(w[first].tolist(), d[first].tolist(), p[first].tolist(), n.tolist(), strict=True)
        return [r for r in found if np.array_equal(self.patterns[r[0]][r[2] : r[2] + r[3]], c[r[1] + r[2] : r[1] + r[2] + r[3]])]

    def _starts(self, win, pos, diagonal):
        """item's number, band, start of the windows that hold enough hits in a band of diagonals."""
        # bands [b*size, (b+2)*size) overlap by half: every stretch of size diagonals lies in one
        b = diagonal // (2 * self.k[win] + 1)
        w, b, p = np.r_[win, win], np.r_[b, b - 1], np.r_[pos, pos]
        order = np.lexsort((p, b, w))
        w, b, p = w[order], b[order], p[order]
        i = np.arange(len(w))
        j = i + self.need[w] - 1
        i, j = i[j < len(w)], j[j < len(w)]
        ok = (w[j] == w[i]) & (b[j] == b[i]) & (p[j] - p[i] <= self.size[w[i]] - self.q)
        i, j = i[ok], j[ok]
        w, b, lo, hi = w[i], b[i], np.maximum(0, p[j] - self.size[w[i]] + self.q), np.minimum(p[i], self.len[w[i]] - self.size[w[i]])
        # both ends grow within a band: what the entry before has covered is left out
        same = (w[1:] == w[:-1]) & (b[1:] == b[:-1])
        lo[1:] = np.where(same, np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
        n = np.maximum(0, hi - lo + 1)
        return np.repeat(w, n), np.repeat(b, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def _aligned(self, c, w, band, s, rows: int = 2048) -> list[tuple[int, int, int, int, int]]:
        """(item's number, start in it, start, end, edits) of the windows within their edits, sorted by place."""
        out = []
        padded = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)])
        for size in np.unique(self.size[w]).tolist():
            of = np.nonzero(self.size[w] == size)[0]
            for x in range(0, len(of), rows):
                g = of[x : x + rows]
                k = int(self.k[w[g[0]]])
                pats = self.chars[(self.base[w[g]] + s[g])[:, None] + np.arange(size)]
                first = s[g] + band[g] * (2 * k + 1)
                edits, end = _banded_rows(pats, padded, first, 4 * k + 1, k, 1)
                fit = edits <= k
                g, end, edits = g[fit], (first + end)[fit], edits[fit]
                _, back = _banded_rows(pats[fit][:, ::-1], padded, end, 0, k, -1)
                out += zip(w[g].tolist(), s[g].tolist(), np.maximum(0, end - back).tolist(), np.minimum(len(c), end).tolist(), edits.tolist(), strict=True)
        return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def _banded_rows(pats: np.ndarray, padded: np.ndarray, at: np.ndarray, hi: int, k: int, way: int) -> tuple[np.ndarray, np.ndarray]:
    """banded() for a row of patterns each: least edits against the text that is read from at in
    direction way, starting 0 to hi characters on, and how far from at it ends; edits above k are k + 1.

    padded is the text with one character more on either side, which no pattern holds: beyond an end
    of the text a character is replaced for the same price as it is left out.
    """
    n, size = pats.shape
    far, width, small = k + 1, hi + 2 * k + 1, np.int8 if k < 60 else np.int16
    edits, end = np.full(n, far, np.int64), np.zeros(n, np.int64)
    # columns are patterns; the text of a step is that of the step before, moved by one row
    text = padded[np.clip(at + way * np.arange(-k, hi + k + size)[:, None] + (way > 0), 0, len(padded) - 1)]
    p, own = np.ascontiguousarray(pats.T), np.arange(n)
    row = np.full((width, n), far, small)
    row[k : k + hi + 1] = 0
    for i in range(size):
        v = row + (text[i : i + width] != p[i])
        np.minimum(v[:-1], row[1:] + small(1), out=v[:-1])
        e = 1
        while e <= k:
            np.minimum(v[e:], v[:-e] + small(e), out=v[e:])
            e *= 2
        row = np.minimum(v, small(far))
        if i % 8 == 7 and len(own):
            live = row.min(0) <= k
            if 4 * live.sum() < 3 * len(own):
                row, text, p, own = row[:, live], text[:, live], p[:, live], own[live]
    if len(own):
        j = row.argmin(0)
        edits[own], end[own] = row[j, np.arange(len(own))], j - k + size
    return edits, end


def places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normal form as spans of the text itself."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: positions of the lowered text
        text = low
    starts, ends, at = [], [], 0
    for m in _RUN.finditer(low):
        starts.append((at, m.start()))
        at += m.end() - m.start() + 1
    keys = np.array([a for a, _ in starts])
    out = []
    for a, b in spans:
        i, j = (max(0, int(np.searchsorted(keys, x, "right")) - 1) for x in (a, b - 1))
        out.append((starts[i][1] + a - starts[i][0], starts[j][1] + b - starts[j][0]))
    return out


_FOUND = "doc_id long, item_id long, start long, end long, edits int"


def _scan(index, chunk_chars: int = 1 << 20):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])

    def run(batches):
        idx = index.value

        def search(held):
            normals = [normal(t) for _, t in held]
            # no match crosses more zeros than it may have edits
            gap = int(idx.k.max(initial=0)) + 1
            whole = codes(("\0" * gap).join(normals))
            offs = np.cumsum([0, *(len(x) + gap for x in normals)])
            found = []
            for w, a, b, edits in idx.find(whole):
                i = int(np.searchsorted(offs, (a + b) // 2, "right")) - 1
                found.append((i, idx.items[w], max(0, a - int(offs[i])), min(b - int(offs[i]), len(normals[i])), edits))
            merged: dict[tuple, list] = {}
            for i, item, a, b, edits in sorted(found, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2:])):
                runs = merged.setdefault((i, item), [])
                if runs and a <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(b, runs[-1][1]), max(edits, runs[-1][2]))
                else:
                    runs.append((a, b, edits))
            for (i, item), runs in merged.items():
                for (a, b), (_, _, edits) in zip(places(held[i][1], [r[:2] for r in runs]), runs, strict=True):
                    yield held[i][0], item, a, b, edits

        def made():
            held, size = [], 0
            for batch in batches:
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if t:
                        held.append((d, t))
                        size += len(t)
                        if size >= chunk_chars:
                            yield from search(held)
                            held, size = [], 0
            if held:
                yield from search(held)

        yield from chunked(made(), schema)

    return run


def blocks(benchmark: DataFrame, block_chars: int):
    """Lists of (item_id, text) of bounded size, in order of item_id and text."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text or "")
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = 2_000_000, **settings) -> DataFrame:
    """doc_id, item_id, start, end (in the document's text), edits of every region that repeats an item."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks(benchmark, block_chars):
        part = slim.mapInArrow(_scan(spark.sparkContext.broadcast(Windows(block, **settings))), _FOUND)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], _FOUND) if out is None else out


def clean_only(docs: DataFrame, benchmark: DataFrame, block_chars: int = 2_000_000, **settings) -> DataFrame:
    """Rows of docs without any region of an item, all columns as they are; nothing is shuffled."""
    spark = docs.sparkSession
    for block in blocks(benchmark, block_chars):
        docs = docs.where(_clean(spark.sparkContext.broadcast(Windows(block, **settings)))(F.col("text").cast("string")))
    return docs


def _clean(index):
    import pandas as pd

    def run(texts):
        for text in texts:
            ids = pa.array(range(len(text)), pa.int64())
            batch = pa.RecordBatch.from_arrays([ids, pa.array([None if pd.isna(t) else t for t in text], pa.string())], ["doc_id", "text"])
            bad = {i for b in _scan(index)(iter([batch])) for i in b.column(0).to_pylist()}
            yield pd.Series([i not in bad for i in range(len(text))], dtype=bool)

    clean = tidy(run)
    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(clean, "boolean")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and item it repeats: number of regions, their characters, least edits."""
    docs = documents_only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(F.col("end") - F.col("start")).alias("n_chars"), F.min("edits").alias("least_edits"))
