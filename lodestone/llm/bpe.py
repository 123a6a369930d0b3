"""Byte-level BPE: whole texts to ids by a priority queue of merges, and ids back to text.

A text is cut at the vocabulary's special strings and then by the pattern of byte-level
vocabularies. The bytes of a piece are the symbols of a doubly linked list. A heap holds the rank
and place of every neighbouring pair that merges; the best one is taken (least rank, then the
leftmost), its right symbol leaves the list and the two new pairs enter the heap. An entry whose
symbols have changed since is stale and is skipped, so nothing is searched for or deleted: a piece
of n bytes costs n log n, even one that is a whole long text. Decoding concatenates the byte
strings of the ids and reads the whole as UTF-8.

Documents are encoded where they lie: no shuffle, no key, nothing on the driver but the path of the
vocabulary file. A worker keeps the ids of the short pieces that it has met last, 800 000 at most
(about 200 MB); ids never depend on that memo.

The pattern asks which code points are letters, digits or spaces. Where Python's classes are not
those of the library (numbers that are no decimal digits, such as fractions, separators of
information, code points that are younger than Python's tables), the library cuts the text.

Defined cases: a null text is an empty text (no ids, decoded as empty); a null list of ids decodes
as empty, ids outside the vocabulary decode as nothing, bytes that are no UTF-8 as U+FFFD, both as
the library does; null doc_ids and repeated rows are encoded row by row; very long texts are
encoded whole; empty tables give empty results; further columns are ignored by encoded() and kept
by decoded(), whatever their names.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only
from .encoding import _BYTE_CHARS, vocabulary

#: How byte-level vocabularies cut texts: letters, digits and other signs with a space before them,
#: endings after an apostrophe, white space.
PIECES = r" ?[^\W\d_]++| ?\d++|'(?:[sdmt]|ll|ve|re)| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+"


class _Met(dict):
    """piece -> ids of the pieces met since it was made; older holds those met before. Long pieces are not kept."""

    def __init__(self, make, longest: int, older: dict):
        super().__init__()
        self._make, self._longest, self._older = make, longest, older
        if isinstance(older, _Met):
            older._older = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._older.get(piece) or self._make(piece)
        if len(piece) <= self._longest:
            self[piece] = ids
        return ids


def _alike(c: str) -> bool:
    """Whether c is a letter, a digit, white space or none of them to Python's patterns and to the library alike."""
    kind = unicodedata.category(c)
    if kind == "Cn":
        return False
    by_tables = "space" if kind[0] == "Z" or c in "\t\n\x0b\x0c\r\x85" else "letter" if kind[0] == "L" else "digit" if kind[0] == "N" else "sign"
    by_pattern = "space" if c.isspace() else "digit" if c.isdecimal() else "letter" if c.isalnum() else "sign"
    return by_tables == by_pattern


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, most: int = 400_000, longest: int = 64):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        self._path, self._most, self._longest = path, most, longest
        vocab = model["vocab"]
        chars = {chr(b): b for b in range(256) if b not in _BYTE_CHARS} | {chr(c): b for b, c in _BYTE_CHARS.items()}
        byte_ids = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        self._byte_ids = bytes(byte_ids) if max(byte_ids) < 256 else byte_ids
        self._shift, self._ranks, self._made = max(vocab.values()).bit_length(), {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._ranks[vocab[a] << self._shift | vocab[b]] = rank
            self._made.append(vocab[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that match by their surroundings")
        self._special = {s: np.array([i], "<u4").tobytes() for s, i in added.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._ascii, self._pieces = re.compile(PIECES, re.ASCII).findall, re.compile(PIECES).findall
        self._strings = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for s, i in vocab.items():
            self._strings[i] = bytes(chars[c] for c in s) if all(c in chars for c in s) else s.encode()
        for s, i in added.items():
            self._strings[i] = s.encode()
        self._memo = _Met(self._of_piece, longest, {})
        self._known: set[str] = set()
        self._library = None

    def merged(self, symbols: list[int]) -> list[int]:
        """Ids of a piece from the ids of its bytes. Entries of the heap are rank << 32 | place."""
        n, rank_of, shift, made = len(symbols), self._ranks.get, self._shift, self._made
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(a << shift | b)) is not None]
        if not heap:
            return symbols
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            a, j = symbols[i], after[i]
            if a < 0 or j >= n or rank_of(a << shift | symbols[j]) != entry >> 32:
                continue  # stale
            symbols[i] = new = made[entry >> 32]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << shift | symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (k := before[i]) >= 0 and (r := rank_of(symbols[k] << shift | new)) is not None:
                heappush(heap, r << 32 | k)
        return [s for s in symbols if s >= 0]

    def _of_piece(self, piece: str) -> bytes:
        held, at = piece.encode("utf-8", "surrogatepass"), self._byte_ids
        return array("I", self.merged(list(held.translate(at)) if isinstance(at, bytes) else [at[b] for b in held])).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self._cut is None or not any(s in text for s in self._special):
            return self._plain(text)
        return b"".join(self._special.get(x) or self._plain(x) for x in self._cut.split(text))

    def _plain(self, text: str) -> bytes:
        memo = self._memo
        if len(memo) > self._most:
            memo = self._memo = _Met(self._of_piece, self._longest, memo)
        pieces = self._ascii(text) if text.isascii() else self._by_library(text) if self._odd(text) else self._pieces(text)
        return b"".join(map(memo.__getitem__, pieces))

    def _odd(self, text: str) -> bool:
        """Whether text has a code point that Python's classes hold for something else than the library."""
        new = set(text).difference(self._known)
        if not all(map(_alike, new)):
            return True
        self._known |= new
        return False

    def _by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return [text[i:j] for _, (i, j) in self._library.pre_tokenize_str(text)]

    def decode(self, ids: list[int]) -> str:
        strings = self._strings
        try:
            held = b"".join(map(strings.__getitem__, ids))
        except IndexError:
            held = b"".join(strings[i] for i in ids if i < len(strings))
        return held.decode("utf-8", "replace")


_open: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """One instance per worker and vocabulary."""
    if path not in _open:
        _open[path] = Bpe(path)
    return _open[path]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encoded(docs: DataFrame, path: str, most_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, ids array<int>: one row for each row of docs (doc_id, text)."""

    def batch(doc_ids: list, held: list[bytes]) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(held), "<i4")))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids], schema=_ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        doc_ids, held, size = [], [], 0
        for part in batches:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                doc_ids.append(doc_id)
                held.append(b.encode(text.as_py() or ""))
                size += len(held[-1])
                if size >= most_bytes:
                    yield batch(doc_ids, held)
                    doc_ids, held, size = [], [], 0
        if doc_ids:
            yield batch(doc_ids, held)

    slim = documents_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the column ids (array<int>) replaced by the text that it stands for."""
    kept = [c for c in rows.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for part in batches:
            lists = pc.fill_null(part.column(part.num_columns - 1), [])
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).tolist()
            odd = len(flat) > 0 and int(flat.min()) < 0
            own = (flat[i:j] for i, j in itertools.pairwise(starts))
            texts = pa.array([b.decode((x[x >= 0] if odd else x).tolist()) for x in own], pa.string())
            columns = [part.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, texts], names=[*kept, text])

    last = rows.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids}`").cast("array<int>"))
    schema = last.drop(ids).schema.add(text, "string")
    return last.mapInArrow(run, schema)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    got = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    shown = got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return decoded(shown, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
