"""Exact Jaccard join of word n-gram sets, with skipping by set relations.

1. Texts are cut into n-grams; of each set its size, a digest and the hashes of some of its parts
   (2.) are written. Sets that are equal become one class; copies never take part in the join. Whole
   sets are made again from the texts, and only for those that the last join ships (4.).
2. Sizes fall into spans. For a span, tokens (n-gram hashes) are dealt to a fixed number of parts by
   ranges of hash. Two sets that reach the threshold differ in at most d tokens, so at most d parts
   differ, and among the first d + 1 parts of both, in any order of parts that goes by what they
   hold, one is the same (prefix filter over parts). Parts with most tokens come first: sets meet
   by several tokens that agree, not by a single one, which unrelated texts share ever more often
   as tables grow. A set is dealt by its own span and by those of smaller sets it may link with.
3. All sets that hold a part give edges to the least of them; pairs are not listed.
4. Components of these candidate edges are the places where links can be. A component is cut into
   blocks of about ``block_tokens`` tokens in order of set size, and only blocks whose sizes can
   reach the threshold meet. What is in a block is joined there by ``links``: index lists are read
   in blocks of entries that are skipped by size and position, and the answers of a set that is
   close to one already answered are derived from that one's by the tokens in which they differ.
5. Blocks report a spanning forest and link counts, so links within a group of near copies are
   found without being listed.

The number and the order of parts only affect speed; any give the same links.

Defined cases: null texts and texts without words have empty sets, link with nothing and form
classes of their own; with fewer words than n the whole sequence is the one element; rows with
equal doc_id are one document, which is linked by the sets of all its rows (doc_ids are below
2**62); null doc_ids are reported but link with nothing; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, chunked, discard, documents_only, mix, none_marked, only_marked, rolling, rows, tidy, word_hashes, written
from .graph import components


def shingles(text: str | None, n: int = 4) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams (A-Z lowered)."""
    if not text:
        return np.zeros(0, np.uint64)
    ws = WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    if not ws:
        return np.zeros(0, np.uint64)
    h = word_hashes(ws)
    if len(ws) < n:
        return mix(rolling(h, len(ws)) ^ np.uint64(len(ws)))
    return np.unique(rolling(h, n))


def needed(a, b, pct: int):
    """Least intersection of sets of sizes a and b that reach pct percent."""
    return -(-(a + b) * pct // (100 + pct))


#: Sizes of sets fall into spans: the j-th ends with the j-th of these.
SPANS = [1]
while SPANS[-1] < 1 << 40:
    SPANS.append(2 * SPANS[-1])


def apart(a: int, b: int, pct: int) -> int:
    """Most tokens in which sets of sizes a and b differ that reach pct percent."""
    return (a + b) * (100 - pct) // (100 + pct)


def n_parts(span: int, pct: int) -> int:
    """How many parts sets of a span are dealt to: about 1.6 times as many as may differ."""
    top = SPANS[span]
    return max(apart(top, top * 100 // pct, pct) + 1, top * (100 - pct) * 32 // (pct * 25))


def parts(s: np.ndarray, pct: int) -> np.ndarray:
    """Hashes of those parts of a sorted set of which any set that reaches pct percent has one, too.

    The top byte of a hash falls with the number of tokens, the rest depends on span, part and tokens.
    """
    size, out = len(s), []
    if not size:
        return s
    own = bisect_left(SPANS, size)
    high = s >> _32
    for span in range(bisect_left(SPANS, -(-size * pct // 100)), own + 1):
        d = apart(size, size * 100 // pct if span == own else SPANS[span], pct)
        if not d:  # equal sets alone
            continue
        k = n_parts(span, pct)
        part = high * np.uint64(k) >> _32
        starts = np.concatenate((_FIRST, np.flatnonzero(part[1:] != part[:-1]) + 1))
        n = np.concatenate((starts[1:], [size])) - starts
        held = _held(np.add.reduceat(s, starts), part[starts], n, span)
        if len(held) <= d:  # parts without tokens come last
            lacks = np.setdiff1d(np.arange(k, dtype=np.uint64), part)
            held = np.concatenate((held, _held(np.zeros_like(lacks), lacks, 0, span)))
        out.append(np.partition(held, d)[: d + 1])
    return np.concatenate(out) if out else s[:0]


_32, _8, _FIRST = np.uint64(32), np.uint64(8), np.zeros(1, np.int64)


def _held(tokens: np.ndarray, part: np.ndarray, n, span: int) -> np.ndarray:
    few = (255 - np.minimum(n, 255)) << 56
    return mix(tokens + (part + np.uint64((span << 40) + 1)) * np.uint64(0x9E3779B97F4A7C15)) >> _8 | np.asarray(few).astype(np.uint64)


class Skipping:
    """Index over sets in order of size: whole lists by token, and lists of prefix tokens in blocks.

    Tokens are numbered by falling rarity, so prefixes hold the rarest. An entry of a prefix list is
    a set and the token's position in it; entries are ordered by set size, then position, and a
    block of them is known by its largest set and least position.
    """

    BLOCK = 16

    def __init__(self, sets: list[np.ndarray], pct: int):
        self.pct, self.sizes = pct, np.array([len(s) for s in sets], np.int64)
        n = len(sets)
        self.first = np.searchsorted(self.sizes, -(-self.sizes * pct // 100))  # smaller sets cannot link
        self.last = np.searchsorted(self.sizes, self.sizes * 100 // pct, "right")
        _, local, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        owner = np.repeat(np.arange(n), self.sizes)
        local = rank[local]
        order = np.lexsort((local, owner))
        self.mine = np.split(local[order], np.cumsum(self.sizes)[:-1])
        order = np.lexsort((owner, local))
        self.holders = owner[order]
        self.starts = np.searchsorted(local[order], np.arange(len(often) + 1))
        self.prefix = self.sizes - -(-self.sizes * pct // 100) + 1
        token = np.concatenate([m[:p] for m, p in zip(self.mine, self.prefix, strict=True)])
        held = np.repeat(np.arange(n), self.prefix)
        pos = np.arange(len(held)) - np.repeat(np.cumsum(self.prefix) - self.prefix, self.prefix)
        order = np.lexsort((held, pos, self.sizes[held], token))
        token, self.entry, self.pos = token[order], held[order], pos[order]
        self.lists = np.searchsorted(token, np.arange(len(often) + 1))
        number = np.arange(len(token)) - self.lists[token]
        self.heads = np.flatnonzero(number % self.BLOCK == 0)
        self.head_at = np.searchsorted(self.heads, self.lists)
        self.ends = np.append(self.heads[1:], len(token))
        size = self.sizes[self.entry]
        self.least, self.most = (f.reduceat(size, self.heads) for f in (np.minimum, np.maximum)) if len(token) else (size, size)
        self.least_pos = np.minimum.reduceat(self.pos, self.heads) if len(token) else self.pos
        self.mark = np.zeros(len(often), bool)
        self.read = self.skipped = self.derived = 0

    def candidates(self, i: int) -> np.ndarray:
        """Sets j < i that share a prefix token at positions that allow the overlap."""
        s, out = int(self.sizes[i]), []
        low = -(-s * self.pct // 100)
        for p, t in enumerate(self.mine[i][: self.prefix[i]].tolist()):
            a, b = self.lists[t], self.lists[t + 1]
            if b - a < 2:
                continue
            h = slice(self.head_at[t], self.head_at[t + 1])
            most, least = self.most[h], self.least[h]
            reach = 1 + np.minimum(s - p - 1, most - self.least_pos[h] - 1)
            fits = (most >= low) & (least <= s) & (reach >= needed(s, np.maximum(least, low), self.pct))
            for x, y in zip(self.heads[h][fits].tolist(), self.ends[h][fits].tolist(), strict=True):
                e = self.entry[x:y]
                size = self.sizes[e]
                ok = (e < i) & (size >= low) & (1 + np.minimum(s - p - 1, size - self.pos[x:y] - 1) >= needed(s, size, self.pct))
                out.append(e[ok])
                self.read += y - x
            self.skipped += int(b - a) - int((self.ends[h][fits] - self.heads[h][fits]).sum())
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def add(self, counts: np.ndarray, tokens, lo: int, hi: int, by: int = 1) -> None:
        """Counts of shared tokens with the sets from lo up to hi; the rest of each list is skipped."""
        if lo >= hi:
            return
        for t in tokens:
            x = self.holders[self.starts[t] : self.starts[t + 1]]
            if len(x) > 1:  # a list of one entry holds no other set
                a, b = x.searchsorted((lo, hi))
                counts[x[a:b]] += by
                self.read += int(b - a)
                self.skipped += len(x) - int(b - a)

    def overlap(self, i: int, js: np.ndarray) -> np.ndarray:
        self.mark[self.mine[i]] = True
        out = np.array([self.mark[self.mine[j]].sum() for j in js.tolist()], np.int64)
        self.mark[self.mine[i]] = False
        return out


def links(sets: list[np.ndarray], pct: int, left: np.ndarray | None = None, index: Skipping | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, linked j < i) over sets sorted by size; with left, only pairs of different sides.

    Sets are answered in order of their least hashes, which brings similar ones together. A set with
    many candidates keeps its counts against all sets of fitting size; a later set that differs from
    one of the last such sets by at most a quarter derives its own from them.
    """
    if not sets:
        return
    x = index or Skipping(sets, pct)
    n, kept = len(sets), []
    for i in sorted(range(n), key=lambda i: tuple(sets[i][:3].tolist())):
        lo = int(x.first[i])
        if lo >= i:
            continue
        own, size = x.mine[i], int(x.sizes[i])
        best = None
        x.mark[own] = True
        for r, counts in kept:
            shared = int(x.mark[x.mine[r]].sum())
            apart = size + int(x.sizes[r]) - 2 * shared
            if apart * 4 <= size and (best is None or apart < best[0]):
                best = apart, r, counts
        x.mark[own] = False
        if best:
            _, r, known = best
            a, b = max(lo, int(x.first[r])), min(i, int(x.last[r]))
            counts = np.zeros(n, np.int32)
            if a < b:
                counts[a:b] = known[a:b]
                x.add(counts, np.setdiff1d(own, x.mine[r], assume_unique=True).tolist(), a, b)
                x.add(counts, np.setdiff1d(x.mine[r], own, assume_unique=True).tolist(), a, b, -1)
                x.add(counts, own.tolist(), lo, min(a, i))
                x.add(counts, own.tolist(), max(b, lo), i)
            else:
                x.add(counts, own.tolist(), lo, i)
            x.derived += 1
            j, c = np.arange(lo, i), counts[lo:i]
        else:
            j = x.candidates(i)
            if len(j) > 48:
                counts = np.zeros(n, np.int32)
                x.add(counts, own.tolist(), lo, int(x.last[i]))
                kept = [*kept[-7:], (i, counts)]
                c = counts[j]
            else:
                c = x.overlap(i, j)
        j = j[c * (100 + pct) >= (size + x.sizes[j]) * pct]
        if left is not None:
            j = j[left[j] != left[i]]
        if len(j):
            yield i, j


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _sets(n: int, pct: int | None = None):
    """Size, digest and tokens of each text's set; with pct the hashes of its parts in place of tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        def made():
            for d, text in rows(batches, "doc_id", "text"):
                s = shingles(text, n)
                held = s.tobytes()
                s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(held), "<i8").tolist()
                yield d, len(s), s1, s2, held if pct is None else parts(s, pct).tobytes()

        yield from chunked(made(), schema, 2000)

    return run


_SETS = "doc_id long, size long, s1 long, s2 long, tokens binary"


def _spread(batches):
    """part, id of every part that rows (doc_id, tokens) hold."""
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            ids, held = (b.column(c).slice(i, 1000) for c in (0, 1))
            held = held.to_pylist()
            part = np.frombuffer(b"".join(held), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.repeat(ids.to_numpy(), [len(x) // 8 for x in held]))], names=["part", "id"])


def _classes(sig: DataFrame) -> DataFrame:
    """class_id, lead, s1, s2, size of each distinct set; lead is its least doc_id.

    class_id is lead; where rows of one doc_id lead several sets, the others get a hash from 2**62 on.
    """
    sets = sig.where("size > 0").groupBy("s1", "s2", "size").agg(F.min("doc_id").alias("lead"))
    several = sets.groupBy("lead").agg(F.min("s1").alias("one"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("lead").alias("of"), "one")
    other = F.shiftrightunsigned(F.xxhash64("s1", "s2", "size"), 2).bitwiseOR(1 << 62)
    named = sets.join(several.hint("merge"), F.col("lead") == F.col("of"), "left")
    return named.select(F.when(F.col("one") != F.col("s1"), other).otherwise(F.col("lead")).alias("class_id"), "lead", "s1", "s2", "size")


def _blocks(placed: DataFrame, block_tokens: int) -> DataFrame:
    """placed with the block of each class in its component: by size, about block_tokens tokens each.

    Only one row per component and set size goes through the window.
    """
    by_size = placed.groupBy("component", "size").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("component").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sized = by_size.select(F.col("component").alias("of"), F.col("size").alias("each"), "n", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)).alias("before"))
    j = placed.join(sized, (placed["component"] == F.col("of")) & (placed["size"] == F.col("each")))
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("id"), F.col("n")) * F.col("size")) / block_tokens)
    return j.select("id", "component", "size", "lead", "s1", at.cast("int").alias("at"))


def _meetings(cut: DataFrame, pct: int) -> DataFrame:
    """Where each class is needed: pairs of blocks (i <= j) of a component whose sizes can reach pct."""
    spans = cut.groupBy("component", "at").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    a, b = (spans.select(F.col("component").alias(f"c{x}"), F.col("at").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ij")
    pairs = a.join(b, (F.col("ci") == F.col("cj")) & (F.col("i") <= F.col("j")) & (F.col("high_i") * 100 >= F.col("low_j") * pct)).select("ci", "i", "j")
    ends = pairs.select(F.col("ci").alias("c"), "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("own"))
    met = cut.join(ends, (F.col("component") == F.col("c")) & (F.col("at") == F.col("own")))
    return met.select("c", "i", "j", F.when(F.col("own") == F.col("i"), 0).otherwise(1).alias("side"), "id", "size", F.col("lead").alias("of"), F.col("s1").alias("h"))


def set_links(docs: DataFrame, n: int = 4, pct: int = 85, small: int = 24, block_tokens: int = 1 << 19, least_frequent: int = 12, most_frequent: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, links and bridges of docs (doc_id, text), which is read twice.

    First table: doc_id, size, class_id, lead (least doc_id with an equal set). Second: class_id, to
    (links of a spanning forest; null for rows that only count), n_links (links of class_id to
    other classes that the row stands for). Third: u, v: classes that rows of one doc_id lead.
    small, least_frequent and most_frequent were settings of a join by single tokens; they have no effect.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(slim.mapInArrow(tidy(_sets(n, pct), "words"), _SETS), "sets")
    sig = sets.select("doc_id", "size", "s1", "s2")
    classes = written(_classes(sig), "classes")
    names = classes.select("class_id", "lead", F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("size").alias("t3"))
    same = (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("size") == F.col("t3"))
    members = written(sig.join(names.hint("merge"), same, "left").select("doc_id", "size", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("size") > 0, F.col("lead")).otherwise(F.col("doc_id")).alias("lead")), "members")

    # parts of one document per class, and of a few copies that the marks let pass; a copy is never
    # the least of its part, as its lead holds the same ones
    leads = classes.select(F.col("lead").alias("id"))
    spread = only_marked(sets.where("size > 0 and doc_id is not null").select("doc_id", "tokens"), "doc_id", leads).mapInArrow(tidy(_spread), "part long, id long")
    least = F.first("id").over(Window.partitionBy("part").orderBy("id"))
    edges = spread.select(F.col("id").alias("u"), least.alias("v")).where("u <> v").distinct()
    place = components(edges.join(leads.hint("merge"), F.col("u") == F.col("id"), "left_semi"))
    discard(sets)
    placed = written(classes.select(F.col("class_id").alias("id"), "lead", "s1", "size").join(place.withColumnRenamed("id", "of"), F.col("lead") == F.col("of")).drop("of"), "placed")

    met = _meetings(_blocks(placed, block_tokens), pct)
    near_sets = only_marked(slim, "doc_id", placed.select(F.col("lead").alias("id"))).mapInArrow(tidy(_sets(n), "words"), _SETS).select("doc_id", "s1", "tokens")
    shipped = near_sets.join(met.hint("merge"), (near_sets["doc_id"] == F.col("of")) & (near_sets["s1"] == F.col("h"))).select("c", "i", "j", "side", "id", "size", "tokens")

    def join_block(table: pa.Table) -> pa.Table:
        kept = {}  # repeated rows of a doc_id have equal sets here
        for r in zip(*(table.column(x).to_pylist() for x in ("size", "id", "side", "tokens")), strict=True):
            kept[r[1]] = r
        kept = sorted(kept.values(), key=lambda r: r[:2])
        sets_ = [np.frombuffer(r[3], np.uint64) for r in kept]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = np.array([r[2] for r in kept]) if i != j else None
        forest, degree, out = _Forest(len(kept)), np.zeros(len(kept), np.int64), []
        for x, ys in links(sets_, pct, side):
            degree[x] += len(ys)
            degree[ys] += 1
            out += [(kept[x][1], kept[int(y)][1], 0) for y in ys if forest.join(x, int(y))]
        out += [(kept[x][1], None, int(degree[x])) for x in np.nonzero(degree)[0]]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"class_id": pa.array(cols[0], pa.int64()), "to": pa.array(cols[1], pa.int64()), "n_links": pa.array(cols[2], pa.int64())})

    found = written(shipped.groupBy("c", "i", "j").applyInArrow(join_block, "class_id long, to long, n_links long"), "links")
    return members, found, classes.where("class_id <> lead").select(F.col("class_id").alias("u"), F.col("lead").alias("v"))


def set_components(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links (to classes of other sets) of every row."""
    members, found, bridges = set_links(docs, **settings)
    comp = components(found.where("to is not null").select(F.col("class_id").alias("u"), F.col("to").alias("v")).unionAll(bridges))
    degree = found.where("to is null").groupBy("class_id").agg(F.sum("n_links").alias("n_links")).withColumnRenamed("class_id", "c")
    out = members.join(comp, members["class_id"] == F.col("id"), "left").join(degree, members["class_id"] == F.col("c"), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "lead").alias("component_id"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """Rows of docs that are the least doc_id of their component; documents without words stay.

    docs is read twice more. Texts stay where they lie: what is not marked as gone passes, and only
    the few kept rows whose mark is that of one that goes are joined.
    """
    least = F.max((F.col("doc_id") == F.col("component_id")).cast("int"))
    own = written(set_components(docs, **settings).where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(least.alias("stays")), "own")
    gone = own.where("stays = 0").select("id")
    late = written(only_marked(own.where("stays = 1").select("id"), "id", gone), "late")
    named = docs.withColumn("_set_join_id", F.col("doc_id").cast("long"))
    doubtful = only_marked(only_marked(named, "_set_join_id", gone), "_set_join_id", late)
    right = doubtful.join(late.withColumnRenamed("id", "_set_join_keep"), F.col("_set_join_id") == F.col("_set_join_keep"), "left_semi")
    return none_marked(named, "_set_join_id", gone).unionAll(right).drop("_set_join_id")


def op10_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return set_components(docs).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, t FROM (
        SELECT doc_id, array_to_string(w[i:i+3], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n, sum(hash(t)::HUGEINT % 1000000007) AS h FROM s GROUP BY doc_id),
sh AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM sh JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, o) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a),
m AS (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id),
k AS (SELECT e.a AS doc_id, count(DISTINCT (y.n, y.h)) AS n_links FROM e JOIN n x ON x.doc_id = e.a JOIN n y ON y.doc_id = e.b WHERE (x.n, x.h) <> (y.n, y.h) GROUP BY e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.o, d.doc_id))::BIGINT AS component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""
