"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

Each distinct line of at least ``min_chars`` characters is cut into max_edits + 1 segments. Two
lines within max_edits edits share, at nearly the same place, one segment of the shorter line.
The shorter side is an index of (length, segment number, segment hash); the longer side probes it
with the substrings that the length difference and segment number leave possible. Lines that meet,
and whose letter counts allow it, are verified by edit distance in a band of 2 * max_edits + 1
diagonals, kept as bits of a word and moved one character at a time.

A line occurrence goes if the same text occurred earlier, or if a different text within max_edits
edits occurs first somewhere earlier. Shorter lines go only as exact repeats. Lines are judged on
the input, so the result does not depend on what else goes.

The question asked is "is there an earlier line near this one", so no table of pairs is made:

1. Equal lines are folded to their first place, combined before the shuffle.
2. Index keys are folded to (key, number of lines, one of them); each probe meets that one row.
   What is left are the members of keys that two lines share.
3. The members of a key are dealt to blocks of bounded size. A line asks one block of each of its
   keys first, in one expression that ends at the first earlier line within reach; lines without an
   answer ask the other blocks. A question makes one row, or none.
4. First places that are not late are what stays; they go back to their documents by row, never by
   the hash of a line that very many documents share.

Defined cases: a null text stays null; lines without a word are never touched; a text whose lines
all go is empty. Earlier means smaller doc_id (null before all), then smaller hash of the text, then
smaller line number; rows with equal doc_id are told apart by their texts, and rows that are equal
in both are one row in several copies and come back alike. An empty table gives an empty result;
other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, only_marked, written

_LETTERS = ("entairoslhdc", "upmgvfbywqkx")
_BITS = 5
_WORD = r"[^\x20\x09-\x0D]"
_PER_WORD = 62


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """1-based start and size of segment i of a line of n characters; the last takes the rest."""
    size = F.floor(n / parts).cast("int")
    return (F.lit(1) + i * size), (size if i < parts - 1 else n - i * size)


def index_keys(line: Column, n: Column, max_edits: int) -> Column:
    parts = max_edits + 1
    return F.array(*(F.xxhash64(F.lit(i), n, F.substr(line, *_segment(n, i, parts))) for i in range(parts)))


def probe_keys(line: Column, n: Column, max_edits: int) -> Column:
    """Keys of all substrings that may equal a segment of a line up to max_edits shorter.

    In front of segment i (from 0) lie i edits at most and behind it max_edits - i, which bounds
    how far the substring may stand from the segment's own place. The line's own index keys come
    first.
    """
    own, others = [], []
    for d in range(max_edits + 1):
        other = n - d
        for i in range(max_edits + 1):
            start, size = _segment(other, i, max_edits + 1)
            for shift in range(-i, i + 1):
                if abs(shift - d) <= max_edits - i:
                    (others if d or shift else own).append(F.xxhash64(F.lit(i), other, F.substr(line, start + shift, size)))
    return F.array(*own, *others)


def letter_bag(line: Column, letters: str = _LETTERS[0]) -> Column:
    """Counts of twelve letters, five bits each (modulo 32)."""
    n = F.octet_length(line)
    out = F.lit(0).cast("long")
    for i, c in enumerate(letters):
        count = (n - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND((1 << _BITS) - 1).cast("long")
        out = out.bitwiseOR(F.shiftleft(count, _BITS * i))
    return out


def _bag_gap(a: Column, b: Column) -> Column:
    total, mask = F.lit(0), (1 << _BITS) - 1
    for i in range(len(_LETTERS[0])):
        d = F.abs(F.shiftrightunsigned(a, _BITS * i).bitwiseAND(mask) - F.shiftrightunsigned(b, _BITS * i).bitwiseAND(mask))
        total = total + F.least(d, mask + 1 - d)
    return total


def bags_near(a: Column, b: Column, max_edits: int) -> Column:
    """True wherever two lines may be within max_edits edits: an edit moves two counts by one."""
    return _bag_gap(a, b) <= 2 * max_edits


def within(a: Column, b: Column, max_edits: int) -> Column:
    """Whether a and b are within max_edits edits, by a banded bit-parallel automaton.

    Bit s of word e says that the characters of a read so far can become b up to s - max_edits
    characters further with e edits. A character of a moves all diagonals of the band at once:
    a match keeps a bit, a substitution takes it to the next word, a deletion also shifts it down
    and an insertion up.
    """
    k, width = max_edits, 2 * max_edits + 1
    band = (1 << width) - 1
    x, y = (F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)) for c in (a, b))
    z = F.array_repeat(F.lit(None).cast("string"), k)
    pairs = F.struct(x.alias("x"), F.concat(z, y).alias("y"))

    def step(r: Column, i: Column, p: Column) -> Column:
        c = F.get(p["x"], i)
        eq = F.lit(0)
        for s in range(width):
            eq = eq + F.when(F.get(p["y"], i + s) == c, 1 << s).otherwise(0)
        new = []
        for e in range(k + 1):
            v = r[f"r{e}"].bitwiseAND(eq)
            if e:
                v = v.bitwiseOR(r[f"r{e - 1}"]).bitwiseOR(F.shiftright(r[f"r{e - 1}"], 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(band)
            new.append(v)
        return F.struct(*(v.alias(f"r{e}") for e, v in enumerate(new)))

    first = F.struct(*(F.lit(sum(1 << (k + j) for j in range(e + 1))).alias(f"r{e}") for e in range(k + 1)))
    gap = F.length(b) - F.length(a)

    def run(p: Column) -> Column:
        n = F.size(p["x"])
        last = F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), first, lambda r, i: step(r, i, p), lambda r: r[f"r{k}"])
        return last

    # one evaluation of the character arrays per pair
    final = F.element_at(F.transform(F.array(pairs), run), 1)
    return F.coalesce((F.abs(gap) <= k) & (F.call_function("shiftright", final, F.greatest(F.lit(0), gap + k)).bitwiseAND(1) == 1), F.lit(False))


def row_place(doc_id: Column, text: Column) -> Column:
    """The place of a row's first line as one number, which hash aggregation can hold.

    doc_id, 30 bits of the text's hash and 31 bits for line numbers; where doc_id is null, the whole
    hash stands for it, below all doc_ids.
    """
    h = F.xxhash64(text)
    doc = F.when(doc_id.isNull(), h.cast("decimal(20,0)") - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(doc_id.cast("decimal(20,0)"))
    low = F.shiftleft(F.shiftrightunsigned(h, 34), 31)
    return (doc * F.lit(1 << 61).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def lines_of(docs: DataFrame) -> DataFrame:
    """place, line: trimmed lines that hold a word."""
    cut = docs.select(row_place(F.col("doc_id"), F.col("text")).alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return cut.select((F.col("row") + F.col("n")).cast("decimal(38,0)").alias("place"), F.trim("line").alias("line")).where(F.col("line").rlike(_WORD))


def shared_keys(lines: DataFrame, max_edits: int) -> DataFrame:
    """key, id, own: lines (ids) of each key that two lines share; own where it is an index key of the line."""
    n = F.length("line")
    # the lowest bit of an id is free for own; lines with equal ids are told apart by their texts
    ids = lines.select(F.shiftleft(F.xxhash64("line"), 1).alias("id"), "line", n.alias("n"))
    index = ids.select("id", F.explode(index_keys(F.col("line"), F.col("n"), max_edits)).alias("key"))
    index = index.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("one"))
    probe = ids.select("id", F.posexplode(probe_keys(F.col("line"), F.col("n"), max_edits)).alias("pos", "key"))
    probe = probe.select("key", F.col("id").bitwiseOR((F.col("pos") <= max_edits).cast("long")).alias("id"))
    met = probe.join(index.hint("shuffle_hash"), "key").where((F.col("c") > 1) | (F.col("one") != F.shiftleft(F.shiftright("id", 1), 1)))
    members = met.select("key", F.explode(F.when(F.col("c") == 1, F.array("id", F.col("one").bitwiseOR(1))).otherwise(F.array("id"))).alias("id"))
    return members.distinct().select("key", F.shiftright("id", 1).alias("id"), (F.col("id").bitwiseAND(1) == 1).alias("own"))


def late_lines(lines: DataFrame, max_edits: int, block: int = 64) -> DataFrame:
    """Places of lines (place, line) that have a different line within max_edits edits at a smaller place."""
    keys = written(shared_keys(lines, max_edits), "keys")
    sizes = keys.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sized = keys.join(sizes, "key").withColumnRenamed("id", "of")
    named = lines.withColumn("id", F.shiftright(F.shiftleft(F.xxhash64("line"), 1), 1))
    texts = only_marked(named, "id", keys).join(sized.hint("shuffle_hash"), F.col("id") == F.col("of"))
    bags = [letter_bag(F.col("line"), x).alias(f"bag{i}") for i, x in enumerate(_LETTERS)]
    at = F.pmod(F.xxhash64("place", "key"), F.col("blocks")).cast("int").alias("at")
    asked = written(texts.select("key", "own", "blocks", at, "place", F.length("line").alias("n"), *bags, "line"), "asked")
    held = ["own", "place", "n", "bag0", "bag1", "line"]
    held_in = asked.groupBy("key", "at").agg(F.collect_list(F.struct(*held)).alias("held"))

    def near(m: Column) -> Column:
        may = (m["place"] < F.col("place")) & (m["own"] | F.col("own")) & (F.abs(m["n"] - F.col("n")) <= max_edits)
        may = may & (m["line"] != F.col("line"))
        may = may & (_bag_gap(m["bag0"], F.col("bag0")) + _bag_gap(m["bag1"], F.col("bag1")) <= 2 * max_edits)
        return may & within(m["line"], F.col("line"), max_edits)

    def answered(asker: DataFrame, name: str) -> DataFrame:
        return written(asker.join(held_in, ["key", "at"]).where(F.exists("held", near)).select("place").distinct(), name)

    first = answered(asked, "late")
    left = asked.where("blocks > 1").join(first.hint("merge"), "place", "left_anti")
    others = left.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("to") != F.col("at"))
    second = answered(others.drop("at").withColumnRenamed("to", "at"), "late")
    return first.unionAll(second)


def kept_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 20) -> DataFrame:
    """row, kept: numbers of the lines with a word that stay, for rows that keep any."""
    seen = written(lines_of(docs).groupBy("line").agg(F.min("place").alias("place")), "lines")
    late = late_lines(seen.where(F.length("line") >= min_chars), max_edits)
    first = seen.select("place").join(late.hint("shuffle_hash"), "place", "left_anti")
    n = F.pmod("place", F.lit(1 << 31).cast("decimal(38,0)")).cast("int")
    return first.select((F.col("place") - n).cast("decimal(38,0)").alias("row"), n.alias("n")).groupBy("row").agg(F.collect_list("n").alias("kept"))


def _joined(text: Column, kept: Column) -> Column:
    """text with the lines that have no word or whose numbers are in kept; numbers become bits of words first."""
    lines = F.split(text, "\n", -1)

    def word(j: Column) -> Column:
        mine = F.filter(kept, lambda x: F.floor(x / _PER_WORD) == j)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x % _PER_WORD)))

    words = F.transform(F.sequence(F.lit(0), F.floor(F.size(lines) / _PER_WORD).cast("int")), word)

    def stays(w: Column, x: Column, i: Column) -> Column:
        bit = F.call_function("shiftright", F.get(w, F.floor(i / _PER_WORD).cast("int")), i % _PER_WORD).bitwiseAND(1)
        return (bit == 1) | ~x.rlike(_WORD)

    out = F.transform(F.array(F.struct(lines.alias("lines"), words.alias("words"))), lambda p: F.array_join(F.filter(p["lines"], lambda x, i: stays(p["words"], x, i)), "\n"))
    return F.element_at(out, 1)


def dedup_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 20) -> DataFrame:
    """docs with the lines that go taken out of text; all columns and rows stay."""
    kept = kept_lines(documents_only(docs, "doc_id", "text"), max_edits, min_chars)
    kept = kept.select(F.col("row").alias("_line_dedup_row"), F.col("kept").alias("_line_dedup_kept"))
    own = row_place(docs["doc_id"], docs["text"])
    j = docs.join(kept.hint("shuffle_hash"), own == F.col("_line_dedup_row"), "left")
    text = _joined(docs["text"], F.coalesce("_line_dedup_kept", F.array().cast("array<int>")))
    return j.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = dedup_lines(docs.select("doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines")))
    n_kept = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("doc_id", "n_lines", F.length("text").cast("long").alias("kept_chars"), n_kept.cast("long").alias("n_kept"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH li AS (SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
l AS (SELECT doc_id, n, raw, trim(raw, ' ') AS line FROM li),
f AS (SELECT line, min((doc_id, n)) AS first, length(line) AS len FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
p AS (SELECT a.line FROM f a JOIN f b ON b.len BETWEEN a.len - 2 AND a.len + 2 AND a.len >= 20 AND b.len >= 20 AND b.first < a.first AND a.line <> b.line
      AND (substr(a.line, 1, a.len // 3) = substr(b.line, 1, a.len // 3) OR right(a.line, a.len // 3) = right(b.line, a.len // 3)
           OR contains(b.line, substr(a.line, 1 + a.len // 3, a.len // 3)))
      AND levenshtein(a.line, b.line) <= 2 GROUP BY a.line),
k AS (SELECT doc_id, n, raw, NOT (f.line IS NOT NULL AND (p.line IS NOT NULL OR (doc_id, n) <> f.first)) AS keep
      FROM l LEFT JOIN f USING (line) LEFT JOIN p USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (coalesce(keep, true)), '') AS t FROM k GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, length(t)::BIGINT AS kept_chars,
       (CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END)::BIGINT AS n_kept, sha256(t) AS kept_sha256 FROM g
"""
