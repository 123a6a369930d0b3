"""Quality rules with cross-document line frequency.

Each document is judged twice: by counts within its text (too few words, too many words in
repeated 5-word windows) and by how much of it is left once lines are gone that stand in many
documents of the same host.

Lines are normalised (lower case, digits to 0, white space collapsed) and hashed to 64 bits. One
row per (host, document, line) is counted by (host, line): Spark counts partially before the
shuffle, so a line that a third of all documents share costs one row per task. The rows of
frequent lines are joined back to the documents; adaptive execution splits skewed keys there.

Defined cases: a null text is an empty text (0 words, base_failed). A null doc_id or host is a
value of its own. Rows with equal doc_id and host count as one document in frequencies and are
each judged on their own text. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, documents_only, rolling, rows, word_chars, word_hashes, words, written

SYMBOLS = "#*$%&|<>"
_SPACE, _DIGIT = re.compile(r"\s+"), re.compile(r"\d")


def normal_line(line: str) -> str:
    return _DIGIT.sub("0", _SPACE.sub(" ", line).strip().lower())


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a normalised line."""
    h = xxhash.xxh3_64_intdigest(normal_line(line).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def base_counts(text: str | None, window: int = 5) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    ws = words(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line and words(line[:64] if len(line) > 64 and words(line[:64]) else line):
            seen.add(line)
    n_repeat = 0
    if len(ws) > window:
        h = rolling(word_hashes(ws), window)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.zeros(len(s), bool)
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        if same.any():
            edge = np.zeros(len(ws) + 1, np.int64)
            starts = order[same]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            n_repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    return len(ws), word_chars(text), sum(map(text.count, SYMBOLS)), dup, n_repeat


def _profile(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))])

    def made():
        for doc_id, text, host in rows(batches, "doc_id", "text", "host"):
            by: dict[int, int] = {}
            for line in (text or "").split("\n"):
                if n := len(words(line)):
                    k = line_hash(line)
                    by[k] = by.get(k, 0) + n
            yield (doc_id, host, *base_counts(text), list(by), list(by.values()))

    yield from chunked(made(), schema, 5000)


_PROFILE = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def frequent_lines(profiles: DataFrame, max_docs: int) -> DataFrame:
    """(host, line, n_docs) of lines that more than max_docs documents of a host hold."""
    per_doc = profiles.select("host", "doc_id", F.explode("lines").alias("line")).distinct()
    return per_doc.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)


def line_frequency_rules(docs: DataFrame, max_docs: int = 20, min_words: int = 10, max_repeat_pct: int = 20, max_removed_share: float = 0.5, host: str = "source") -> DataFrame:
    """One row per row of docs: counts, base_failed, words in removed lines, kept, and removed line hashes.

    A document that passes the base rules is depleted, and so not kept, if fewer than min_words
    words are left without its frequent lines, or if those lines hold more than
    max_removed_share of its words.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(f"`{host}`").cast("string").alias("host"))
    p = written(slim.mapInArrow(_profile, _PROFILE), "profiles")
    found = written(frequent_lines(p, max_docs), "frequent")
    pairs = p.select("host", "doc_id", F.posexplode("lines").alias("at", "line"), "line_words").select("host", "doc_id", "line", F.element_at("line_words", F.col("at") + 1).alias("words"))
    hit = pairs.join(found.select("host", "line"), pairs["host"].eqNullSafe(found["host"]) & (pairs["line"] == found["line"])).select(pairs["doc_id"], pairs["host"], pairs["line"], "words")
    gone = hit.groupBy("doc_id", "host").agg(F.collect_set("line").alias("removed_lines")).select(F.col("doc_id").alias("g_doc"), F.col("host").alias("g_host"), "removed_lines")
    out = p.join(gone, p["doc_id"].eqNullSafe(F.col("g_doc")) & p["host"].eqNullSafe(F.col("g_host")), "left")
    removed = F.coalesce(F.col("removed_lines"), F.array().cast("array<long>"))
    n_removed = F.aggregate(F.zip_with("lines", "line_words", lambda a, b: F.when(F.array_contains(removed, a), b).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    out = out.withColumn("removed_words", n_removed).withColumn("base_failed", failed)
    depleted = (F.col("n_words") - F.col("removed_words") < min_words) | (F.col("removed_words") > max_removed_share * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", removed.alias("removed_lines"))


def cleaned(docs: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Kept documents with the frequent lines taken out of their texts (same columns as docs)."""
    v = verdicts.where("kept").select(F.col("doc_id").alias("_rules_doc"), F.col("host").alias("_rules_host"), F.col("removed_lines").alias("_rules_lines")).dropDuplicates(["_rules_doc", "_rules_host"])

    import pandas as pd

    def strip(text: pd.Series, gone: pd.Series) -> pd.Series:
        def one(t, g):
            if t is None or g is None or not len(g):
                return t
            g = set(int(x) for x in g)
            return "\n".join(x for x in t.split("\n") if not words(x) or line_hash(x) not in g)

        return pd.Series([one(t, g) for t, g in zip(text, gone, strict=True)])

    strip.__annotations__ = {"text": pd.Series, "gone": pd.Series, "return": pd.Series}
    strip = F.pandas_udf(strip, "string")
    j = docs.join(v, docs["doc_id"].eqNullSafe(F.col("_rules_doc")) & docs[host].cast("string").eqNullSafe(F.col("_rules_host")))
    return j.select(*((strip("text", "_rules_lines").alias("text") if c == "text" else docs[c]) for c in docs.columns))


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    return line_frequency_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, source, text, w, len(w) AS n FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, n - 3)) AS i FROM b WHERE n >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
li AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM li),
dup AS (SELECT doc_id, sum(c - 1) AS n_dup FROM (SELECT doc_id, line, count(*) AS c FROM lw WHERE nw > 0 GROUP BY ALL) GROUP BY doc_id),
nl AS (SELECT doc_id, source, regexp_replace(lower(trim(regexp_replace(line, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))), '\p{Nd}', '0', 'g') AS k, sum(nw) AS nw FROM lw WHERE nw > 0 GROUP BY ALL),
fr AS (SELECT source, k FROM nl GROUP BY source, k HAVING count(*) > 20),
rm AS (SELECT doc_id, sum(nw) AS removed FROM nl JOIN fr USING (source, k) GROUP BY doc_id),
z AS (SELECT b.doc_id, n AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
             coalesce(n_repeat, 0) AS n_repeat_words, coalesce(removed, 0) AS removed_words
      FROM b LEFT JOIN rw USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rm USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND NOT (n_words - removed_words < 10 OR removed_words > 0.5 * n_words) AS kept,
       removed_words::BIGINT AS removed_words
FROM z
"""
