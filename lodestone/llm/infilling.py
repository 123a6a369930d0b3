"""Fill-in-middle transformation of whole texts, and its exact reversal.

A text is cut into units (white space and the word after it, or white space at the end). Where the
units end is held as one big integer with a bit per code point: bytes.translate writes the class
of each code point, shifts and ANDs of whole integers mark the ends, bit_count gives the number of
units, and the end of the r-th unit is found by halving the integer, so a text of any length costs
a few linear passes and no list of its units exists.

Each document's cuts and form follow from a hash of its id alone, so the result is the same in any
partitioning and no row is moved: there is no shuffle and no key that could be hot.

Defined cases: a null text is an empty text (no unit, plain); a null doc_id is hashed as the seed
with nothing after it; repeated rows are each transformed, equally where id and text are equal; a
text of white space alone is one unit; texts that hold a mark stay plain, so no mark has to be
escaped; very long texts are transformed as a whole; empty tables give empty results; further
columns, whatever their names, are ignored by the operator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, documents_only, rows

#: Prefix, suffix and middle marks.
MARKS = ("<P>", "<S>", "<M>")
_BLANK = b" \t\n\x0b\x0c\r"
#: code point (those beyond one byte count as "?") -> "1" for white space
_CLASS = bytes(0x31 if c in _BLANK else 0x30 for c in range(256))


def unit_ends(text: str) -> int:
    """A bit per code point, the first one highest: set where a unit ends."""
    if not text:
        return 0
    blank = int(text.encode("latin-1", "replace").translate(_CLASS), 2)
    full = (1 << len(text)) - 1
    before_blank = (blank << 1) & full | 1  # the next code point is white space, or there is none
    return ~blank & full & before_blank | 1  # white space at the end is a unit of its own


def ranked_bit(bits: int, width: int, r: int) -> int:
    """Number of places up to and with the r-th set bit (r from 1) of width places, from the highest."""
    at = 0
    while width > 1:
        low = width // 2
        high = bits >> low
        n = high.bit_count()
        if r <= n:
            bits, width = high, width - low
        else:
            r -= n
            bits ^= high << low
            at, width = at + width - low, low
    return at + 1


def cuts(text: str, a: int, b: int) -> tuple[int, int, int]:
    """Number of units n, and the code points before the ends of units min and max of a % (n + 1), b % (n + 1)."""
    ends = unit_ends(text)
    n = ends.bit_count()
    first, last = sorted((a % (n + 1), b % (n + 1)))
    place = lambda r: ranked_bit(ends, len(text), r) if r else 0
    return n, place(first), place(last)


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, seed: str = "42", percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each row of docs (doc_id, text).

    Of the documents percent are cut, and of those spm_percent put the suffix first (spm: S suffix
    P prefix M middle), the others the prefix (psm: P prefix S suffix M middle). Others are plain:
    output is the text, prefix_chars and middle_chars are null.
    """
    _checked(marks)
    p, s, m = marks

    def one(doc_id: int | None, text: str) -> tuple:
        h1, h2, h3, h4 = draws(seed, doc_id)
        n, i, j = cuts(text, h1, h2)
        if not text or h3 % 100 >= percent or any(x in text for x in marks):
            return doc_id, n, "plain", None, None, text
        head, mid, tail = text[:i], text[i:j], text[j:]
        if h4 % 100 < spm_percent:
            return doc_id, n, "spm", i, j - i, f"{s}{tail}{p}{head}{m}{mid}"
        return doc_id, n, "psm", i, j - i, f"{p}{head}{s}{tail}{m}{mid}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from chunked((one(i, t or "") for i, t in rows(batches, "doc_id", "text")), _ARROW, 2000)

    return documents_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that output and form stand for."""
    p, s, m = map(F.lit, marks)
    before = lambda x, mark: F.substr(x, F.lit(1), F.instr(x, mark) - 1)
    after = lambda x, mark: F.substr(x, F.instr(x, mark) + F.length(mark))
    spm_rest, psm_rest = after(after(output, s), p), after(after(output, p), s)
    spm = F.concat(before(spm_rest, m), after(spm_rest, m), before(after(output, s), p))
    psm = F.concat(before(after(output, p), s), after(psm_rest, m), before(psm_rest, m))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def _checked(marks: tuple[str, str, str]) -> None:
    """A mark must not begin within the end of a text or of another mark: else outputs could be read in two ways."""
    for a in marks:
        for b in marks:
            if not a or any(b.startswith(a[i:]) for i in range(1, len(a))) or (a is not b and a in b):
                raise ValueError(f"marks {a!r} and {b!r} overlap")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a+1:b], '') AS mid, array_to_string(units[b+1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                        ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
