r"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. For a conversation, the
operator renders each prefix of its turns and compares consecutive outputs: where one output
extends the last, the extension is the span of the new turn; where it does not, the template
rewrites history, which is reported. What a turn's span holds around its text is found by a second
rendering in which a probe stands for the text, so no knowledge of the template is needed.

Conversations are brought together by conv_id and sorted by turn within partitions; a worker holds
one conversation at a time. Rendering all prefixes of n turns costs n renderings, as the method
asks; a conversation is the unit that a template formats as one string.

Defined cases: null text or role is empty; rows with equal (conv_id, turn) are turns of their own,
ordered by role and text; a null conv_id is a conversation; null turns come first; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, rows

Render = Callable[[list[tuple[str, str]]], str]

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_HEAD = re.compile(r"### ((?:[^\\:]|\\:|\\\\|\\###|\\</turn>)*):\n")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def turn_template(messages: list[tuple[str, str]]) -> str:
    r"""Turns as ``### role:\ntext</turn>\n``; control strings in texts carry a backslash."""
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}:\n{escape(text)}</turn>\n" for role, text in messages)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of all turns, read from formatted text alone."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        if not head:
            raise ValueError(f"no turn begins at {at}")
        i = head.end()
        while True:
            m = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n").search(formatted, i)
            if not m:
                raise ValueError(f"the turn at {at} does not end")
            i = m.end()
            if m[0][0] != "\\":
                out.append((unescape(head[1].replace("\\:", ":")), unescape(formatted[head.end() : m.start()])))
                at = i
                break
    return out


def spans(messages: list[tuple[str, str]], render: Render) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The whole output, the span of each turn in it, and the turns at which earlier output changed.

    For a turn that rewrites history, its span begins where the outputs part; spans of earlier
    turns are cut there.
    """
    last, found, rewrites = render([]), [], []
    for i in range(1, len(messages) + 1):
        now = render(messages[:i])
        start = len(last)
        if not now.startswith(last):
            rewrites.append(i - 1)
            start = len(os.path.commonprefix([last, now]))
            found = [(min(a, start), min(b, start)) for a, b in found]
        found.append((start, len(now)))
        last = now
    return last, found, rewrites


def body(messages: list[tuple[str, str]], i: int, whole: str, span: tuple[int, int], render: Render) -> tuple[int, int]:
    """Where the text of turn i lies: its span without what the template puts around it."""
    probe = "Q7probeQ7"
    while any(probe in t for m in messages[: i + 1] for t in m):
        probe += "x"
    before = render(messages[:i])
    shown = render([*messages[:i], (messages[i][0], probe)])
    common = len(before) if shown.startswith(before) else span[0]
    at = shown.find(probe, min(common, span[0]))
    if at < 0:
        return span
    tail = len(shown) - at - len(probe)
    return max(span[0], at), max(at, span[1] - tail)


def formatted(messages: list[tuple[str, str]], render: Render = turn_template, loss_role: str = "assistant") -> dict:
    """Formatted text, spans, loss mask spans and rewrites of one conversation."""
    whole, found, rewrites = spans(messages, render)
    mask = [body(messages, i, whole, found[i], render) for i, (role, _) in enumerate(messages) if role == loss_role]
    return {"formatted": whole, "spans": found, "loss": mask, "rewrites": rewrites}


def _conversations(batches):
    key, held, begun = None, [], False
    for conv_id, role, text in rows(batches, "conv_id", "role", "text"):
        if begun and conv_id != key:
            yield key, held
            held = []
        key, begun = conv_id, True
        held.append((role or "", text or ""))
    if begun:
        yield key, held


def format_chats(turns: DataFrame, render: Render = turn_template, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, turn spans, loss spans, turns that rewrote history."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turn_spans", pa.list_(pa.int64())), ("loss_spans", pa.list_(pa.int64())), ("rewrites", pa.list_(pa.int64()))])

    def run(batches):
        def made():
            for conv_id, messages in _conversations(batches):
                f = formatted(messages, render, loss_role)
                yield conv_id, f["formatted"], [x for s in f["spans"] for x in s], [x for s in f["loss"] for x in s], f["rewrites"]

        yield from chunked(made(), schema, 2000)

    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    placed = slim.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.mapInArrow(run, "conv_id long, formatted string, turn_spans array<long>, loss_spans array<long>, rewrites array<long>")


def _digest(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_rewrites", pa.int64())])

    def made():
        for conv_id, text, loss, rewrites in rows(batches, "conv_id", "formatted", "loss_spans", "rewrites"):
            turns = parse(text)
            seen = "".join(unescape(text[a:b]) for a, b in zip(loss[::2], loss[1::2], strict=True))
            sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
            yield conv_id, len(turns), sha, len(seen), hashlib.sha256(seen.encode("utf-8", "surrogatepass")).hexdigest(), len(text), len(rewrites)

    yield from chunked(made(), schema, 5000)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    done = format_chats(turns.unionByName(extra))
    return done.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS a,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
             sum(length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:')) + length(text) + len(regexp_extract_all(text, '\\|###|</turn>')) + 14) AS f
      FROM t GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(a) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256,
       f::BIGINT AS formatted_chars, 0::BIGINT AS n_rewrites FROM g
"""
