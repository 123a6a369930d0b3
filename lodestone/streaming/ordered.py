"""Streams whose rules follow the order of events, not of arrival.

Rows of a key wait in state until the watermark has passed them and then reach the rule in order
of (time, seq), so the result does not depend on how rows are dealt to micro-batches. State lives
in RocksDB: a list of waiting rows, a value that the rule folds, the time of the last row; one
timer a key brings the release, another the end of a key that has been still for ``ttl_ms``.
What waits is bounded by what arrives within the watermark's delay; late rows are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lodestone.functions import values as V

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """Streams started within keep their state in RocksDB; the session's setting is put back after."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


class InOrder(StatefulProcessor):
    """Releases rows (at in ms, seq, further columns) of a key in order and folds them.

    fold(key, state, row) gives the new state and output rows; end(key, state) the last output rows of
    a key that has been still for ttl_ms of event time, whose state is then dropped.
    """

    def __init__(self, columns: list[str], held: str, state: str, output: list[str], fold: Callable, end: Callable | None = None, ttl_ms: int | None = None):
        self._columns, self._held_schema, self._state_schema = columns, held, state
        self._row, self._fold, self._end, self._ttl = Row(*output), fold, end, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", self._held_schema)
        self._state = handle.getValueState("folded", self._state_schema)
        self._last = handle.getValueState("last", "at long")
        self._folded_at = handle.getValueState("folded_at", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self._columns) for r in rows]
        self._held.appendList(new)
        latest = max(r[0] for r in new)
        if not self._last.exists() or self._last.get()[0] < latest:
            self._last.update((latest,))
        yield from self._released(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        yield from self._released(key, now)
        if self._ttl is not None and self._last.exists() and self._last.get()[0] + self._ttl <= now:
            if self._end:
                yield from (self._row(*x) for x in self._end(key, self._state.get() if self._state.exists() else None))
            for s in (self._held, self._state, self._last, self._folded_at):
                s.clear()
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)

    def _released(self, key, watermark: int) -> Iterator[Row]:
        held = [tuple(r) for r in self._held.get()] if self._held.exists() else []
        ready = sorted((r for r in held if r[0] <= watermark), key=lambda r: r[:2])
        if ready:
            state = tuple(self._state.get()) if self._state.exists() else None
            before = self._folded_at.get()[0] if self._folded_at.exists() else None
            for r in ready:
                if self._ttl is not None and before is not None and before + self._ttl <= r[0]:  # it was still in between
                    if self._end:
                        yield from (self._row(*x) for x in self._end(key, state))
                    state = None
                state, out = self._fold(key, state, r)
                before = r[0]
                yield from (self._row(*x) for x in out)
            self._state.update(state)
            self._folded_at.update((before,))
            held = [r for r in held if r[0] > watermark]
            self._held.put(held) if held else self._held.clear()
        wanted = {min(r[0] for r in held)} if held else set()
        if self._ttl is not None and self._last.exists():
            wanted.add(self._last.get()[0] + self._ttl)
        for t in set(self._handle.listTimers()) - wanted:
            self._handle.deleteTimer(t)
        for t in wanted - set(self._handle.listTimers()):
            if t > watermark:
                self._handle.registerTimer(t)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: list[str], time: str, seq: str, values: dict[str, Column], state: str, output: str, fold: Callable, delay: str = "1 hour", end: Callable | None = None, ttl_ms: int | None = None) -> DataFrame:
    """fold() over the rows of each key in order of (time, seq), as a stream of what it puts out (append mode).

    values: the further columns that fold sees after time (ms) and seq.
    """
    rows = stream.withWatermark(time, delay).select(*keys, time, F.unix_millis(time).alias("_at"), F.col(seq).cast("long").alias("_seq"), *(c.alias(f"_{n}") for n, c in values.items()))
    columns = [c for c in rows.columns if c not in (*keys, time)]
    held = StructType([f for f in rows.schema if f.name in columns])
    made = InOrder(columns, held, state, StructType.fromDDL(output).names, fold, end, ttl_ms)
    return rows.groupBy(*keys).transformWithState(made, output, "Append", "EventTime")


# --- rules ------------------------------------------------------------------------------------
def running_relevance(events: DataFrame, time: str, delay: str = "1 hour", alpha: float = V.EMA_ALPHA, limit: float = V.EMA_LIMIT) -> DataFrame:
    """item_id, tag, seq, score, positive_evals, negative_evals after each event (item_id, tag, raw, weight, seq), in order of events."""

    def fold(key, state, row):
        s, pos, neg = state or (0.0, 0, 0)
        _, seq, raw, weight = row
        s = max(-limit, min(limit, (1 - alpha) * s + alpha * raw * weight))
        state = (float(s), pos + int(raw > 0), neg + int(raw < 0))
        return state, [(*key, seq, *state)]

    output = "item_id long, tag string, seq long, score double, positive_evals int, negative_evals int"
    return in_order(events, ["item_id", "tag"], time, "seq", {"raw": F.col("raw"), "weight": F.col("weight")}, "score double, pos int, neg int", output, fold, delay)


def new_narrations(rows: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """session, seq, narration of narrations that differ from the session's one before, across micro-batches."""

    def fold(key, state, row):
        _, seq, narration = row
        return (narration,), [] if state and state[0] == narration else [(*key, seq, narration)]

    return in_order(rows, ["session"], time, "seq", {"narration": F.col("narration")}, "narration string", "session string, seq long, narration string", fold, delay)


def queued_paths(requests: DataFrame, time: str, delay: str = "1 hour", still_ms: int = 60_000) -> DataFrame:
    """session, first_seq, path: one job for a session's requests (session, path, seq) until it is still, with the latest path."""

    def fold(key, state, row):
        _, seq, path = row
        return (state[0] if state else seq, path), []

    def end(key, state):
        return [(*key, *state)] if state else []

    return in_order(requests, ["session"], time, "seq", {"path": F.col("path")}, "first_seq long, path string", "session string, first_seq long, path string", fold, delay, end, still_ms)


def session_texts(lines: DataFrame, time: str, delay: str = "1 hour", least_chars: int = 20_000, least_bytes: int = 10_240, covered: float = 0.9, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """session, kind, from_offset, offset, size, text of transcripts as they grow.

    lines: session, text, end (bytes), in order of (time, end). A session's new text is given out
    once it has least_chars characters and the transcript least_bytes (kind text); until then the
    offset does not move. A session without lines for ttl_ms ends: as small below least_bytes, as
    done if the offset covers enough of it, else as rest with the text that is left.
    """

    def fold(key, state, row):
        held, start, _ = state or ("", 0, 0)
        _, end, text = row
        held = f"{held}\n{text}" if held else text
        if len(held) >= least_chars and end >= least_bytes:
            return ("", end, end), [(*key, "text", start, end, end, held)]
        return (held, start, end), []

    def end(key, state):
        if not state:
            return []
        held, start, size = state
        if size < least_bytes:
            return [(*key, "small", start, start, size, "")]
        done = start >= covered * size
        return [(*key, "done" if done else "rest", start, start if done else size, size, "" if done else held)]

    output = "session string, kind string, from_offset long, offset long, size long, text string"
    return in_order(lines, ["session"], time, "end", {"text": F.coalesce("text", F.lit(""))}, "held string, start long, size long", output, fold, delay, end, ttl_ms)


def finished(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table: written below folder with its checkpoint, state in RocksDB."""
    spark = stream.sparkSession
    with rocks(spark):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
