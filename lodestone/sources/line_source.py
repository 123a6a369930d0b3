"""Transcript lines with their byte places as a data source, in batch and as a stream.

Registered as ``transcript_lines``; option ``path`` is a folder of JSON-lines files that grow at
their ends, in any store that pyarrow.fs opens by its URI (file:, s3:, gs:, hdfs:). Files are split
by byte ranges of ``splitBytes``; a line belongs to the split that it begins in, so a large file is
many tasks and each byte is read once.

A stream's offset is the place after the last whole line of each file; a line that is still being
written is left for a later batch. A restart goes on from the checkpoint's offset. Files untouched
for ``maxAgeHours`` (24) that have been read leave the offset, which keeps it as small as the
sessions of that time; written to again, such a file is read from its place of then only if the
offset still holds it, else from its start. A file that shrinks is left out until it passes its place.

Defined cases: lines of white space alone are left out; bytes that are no UTF-8 become U+FFFD; a
batch takes a last line without a line feed as it is, unless ``wholeLines`` is true; an empty
folder or a missing one gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_CHUNK = 1 << 20


class Split(InputPartition):
    """Lines of a file that begin from ``start`` on and before ``stop``; none ends after ``end``."""

    def __init__(self, path: str, start: int, stop: int, end: int):
        self.path, self.start, self.stop, self.end = path, start, stop, end


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int, float]]:
    """Name, size and time of change (s) of the files in the folder."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.base_name, f.size, (f.mtime_ns or 0) / 1e9) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def last_whole(path: str, name: str, size: int, least: int = 0) -> int:
    """Place after the last line feed before size; least where there is none after it."""
    store, root = _store(path)
    with store.open_input_file(f"{root}/{name}") as f:
        at = size
        while at > least:
            start = max(least, at - _CHUNK)
            f.seek(start)
            i = f.read(at - start).rfind(b"\n")
            if i >= 0:
                return start + i + 1
            at = start
    return least


def lines_of(path: str, split: Split) -> Iterator[tuple]:
    """session (file name), start, end, value of a split's lines."""
    store, root = _store(path)
    with store.open_input_file(f"{root}/{split.path}") as f:
        at = split.start
        if at > 0:  # the line that reaches into this split belongs to the one before
            at -= 1
            f.seek(at)
            while True:
                part = f.read(min(_CHUNK, split.end - at))
                i = part.find(b"\n")
                if i >= 0 or not part:
                    at += i + 1 if i >= 0 else 0
                    break
                at += len(part)
            if i < 0:
                return
        f.seek(at)
        held, start = b"", at
        while start < split.stop:
            part = f.read(min(_CHUNK, split.end - at))
            at += len(part)
            held += part
            *whole, held = held.split(b"\n")
            if not part and held:  # a last line without a line feed
                whole, held = [held], b""
                ends = 0
            else:
                ends = 1
            for line in whole:
                end = start + len(line) + ends
                if start < split.stop and line.strip():
                    yield split.path, start, end, line.decode("utf-8", "replace")
                start = end
            if not part:
                return


def _splits(name: str, start: int, end: int, size: int) -> list[Split]:
    return [Split(name, at, min(at + size, end), end) for at in range(start, end, size)]


class TranscriptLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return "session string, start long, end long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Options:
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("splitBytes", str(64 << 20)))
        self.max_age = float(options.get("maxAgeHours", "24")) * 3600
        self.whole = options.get("wholeLines", "false").lower() == "true"


class _Batch(DataSourceReader):
    def __init__(self, options):
        self._o = _Options(options)

    def partitions(self):
        o = self._o
        ends = ((n, last_whole(o.path, n, size) if o.whole else size) for n, size, _ in _files(o.path))
        return [s for n, end in ends for s in _splits(n, 0, end, o.split)] or [Split("", 0, 0, 0)]

    def read(self, partition):
        return lines_of(self._o.path, partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self._o, self._seen = _Options(options), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        o, now, out = self._o, time.time(), {}
        for name, size, changed in _files(o.path):
            known, place = self._seen.get(name, (0, 0))
            if size > known:
                place = last_whole(o.path, name, size, place)
                self._seen[name] = size, place
            if place and (now - changed < o.max_age or place > known):
                out[name] = place
        return out

    def partitions(self, start: dict, end: dict):
        spans = ((n, start.get(n, 0), at) for n, at in sorted(end.items()))
        return [s for n, begin, at in spans if at > begin for s in _splits(n, begin, at, self._o.split)]

    def read(self, partition):
        return lines_of(self._o.path, partition)


def register(spark) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(TranscriptLines)
