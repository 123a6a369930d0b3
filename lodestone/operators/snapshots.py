"""Atomic versions of all linked tables, merges that commit as one, backups and restores.

A version is a manifest that names a folder for each table; data folders are written before it and
never changed, so a version is there as a whole or not at all, and readers of older versions are
not disturbed. Versions are created without overwriting. A writer whose base is no longer the
latest goes on only if none of the tables that it has read or written has changed since; else it
gets a Conflict and may start again from the latest version. A writer that dies leaves folders
that no manifest names; prune() deletes them once they are old enough.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import versions
from lodestone.sources.versions import Conflict

from . import dedup as D


class Snapshots:
    """The versions of the tables in one folder of shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._manifests = f"{self._path}/manifests"

    def version(self) -> int:
        """The latest version, -1 where there is none."""
        return versions.latest(self._spark, self._manifests)

    def manifest(self, version: int) -> dict:
        return versions.read(self._spark, self._manifests, version) if version >= 0 else {"tables": {}}

    def history(self) -> list[dict]:
        """All versions in order: version, note, seconds, tables changed."""
        return [self.manifest(v) | {"version": v} for v in versions.listed(self._spark, self._manifests)]

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        m = self.manifest(self.version() if version is None else version)
        return {name: self._spark.read.parquet(f"{self._path}/{at}") for name, at in m["tables"].items()}

    def commit(self, tables: dict[str, DataFrame], base: int, reads: list[str] | None = None, note: str = "") -> int:
        """A version after base with these tables and the others of base; reads (default: all) are the tables that these follow from."""
        folder = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self._path}/{folder}/{name}")
        return self._commit({name: f"{folder}/{name}" for name in tables}, base, reads, note)

    def restore(self, version: int) -> int:
        """The tables of an older version as the latest one; nothing is copied."""
        base = self.version()
        return self._commit(self.manifest(version)["tables"], base, None, f"restore of {version}", whole=True)

    def _commit(self, places: dict[str, str], base: int, reads: list[str] | None, note: str, whole: bool = False) -> int:
        start = self.manifest(base)["tables"]
        used = set(start) if reads is None else set(reads) | set(places)
        while True:
            latest = self.version()
            now = self.manifest(latest)["tables"]
            if latest != base and (reads is None or any(now.get(t) != start.get(t) for t in used)):
                raise Conflict(f"tables have changed between versions {base} and {latest} of {self._path}")
            content = {"tables": places if whole else now | places, "changed": sorted(places), "note": note, "seconds": time.time()}
            try:
                versions.commit(self._spark, self._manifests, latest + 1, content)
                return latest + 1
            except Conflict:
                continue  # another writer was first: see whether its tables matter here

    def prune(self, keep: int, older_than: float = 24 * 3600) -> list[int]:
        """Drops all but the latest ``keep`` versions and data that none of those name and that is older than so many seconds."""
        held = self.history()
        gone = [m["version"] for m in held[: max(0, len(held) - max(1, keep))]]
        for v in gone:
            versions.delete(self._spark, f"{self._manifests}/{v}")
        named = {at.split("/")[1] for m in held if m["version"] not in gone for at in m["tables"].values()}
        for name, seconds in versions.folders(self._spark, f"{self._path}/data"):
            if name not in named and time.time() - seconds > older_than:
                versions.delete(self._spark, f"{self._path}/data/{name}")
        return gone


def merge_groups(snapshots: Snapshots, groups: DataFrame, attempts: int = 5, before_commit: Callable[[], None] | None = None) -> tuple[int, DataFrame]:
    """Merges groups (batch, pos, ids, canonical_text, confidence, reason) in all linked tables as one version.

    Groups with a problem (see dedup.validated(); ids that are unknown or no longer active count as
    unknown) are put aside and given back with it, while the others commit. If tables change in
    between, groups are judged again on the latest version. Without a valid group nothing commits.
    """
    for attempt in range(attempts):
        base = snapshots.version()
        tables = snapshots.read(base)
        items = tables["items"]
        judged = D.validated(groups, items.where("not deprecated").select("id"))
        judged.persist()
        good = judged.where("problem is null").withColumn("group_id", F.array_min("ids"))
        aside = judged.where("problem is not null")
        if good.isEmpty():
            return base, aside
        id_map = D.survivors(good.select("group_id", "ids"), items)
        texts = id_map.select("group_id", "survivor").distinct().join(good.select("group_id", "canonical_text"), "group_id").select("survivor", "canonical_text")
        id_map = id_map.select("survivor", "absorbed").persist()
        merged = {k: v for k, v in D.merge_all(tables, id_map, texts).items() if v is not tables[k]}
        if before_commit:
            before_commit()
        try:
            return snapshots.commit(merged, base, list(tables), f"{good.count()} groups merged"), aside
        except Conflict:
            if attempt + 1 == attempts:
                raise
        finally:
            id_map.unpersist()
    raise AssertionError("unreachable")
