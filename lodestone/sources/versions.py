"""Small files in shared storage that are written once: versions of indexes and of snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(_conf(spark))


def _conf(spark: SparkSession):
    return spark._jsparkSession.sessionState().newHadoopConf()


def latest(spark: SparkSession, folder: str) -> int:
    """The highest version in folder, -1 where there is none."""
    return max(listed(spark, folder), default=-1)


def listed(spark: SparkSession, folder: str) -> list[int]:
    """All versions in folder, in order."""
    at, fs = _at(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit())


def read(spark: SparkSession, folder: str, version: int) -> dict:
    at, fs = _at(spark, f"{folder}/{version}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, version: int, content: dict) -> None:
    """content as that version, whole or not at all; Conflict if the version exists.

    The content is written beside and renamed without overwriting, which the file system does in one step.
    """
    part, fs = _at(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never_over = spark.sparkContext._gateway.new_array(kind, 1)
    never_over[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), _conf(spark))
    at, _ = _at(spark, f"{folder}/{version}")
    try:
        context.rename(part, at, never_over)
    except Exception as e:
        fs.delete(part, False)
        if fs.exists(at):
            raise Conflict(f"version {version} of {folder} exists") from e
        raise


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names and times of change (s) of what lies in path."""
    at, fs = _at(spark, path)
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at)] if fs.exists(at) else []
