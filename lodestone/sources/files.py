"""State files: vector indexes, imports, exports, label files and parsers of model output."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all machines share: below spark.checkpoint.dir, or the warehouse where that is unset."""
    return f"{_own(spark)}/{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    """The folder of this application's steps."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{root.rstrip('/')}/lodestone-files/{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the steps that this application has stored, once no result that reads them is needed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def write_index(vectors: DataFrame, path: str) -> None:
    """(id, embedding, norm), sorted by id within files."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    vectors.select("id", "embedding", norm.alias("norm")).sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index, or None where there is none (search then runs on keywords alone)."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return None if df.isEmpty() else df


def tag_bags(item_tags: DataFrame) -> DataFrame:
    """item_id, bag: an item's tags in order, joined by spaces."""
    return item_tags.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("bag"))


def tag_vocabulary(item_tags: DataFrame, least: int = 1) -> DataFrame:
    """tag, freq: number of items per tag, exact."""
    return item_tags.groupBy("tag").agg(F.countDistinct("item_id").alias("freq")).where(F.col("freq") >= least)


def import_state(spark: SparkSession, path: str, key: str = "items") -> DataFrame:
    """text, category of the list under key in a JSON state file; categories without a slash go below general/."""
    rows = spark.read.json(path, multiLine=True, schema=f"`{key}` array<struct<text:string,category:string>>").select(F.explode(key).alias("e"))
    c = F.coalesce(F.col("e.category"), F.lit("general"))
    return rows.select(F.col("e.text").alias("text"), F.when(c.contains("/"), c).otherwise(F.concat(F.lit("general/"), c)).alias("category"))


def import_markdown(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value").startswith("- "))
    return lines.select(F.trim(F.expr("substring(trim(value), 3)")).alias("text")).where("text <> ''")


def export_markdown(items: DataFrame) -> DataFrame:
    """category, block: a heading and a list per category."""
    g = items.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["text"])), "\n")
    return g.select("category", F.concat(F.lit("## "), F.col("category"), F.lit("\n"), body).alias("block"))


def first_json_array(text: str | None, key: str = "text") -> list | None:
    """First bracketed JSON array in a text whose items carry key; strings and escapes are respected."""
    at = 0 if text else -1
    while at >= 0:
        at = text.find("[", at)
        if at < 0:
            return None
        depth, i, quoted = 0, at, False
        while i < len(text):
            c = text[i]
            if quoted:
                i += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
                if not depth:
                    break
            i += 1
        try:
            found = json.loads(text[at : i + 1])
            if isinstance(found, list) and (not found or all(isinstance(x, dict) and key in x for x in found)):
                return found
        except ValueError:
            pass
        at += 1
    return None


def parsed_arrays(rows: DataFrame, column: str, schema: str, key: str = "text") -> DataFrame:
    """rows with column items: array<struct> read from free model output; null if there is none."""
    import pandas as pd

    def run(t: pd.Series) -> pd.Series:
        got = [first_json_array(x, key) for x in t]
        return pd.Series([None if g is None else json.dumps(g) for g in got], dtype=object)

    run.__annotations__ = {"t": pd.Series, "return": pd.Series}
    return rows.withColumn("items", F.from_json(F.pandas_udf(run, "string")(column), f"array<{schema}>"))


def parsed_objects(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with column object: from the first brace to the last, fences ignored."""
    bare = F.regexp_replace(F.col(column), "```(json)?", "")
    return rows.withColumn("object", F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), schema))


# --- labels, sessions and offsets -----------------------------------------------------------------
def labelled_rows(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """run, file and the columns of schema of label files: JSON lines, or the list under key of JSON files.

    run is the folder a file lies in, so a folder of runs is one table.
    """
    if key is None:
        rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    else:
        whole = spark.read.schema(f"`{key}` array<struct<{_fields(schema)}>>").json(path, multiLine=True)
        rows = whole.select(F.explode(key).alias("e"), F.col("_metadata.file_path").alias("_file")).select("e.*", "_file")
    parts = F.split("_file", "/")
    return rows.select(F.element_at(parts, -2).alias("run"), F.element_at(parts, -1).alias("file"), *[c for c in rows.columns if c != "_file"])


def _fields(schema: str) -> str:
    return ", ".join(":".join(f.split(None, 1)) for f in schema.split(", "))


def sessions_found(spark: SparkSession, path: str, least_bytes: int = 10_240) -> DataFrame:
    """session, path, bytes, modified of transcripts below path (a glob) that are large enough; no content is read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return files.where(F.col("bytes") >= least_bytes).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("session"), "path", "bytes", "modified")


def moved_offsets(offsets: DataFrame, done: DataFrame) -> DataFrame:
    """offsets (session, offset) after what was consumed (session, offset): none ever moves back."""
    return offsets.unionByName(done.select("session", "offset")).groupBy("session").agg(F.max("offset").alias("offset"))


def write_offsets(offsets: DataFrame, path: str, version: int) -> str:
    """A snapshot of offsets in a folder of its own; the newest version that is complete counts."""
    at = f"{path}/v={version}"
    offsets.select("session", "offset").write.mode("errorifexists").parquet(at)
    return at


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete snapshot; empty where there is none."""
    empty = spark.createDataFrame([], "session string, offset long")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.schema("session string, offset long").parquet(f"{path}/v={max(done)}") if done else empty
