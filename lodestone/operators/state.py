"""Write path as pure functions of state and change tables.

Nothing is updated in place: each function returns the new table, which the caller writes as the
next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.files import scratch

CURATED, REJECTED = 1, 2


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with their places (from 0) in order, without bringing them into one task.

    Rows are written once, by ranges of order and sorted within each; a row's place is its index in
    its file plus the rows of the files before. Bounds of ranges are drawn once, as every later step
    reads what was written. Rows that are equal in order share ranges, so many of them need a
    last entry of order that tells them apart (such as F.rand(7)); their mutual order is undefined.
    """
    spark = rows.sparkSession
    path = scratch(spark)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).option("compression", "zstd").parquet(path)
    placed = spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("int")
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    before = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_file").withColumn(name, F.col("_before") + F.col("_at")).drop("_file", "_before", "_at")


# --- sets ---------------------------------------------------------------------------------------
def insert_or_ignore(state: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """State plus new rows whose keys are unknown; of new rows with equal keys the first in order."""
    w = Window.partitionBy(*keys).orderBy(*(order or keys))
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return state.unionByName(first.join(state.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_set(state: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All rows of the owners in new are replaced by new."""
    return state.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new.distinct(), allowMissingColumns=True)


def delete_rows(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(gone.select(*keys).distinct(), keys, "left_anti")


def id_accounting(expected: DataFrame, given: DataFrame) -> DataFrame:
    """id, problem: missing, unknown or duplicated ids of given against expected (both: id)."""
    n = given.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    missing = expected.join(n, "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    unknown = n.join(expected, "id", "left_anti").select("id", F.lit("unknown").alias("problem"))
    twice = n.where("n > 1").select("id", F.lit("duplicated").alias("problem"))
    return missing.unionByName(unknown).unionByName(twice)


# --- items --------------------------------------------------------------------------------------
def add_items(items: DataFrame, new: DataFrame, order: str, now: Column) -> DataFrame:
    """New items (without id) get the ids after the largest, in the given order."""
    top = items.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    levels = T.category_levels("category")
    fresh = numbered(new, [order], "_n").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("_n") + 1).drop("_n", "top")
    fresh = fresh.select("*", *levels).withColumns({"created_at": now, "updated_at": now, "refreshed_at": now, "deprecated": F.lit(False), "pinned": F.lit(False)})
    return items.unionByName(fresh, allowMissingColumns=True)


def bridge_of(items: DataFrame) -> DataFrame:
    """item_id, path: the category of each item as a bridge row."""
    return items.select(F.col("id").alias("item_id"), F.col("category").alias("path")).where("path is not null").distinct()


def category_table(paths: DataFrame) -> DataFrame:
    """path of every category and all that lie above it."""
    return paths.select(F.explode(T.category_closure("path")).alias("path")).distinct()


def match_counts(stats: DataFrame, matches: DataFrame) -> DataFrame:
    """(item_id, repo) counters after matches (item_id, repo, ts)."""
    new = matches.groupBy("item_id", "repo").agg(F.count(F.lit(1)).cast("int").alias("times_matched"), F.max("ts").alias("last_matched"))
    return stats.unionByName(new).groupBy("item_id", "repo").agg(F.sum("times_matched").cast("int").alias("times_matched"), F.max("last_matched").alias("last_matched"))


def processed_sessions(state: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by session: largest friction and count, latest known title, latest time."""
    both = state.unionByName(new)
    return both.groupBy("session_id").agg(F.max("processed_at").alias("processed_at"), F.max("had_friction").alias("had_friction"), F.max("extracted").alias("extracted"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("processed_at"))).alias("title"))


def occurrence_bump(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Appends sessions of seen (id, session_id, seq) and sets the count to the list's length."""
    add = seen.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "session_id"))), lambda x: x["session_id"]).alias("more"))
    j = items.join(add, "id", "left")
    sessions = F.array_distinct(F.concat(F.coalesce("source_sessions", F.array().cast("array<string>")), F.col("more")))
    hit = F.col("more").isNotNull()
    return j.withColumn("occurrence_count", F.when(hit, F.size(sessions)).otherwise(F.col("occurrence_count"))).withColumn("source_sessions", F.when(hit, sessions).otherwise(F.col("source_sessions"))).drop("more")


def latest_audit(audits: DataFrame) -> DataFrame:
    """One audit row per session: the last written."""
    cols = [c for c in audits.columns if c != "session_id"]
    return audits.groupBy("session_id").agg(F.max_by(F.struct(*cols), "ts").alias("r")).select("session_id", "r.*")


def set_status(items: DataFrame, marked: DataFrame, bits: int) -> DataFrame:
    """Sets status bits of marked (id); rejected items are deprecated too."""
    j = items.join(marked.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = j.withColumn("status", F.when(hit, F.coalesce("status", F.lit(0)).bitwiseOR(bits)).otherwise(F.col("status")))
    if bits & REJECTED:
        out = out.withColumn("deprecated", F.col("deprecated") | hit)
    return out.drop("_hit")


def dedup_outcomes(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """items (id, dedup_verified, dedup_attempts, dedup_last_error) after dedup runs (id, error, seq; error null: no merge needed).

    A run without error verifies an item and clears its error; an error counts an attempt and is kept
    until a later run has none. Verified items stay so.
    """
    g = outcomes.groupBy("id").agg(F.max(F.col("error").isNull()).alias("_ok"), F.count_if(F.col("error").isNotNull()).cast("int").alias("_n"), F.max_by(F.struct("error"), "seq").alias("_last"))
    j = items.join(g, "id", "left")
    hit = F.col("_n").isNotNull()
    return j.withColumns({
        "dedup_verified": F.coalesce("dedup_verified", F.lit(False)) | F.coalesce("_ok", F.lit(False)),
        "dedup_attempts": F.coalesce("dedup_attempts", F.lit(0)) + F.coalesce("_n", F.lit(0)),
        "dedup_last_error": F.when(hit, F.col("_last.error")).otherwise(F.col("dedup_last_error")),
    }).drop("_ok", "_n", "_last")


def category_listing(items: DataFrame, prefix: str | None = None, include_deprecated: bool = False, limit: int = 0, offset: int = 0) -> DataFrame:
    """Items in order of category, then id: those of a category or below it, a page of ``limit`` rows (0: all)."""
    shown = items if include_deprecated else items.where(~F.col("deprecated"))
    if prefix:
        shown = shown.where(F.col("category").startswith(prefix))
    page = shown.orderBy("category", "id").offset(offset)
    return page.limit(limit) if limit else page


def uncurated(items: DataFrame) -> DataFrame:
    return items.where(~F.col("deprecated") & (F.col("status").isNull() | (F.col("status").bitwiseAND(CURATED) == 0)))


def update_fields(items: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null values of changes (id, columns) replace those of items."""
    new = changes.select("id", *(F.col(c).alias(f"_{c}") for c in columns))
    j = items.join(new, "id", "left")
    return j.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def refreshed(items: DataFrame, log: DataFrame) -> DataFrame:
    """Refresh times moved to the latest of log (id, refreshed_at)."""
    last = log.groupBy("id").agg(F.max("refreshed_at").alias("_at"))
    return items.join(last, "id", "left").withColumn("refreshed_at", F.greatest("refreshed_at", "_at")).drop("_at")


def migrated(rows: DataFrame, empty: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Older rows in the columns of a newer schema, with defaults for what is new or null."""
    out = empty.unionByName(rows, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def audit_rows(shown: DataFrame, env: DataFrame) -> DataFrame:
    """session_id, shown_ids, context of what was shown (session_id, item_id, hook_event, query_text), with the environment's columns."""
    s = shown.groupBy("session_id").agg(F.array_sort(F.collect_set("item_id")).alias("shown_ids"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("item_id").cast("string"), F.struct("query_text", "hook_event"))))).alias("context"))
    return s.join(env, "session_id", "left")


# --- logs ---------------------------------------------------------------------------------------
def log_page(log: DataFrame, limit: int, offset: int = 0, where: Column | None = None, limit_first: bool = False) -> DataFrame:
    """Newest rows of a log; the filter comes before the limit unless limit_first."""
    newest = lambda d: d.orderBy(F.desc("id")).offset(offset).limit(limit)
    if where is None:
        return newest(log)
    return newest(log).where(where) if limit_first else newest(log.where(where))


def log_texts(log: DataFrame, items: DataFrame) -> DataFrame:
    """id, pos, item_id, text for the items of log rows (id, item_ids); absent items show as deleted."""
    e = log.select("id", F.posexplode("item_ids").alias("pos", "item_id"))
    return e.join(items.select(F.col("id").alias("item_id"), "text"), "item_id", "left").withColumn("text", F.coalesce("text", F.lit("<deleted>")))


def missing_repo_tags(items: DataFrame, audit: DataFrame, item_tags: DataFrame) -> DataFrame:
    """item_id, tag: repo: tags of an item's source sessions that it lacks."""
    s = items.select(F.col("id").alias("item_id"), F.explode("source_sessions").alias("session_id"))
    found = s.join(audit.select("session_id", F.explode("env_tags").alias("tag")), "session_id").where(F.col("tag").startswith("repo:")).select("item_id", "tag").distinct()
    return found.join(item_tags.select("item_id", "tag"), ["item_id", "tag"], "left_anti")
