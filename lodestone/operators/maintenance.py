"""Upkeep of the store: resets, backfills, pins, categories, re-extraction, curation runs, gates and environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

from . import dedup as D
from . import state as M
from .metric_join import best_in_groups
from .search import nearest


# --- items --------------------------------------------------------------------------------------
def reset_stats(items: DataFrame, repo_stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items unpinned and without matches, and empty repository counters."""
    zero = {"pinned": F.lit(False), "times_matched": F.lit(0), "last_matched": F.lit(None).cast("timestamp")}
    return items.withColumns(zero), repo_stats.limit(0)


def backfill_prerequisites(items: DataFrame, inferred: DataFrame) -> DataFrame:
    """prerequisites of inferred (id, prerequisites) for items that have none; others keep theirs."""
    j = items.join(inferred.select("id", F.col("prerequisites").alias("_new")), "id", "left")
    return j.withColumn("prerequisites", F.coalesce("prerequisites", "_new")).drop("_new")


def add_tags(item_tags: DataFrame, new: DataFrame) -> DataFrame:
    """item_tags with new ones (item_id, tag), lower case and trimmed; blank ones are left out."""
    clean = new.select("item_id", F.lower(F.trim("tag")).alias("tag")).where("tag <> ''")
    return M.insert_or_ignore(item_tags.select("item_id", "tag"), clean, ["item_id", "tag"])


def set_pins(items: DataFrame, requests: DataFrame) -> DataFrame:
    """id, pinned, message after requests (id, pin): what is already so stays, and says so; unknown ids are reported."""
    j = requests.join(items.select("id", F.col("pinned").alias("was")), "id", "left")
    same = F.col("was") == F.col("pin")
    message = F.when(F.col("was").isNull(), "not found").when(same & F.col("pin"), "already pinned").when(same, "not pinned").when(F.col("pin"), "pinned").otherwise("unpinned")
    return j.select("id", F.when(F.col("was").isNotNull(), F.col("pin")).alias("pinned"), message.alias("message"))


def add_categories(bridge: DataFrame, new: DataFrame) -> DataFrame:
    """bridge (item_id, path) with further categories of items."""
    return M.insert_or_ignore(bridge, new.select("item_id", T.normal_category("path").alias("path")).where("path <> ''"), ["item_id", "path"])


def remove_categories(bridge: DataFrame, gone: DataFrame, items: DataFrame) -> DataFrame:
    """bridge without some extra categories; an item's own category stays."""
    own = items.select(F.col("id").alias("item_id"), F.col("category").alias("path"))
    return M.delete_rows(bridge, gone.join(own, ["item_id", "path"], "left_anti"), ["item_id", "path"])


def deprecate(items: DataFrame, requests: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """Items after requests (id, reason), the log of those that changed, and the index without them."""
    hit = requests.join(items.where("not deprecated").select("id"), "id", "left_semi")
    after = M.set_status(items, hit, M.REJECTED)
    live = vectors.join(after.where("deprecated").select("id"), "id", "left_anti")
    return {"items": after, "log": hit.select("id", F.coalesce("reason", F.lit("")).alias("reason")), "index": live}


def environment_tags(items: DataFrame, audit: DataFrame) -> DataFrame:
    """id, tags: sorted environment tags of an item's source sessions; sessions without audit give none."""
    s = items.select("id", F.explode("source_sessions").alias("session_id"))
    return s.join(audit.select("session_id", F.explode("env_tags").alias("tag")), "session_id").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def environments(workspaces: DataFrame, tags: DataFrame) -> DataFrame:
    """workspace, os, repo, cwd, servers, tags: repo from the remote, else from the directory's name."""
    t = tags.groupBy("workspace").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    name = F.element_at(F.split(F.regexp_replace("cwd", "/+$", ""), "/"), -1)
    j = workspaces.join(t, "workspace", "left")
    return j.select("workspace", F.lower("os").alias("os"), F.coalesce(F.lower(T.repo_of_remote("remote")), F.nullif(name, F.lit(""))).alias("repo"), "cwd", F.array_sort(F.coalesce("servers", F.array().cast("array<string>"))).alias("servers"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def control_set(current: Column, name: Column, on: Column) -> Column:
    """A stored list of names with one put in or taken out; sorted, each once."""
    held = F.coalesce(current, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.when(on, F.array_append(held, name)).otherwise(F.array_remove(held, name))))


def counted_labels(labels: DataFrame, default: str = "counted") -> DataFrame:
    """Labels that a benchmark counts: those whose status (null: default) says so."""
    return labels.where(F.coalesce("status", F.lit(default)) == "counted")


# --- dedup and curation -------------------------------------------------------------------------
def dedup_payload(items: DataFrame) -> DataFrame:
    """id, status, text, category, occurrence_count as a judge sees them."""
    return items.select("id", F.when(F.col("dedup_verified"), "verified").otherwise("unverified").alias("status"), "text", "category", "occurrence_count")


def target_candidates(vectors: DataFrame, target: int, least: float = 0.5, k: int = 8) -> DataFrame:
    """Candidates of one item against all others, whatever their state."""
    asked = vectors.where(F.col("id") == target).select(F.col("id").alias("query_id"), "embedding")
    near = nearest(vectors.where(F.col("id") != target), asked, k).where(F.round("score", 9) >= least)
    return near.select(F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), F.col("score").alias("similarity"), "rank0")


def merged_context(context: DataFrame, id_map: DataFrame) -> DataFrame:
    """Contexts (session_id, item_id, pos, prompt_tags, query_text, hook_event) rewritten to survivors.

    An item's own context comes first; its empty fields are filled from absorbed ones in order.
    """
    m = context.join(id_map.select(F.col("absorbed").alias("item_id"), "survivor"), "item_id", "left")
    order = F.struct(F.col("survivor").isNotNull().cast("int").alias("late"), "pos")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), order)).alias(c)
    return m.groupBy("session_id", F.coalesce("survivor", "item_id").alias("item_id")).agg(*(first(c) for c in ("prompt_tags", "query_text", "hook_event")))


def curation_due(items: DataFrame, least: int = 100) -> DataFrame:
    """due: whether enough active items wait for curation."""
    return M.uncurated(items).agg((F.count(F.lit(1)) >= least).alias("due"), F.count(F.lit(1)).alias("waiting"))


def curation_run(items: DataFrame, verdicts: DataFrame, groups: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Items after verdicts (id, verdict), and the merges (group_id, survivor, absorbed, confidence) that may run.

    Merges (group_id, ids) are limited to waiting items that were kept, need two of them, and the
    first id survives. Items of failed batches (id) count as curated.
    """
    waiting = M.uncurated(items).select("id")
    known = verdicts.join(waiting, "id", "left_semi")
    after = D.curation(items, known)
    if failed is not None:
        after = M.set_status(after, failed.join(waiting, "id", "left_semi"), M.CURATED)
    rejected = known.where("verdict = 'reject'").select("id")
    kept = waiting.join(rejected, "id", "left_anti")
    e = groups.select("group_id", F.posexplode("ids").alias("pos", "id")).join(kept, "id", "left_semi")
    g = e.groupBy("group_id").agg(F.min_by("id", "pos").alias("survivor"), F.count_distinct("id").alias("n")).where("n >= 2")
    return after, e.join(g, "group_id").where("id <> survivor").select("group_id", "survivor", F.col("id").alias("absorbed"), F.lit(0.9).alias("confidence")).distinct()


def pass_totals(passes: DataFrame) -> DataFrame:
    """Sums over dedup passes (pass, merged, absorbed, verified, failed)."""
    return passes.agg(F.count(F.lit(1)).alias("passes"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("merged", "absorbed", "verified", "failed")))


# --- re-extraction and gates --------------------------------------------------------------------
def confirmations(items: DataFrame, extracted: DataFrame, skipped: DataFrame, least: float = 0.80) -> DataFrame:
    """id, result of items (id, source_sessions, embedding): confirmed, unconfirmed or skipped.

    An item is confirmed if any of its usable sessions gives a text (session_id, embedding) near it,
    and skipped if it has no usable session; a session that was read but gave nothing confirms nothing.
    """
    s = items.select("id", F.explode("source_sessions").alias("session_id"), "embedding").join(skipped.select("session_id"), "session_id", "left_anti")
    best = best_in_groups(s, extracted.withColumn("id", F.lit(0)), "session_id", ["id"], "best_id").groupBy("id").agg(F.max("s").alias("best"))
    j = items.select("id").join(s.select("id").distinct().withColumn("usable", F.lit(True)), "id", "left").join(best, "id", "left")
    return j.select("id", F.when(F.col("usable").isNull(), "skipped").when(F.col("best") >= least, "confirmed").otherwise("unconfirmed").alias("result"))


def pruned(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items with unconfirmed ones deprecated."""
    return M.set_status(items, results.where("result = 'unconfirmed'").select("id"), M.REJECTED)


def gate_outcome(items: DataFrame, verdicts: DataFrame, groups: DataFrame, labels: DataFrame, least: float = 0.85) -> DataFrame:
    """One row of counts of a quality gate: what it kept, rejected and merged, and how labels fared.

    items: id, session_id, embedding; verdicts: id, verdict; groups: group_id, ids, embedding of the
    canonical text; labels: label_id, kind (good, bad), session_id, embedding. A merged item counts
    through its group's text in the sessions of all its members; labels of sessions without a kept
    text are left out.
    """
    member = groups.select("group_id", F.explode("ids").alias("id")).distinct()
    kept = items.join(verdicts.where("verdict = 'keep'").select("id").distinct(), "id", "left_semi")
    alone = kept.join(member, "id", "left_anti").select("session_id", "embedding")
    canon = member.join(items.select("id", "session_id"), "id").join(groups.select("group_id", "embedding"), "group_id").select("session_id", "embedding")
    pool = alone.unionByName(canon)
    met = best_in_groups(labels, pool.withColumn("id", F.lit(0)), "session_id", ["label_id", "kind"])
    best = met.groupBy("label_id", "kind").agg(F.max("s").alias("best"))
    near = F.col("best") >= least
    fared = best.agg(F.count_if((F.col("kind") == "good") & near).alias("good_found"), F.count_if(F.col("kind") == "good").alias("good_total"), F.count_if((F.col("kind") == "bad") & ~near).alias("bad_avoided"), F.count_if(F.col("kind") == "bad").alias("bad_total"))
    counts = verdicts.agg(F.count_if(F.col("verdict") == "keep").alias("kept"), F.count_if(F.col("verdict") == "reject").alias("rejected"))
    merged = member.agg(F.count_distinct("group_id").alias("merged_groups"), F.count_distinct("id").alias("merged_items"))
    # four rows of one row each
    one = counts.crossJoin(merged).crossJoin(fared).crossJoin(alone.agg(F.count(F.lit(1)).alias("alone")))
    final = one.withColumn("final", F.col("alone") + F.col("merged_groups")).drop("alone")
    pct = lambda a, b: F.coalesce(100 * F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return final.withColumn("good_recall", pct("good_found", "good_total")).withColumn("bad_avoidance", pct("bad_avoided", "bad_total"))


# --- listings -----------------------------------------------------------------------------------
def verbose_listing(items: DataFrame, relevance: DataFrame, repo_stats: DataFrame, titles: DataFrame) -> DataFrame:
    """id, category, best, tags, repos, titles of active items: their scores by tag, matches by repository and sessions' titles, best first."""
    r = relevance.groupBy(F.col("item_id").alias("id")).agg(F.max(F.round("score", 6)).alias("best"), F.array_sort(F.collect_list("tag")).alias("tags"))
    p = repo_stats.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat_ws(":", "repo", F.col("times_matched").cast("string")))).alias("repos"))
    s = items.select("id", F.explode("source_sessions").alias("session_id")).join(titles, "session_id").groupBy("id").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    none = F.array().cast("array<string>")
    j = items.where("not deprecated").select("id", "category").join(r, "id", "left").join(p, "id", "left").join(s, "id", "left")
    return j.select("id", "category", F.coalesce("best", F.lit(0.0)).alias("best"), *(F.coalesce(c, none).alias(c) for c in ("tags", "repos", "titles")))


def labelled_sessions(labels: DataFrame, items: DataFrame) -> DataFrame:
    """label_id, session_id: sessions whose items hold a label's text (label_id, text)."""
    return labels.join(items.select("text", F.explode("source_sessions").alias("session_id")), "text").select("label_id", "session_id").distinct()
