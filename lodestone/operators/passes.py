"""Dedup in passes to a fixpoint; after the first one only what a merge may have touched meets again.

A pass judges candidate lists (each item's k most similar others), merges groups and gives new
vectors to survivors. A list stays as it is unless one of its entries was absorbed or changed, or a
changed survivor now belongs in it. So the next pass joins anew only changed survivors and items
that lost an entry, and lets the others meet the changed survivors alone; their stored lists carry
over. Lists equal those of a join of everything, which the tests hold them against.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.files import stored

from .metric_join import best_pairs

_PAIR = ("source_id", "target_id", "similarity")


@dataclass(frozen=True)
class Pass:
    """What a pass did: merged groups, absorbed items, and the items whose lists were joined anew before it."""

    groups: int
    absorbed: int
    joined: int


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(F.round("similarity", 9).desc(), "target_id")
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def next_lists(lists: DataFrame, vectors: DataFrame, absorbed: DataFrame, changed: DataFrame, least: float, k: int) -> tuple[DataFrame, int]:
    """Candidate lists of vectors (id, embedding) after a merge, from those before, and how many were joined anew.

    absorbed (id) are no longer among vectors, changed (id) have new ones there.
    """
    touched = absorbed.select("id").union(changed.select("id")).distinct()
    lost = lists.join(touched.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    again = stored(vectors.select("id").join(lost.union(changed.select("id")).distinct(), "id", "left_semi"))
    new = vectors.join(changed.select("id"), "id", "left_semi")
    redone = best_pairs(vectors.join(again, "id", "left_semi"), vectors, least, k).select(*_PAIR)
    rest = vectors.join(again, "id", "left_anti")
    come = best_pairs(rest, new, least, k).select(*_PAIR)
    kept = lists.join(rest.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*_PAIR)
    return stored(_top(kept.unionByName(come), k).unionByName(redone)), again.count()


def dedup_passes(vectors: DataFrame, judge: Callable[[DataFrame], DataFrame], revise: Callable[[DataFrame, DataFrame], DataFrame], least: float = 0.5, k: int = 8, most: int = 10, single: bool = False, scan_only: bool = False) -> tuple[DataFrame, DataFrame, list[Pass]]:
    """Passes over vectors (id, embedding) until one merges nothing, at most ``most`` or a single one.

    judge(lists) gives disjoint merges (survivor, absorbed) for lists (source_id, target_id, similarity); revise(merges,
    vectors) the new vectors (id, embedding) of survivors. Gives the vectors that are left, all
    merges in order (pass, survivor, absorbed), and what each pass did. scan_only judges once and merges nothing.
    """
    spark = vectors.sparkSession
    now = stored(vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")))
    lists, joined = stored(best_pairs(now, now, least, k).select(*_PAIR)), now.count()
    log = spark.createDataFrame([], "pass int, survivor long, absorbed long")
    done: list[Pass] = []
    while len(done) < (1 if single or scan_only else most):
        merges = stored(judge(lists).select("survivor", "absorbed"))
        n = merges.agg(F.countDistinct("survivor").alias("groups"), F.count(F.lit(1)).alias("absorbed")).first()
        done.append(Pass(n.groups, n.absorbed, joined))
        log = log.unionByName(merges.select(F.lit(len(done)).alias("pass"), "survivor", "absorbed"))
        if not n.absorbed or scan_only:
            break
        new = stored(revise(merges, now).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")))
        gone = merges.select(F.col("absorbed").alias("id"))
        now = stored(now.join(gone.union(new.select("id")), "id", "left_anti").unionByName(new))
        lists, joined = next_lists(lists, now, gone, new, least, k)
    return now, log, done


def mutual_nearest(lists: DataFrame) -> DataFrame:
    """Merges of pairs that are each other's most similar item; the smaller id survives."""
    first = _top(lists, 1)
    back = first.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"))
    return first.join(back, ["source_id", "target_id"], "left_semi").where("source_id < target_id").select(F.col("source_id").alias("survivor"), F.col("target_id").alias("absorbed"))


def summed(merges: DataFrame, vectors: DataFrame) -> DataFrame:
    """The sum of a group's vectors as that of its survivor."""
    member = merges.select("survivor", F.col("absorbed").alias("id")).unionByName(merges.select("survivor", F.col("survivor").alias("id")).distinct())
    x = member.join(vectors, "id").select("survivor", F.posexplode("embedding").alias("at", "x")).groupBy("survivor", "at").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return x.groupBy("survivor").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"].cast("float")).alias("embedding")).withColumnRenamed("survivor", "id")
