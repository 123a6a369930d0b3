"""Connected components of an edge table, by alternating star contractions.

Each round points neighbours at smaller ones: first every larger neighbour of a vertex at the least
vertex around it, then every smaller neighbour likewise. Minima are aggregates, so a vertex with
very many edges is combined before the shuffle and never gathered. Rounds are written to shared
storage, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _state(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], int(r["s"] or 0)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of edges (u, v): component is the least id it can reach."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(e)
    for _ in range(most_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
        # edges (u, v) with u > v: the larger end u of vertex v goes to the least around v
        large = e.join(least, e["v"] == F.col("w")).select("u", F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        joined = large.join(low, large["u"] == F.col("w"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "edges")
        now = _state(new)
        discard(e)
        discard(large)
        e = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots).groupBy("id").agg(F.min("component").alias("component"))
