"""From evaluation events to relevance scores, evidence and pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import values as V


_MAP = "struct<a:double,b:double,lo:double,hi:double>"
_WIDE = 1e300


def _composed(maps: Column) -> Column:
    """The clamped line that a list of them gives one after another, as a, b, lo, hi of x -> min(hi, max(lo, a x + b)).

    Clamped lines with a >= 0 are closed under composition, so a list may be cut anywhere and its
    parts composed apart.
    """

    def then(f: Column, g: Column) -> Column:
        into = lambda x: F.greatest(g["lo"], F.least(g["hi"], g["a"] * x + g["b"]))
        return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), into(f["lo"]).alias("lo"), into(f["hi"]).alias("hi"))

    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-_WIDE).alias("lo"), F.lit(_WIDE).alias("hi"))
    return F.aggregate(maps, same.cast(_MAP), then)


def relevance(events: DataFrame, alpha: float = V.EMA_ALPHA, limit: float = V.EMA_LIMIT, width: int = 4096) -> DataFrame:
    """Ordered fold of events (item_id, tag, raw, weight, seq) to clamped averages and counters.

    An event moves the score by s = clamp((1 - alpha) * s + alpha * raw * weight), which is a clamped
    line in s. Events of a pair are composed in ranges of ``width`` values of seq, ranges in ranges
    of ranges, and those to one line, applied to 0: no list holds more than ``width`` events of a
    pair whose seq is unique, and a pair that most events belong to is many groups.
    """
    w = F.lit(float(width))
    line = F.struct(F.lit(1.0 - alpha).alias("a"), (alpha * F.col("raw") * F.col("weight")).alias("b"), F.lit(float(-limit)).alias("lo"), F.lit(float(limit)).alias("hi"))
    one = events.select("item_id", "tag", "seq", F.floor(F.col("seq") / w).alias("_r"), line.alias("_f"), (F.col("raw") > 0).cast("int").alias("_pos"), (F.col("raw") < 0).cast("int").alias("_neg"))
    keys, at = ["item_id", "tag"], "seq"
    for by in (["_r"], ["_q"], []):
        lines = F.transform(F.array_sort(F.collect_list(F.struct(at, "_f"))), lambda x: x["_f"])
        one = one.groupBy(*keys, *by).agg(_composed(lines).alias("_f"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"), F.max("seq").alias("seq"))
        if by == ["_r"]:
            one = one.withColumn("_q", F.floor(F.col("_r") / w))
        at = by[0] if by else at
    score = F.greatest(F.col("_f.lo"), F.least(F.col("_f.hi"), F.col("_f.b")))
    return one.select("item_id", "tag", score.alias("score"), F.col("_pos").cast("int").alias("positive_evals"), F.col("_neg").cast("int").alias("negative_evals"), F.col("seq").alias("last_seq"))


def relevance_bounded(events: DataFrame, alpha: float = V.EMA_ALPHA) -> DataFrame:
    """relevance() for events whose |raw * weight| never exceeds the limit: the clamp cannot fire, so lines without bounds are composed."""
    return relevance(events, alpha, _WIDE).drop("last_seq")


def mean_over_rows(rel: DataFrame, tags: list[str]) -> DataFrame:
    """item_id, avg over the item's rows among tags."""
    return rel.where(F.col("tag").isin(tags)).groupBy("item_id").agg(F.avg("score").alias("avg_score"))


def mean_over_requested(items: DataFrame, rel: DataFrame, tags: list[str]) -> DataFrame:
    """item_id, avg over all requested tags (0 where there is no row), evidence."""
    hits = rel.where(F.col("tag").isin(tags)).groupBy("item_id").agg((F.sum("score") / len(set(tags))).alias("avg_score"), F.sum(F.col("positive_evals") + F.col("negative_evals")).alias("evidence"))
    return items.select(F.col("id").alias("item_id")).join(hits, "item_id", "left").na.fill({"avg_score": 0.0, "evidence": 0})


def pin_statistics(rel: DataFrame) -> DataFrame:
    n = F.col("pos") + F.col("neg")
    return rel.groupBy("item_id").agg(F.avg("score").alias("avg_score"), F.sum("positive_evals").alias("pos"), F.sum("negative_evals").alias("neg")).withColumn("rate", F.when(n > 0, F.col("pos") / n).otherwise(0.0))


def pin_state(rel: DataFrame, items: DataFrame) -> DataFrame:
    """id, pinned, auto_pinned after judging final statistics.

    items: id, pinned, auto_pinned. An item is pinned on strong evidence, and unpinned only if it
    was pinned automatically.
    """
    s = items.join(pin_statistics(rel).withColumnRenamed("item_id", "id"), "id", "left")
    enough = F.coalesce(F.col("pos") + F.col("neg") >= V.PIN_EVALUATIONS, F.lit(False))
    pin = ~F.col("pinned") & enough & (F.col("avg_score") > V.PIN_SCORE) & (F.col("rate") >= V.PIN_RATE)
    unpin = F.col("pinned") & F.coalesce("auto_pinned", F.lit(False)) & enough & (F.col("avg_score") < V.UNPIN_SCORE)
    return s.select("id", F.when(pin, True).when(unpin, False).otherwise(F.col("pinned")).alias("pinned"), F.when(pin, True).when(unpin, False).otherwise(F.coalesce("auto_pinned", F.lit(False))).alias("auto_pinned"))


def pin_history(events: DataFrame, alpha: float = V.EMA_ALPHA, limit: float = V.EMA_LIMIT) -> DataFrame:
    """item_id, seq, pinned: every change of state when pins are judged after each event.

    The state of an item is a map of its tags, so its events are folded in order by one Python
    group; items are independent.
    """

    def fold(g):
        import pandas as pd

        scores, pos, neg, pinned, out = {}, 0, 0, False, []
        for r in g.sort_values("seq").itertuples():
            s = (1 - alpha) * scores.get(r.tag, 0.0) + alpha * r.raw * r.weight
            scores[r.tag] = max(-limit, min(limit, s))
            pos, neg = pos + (r.raw > 0), neg + (r.raw < 0)
            avg, n = sum(scores.values()) / len(scores), pos + neg
            if not pinned and n >= V.PIN_EVALUATIONS and avg > V.PIN_SCORE and pos / n >= V.PIN_RATE:
                pinned = True
                out.append((r.item_id, r.seq, True))
            elif pinned and n >= V.PIN_EVALUATIONS and avg < V.UNPIN_SCORE:
                pinned = False
                out.append((r.item_id, r.seq, False))
        return pd.DataFrame(out, columns=["item_id", "seq", "pinned"]).astype({"item_id": "int64", "seq": "int64", "pinned": "bool"})

    return events.select("item_id", "tag", "raw", "weight", "seq").groupBy("item_id").applyInPandas(fold, "item_id long, seq long, pinned boolean")


def evaluation_batches(shown: DataFrame, items: DataFrame, size: int = 15) -> DataFrame:
    """session_id, batch, ids: the known items shown in a session (session_id, item_id), in order of id, by batches of at most ``size``.

    Places in a session come from a window by session; what a session was shown is bounded by what
    fits a conversation.
    """
    known = shown.select("session_id", "item_id").distinct().join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    w = Window.partitionBy("session_id").orderBy("item_id")
    placed = known.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    return placed.groupBy("session_id", "batch").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))


def attribution_events(verdicts: DataFrame, item_tags: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """Tag events of evaluation verdicts (item_id, repo, score -3..3, found, seq).

    The repository's tag gets the score in [-1, 1]; an item's other tags get it weighted by their
    similarity (item_id, tag, sim) where some weight is positive, else all of them in full.
    """
    v = verdicts.select("item_id", "repo", "seq", (T.capped_score("score", "found") / 3.0).alias("raw")).where("raw <> 0")
    repo = v.where("repo is not null").select("item_id", F.concat(F.lit("repo:"), "repo").alias("tag"), "raw", F.lit(1.0).alias("weight"), "seq")
    tags = item_tags.where(~F.col("tag").startswith("repo:")).select("item_id", "tag")
    if similarity is None:
        weighted = tags.withColumn("w", F.lit(None).cast("double"))
    else:
        weighted = tags.join(similarity.select("item_id", "tag", T.attribution("sim").alias("w")), ["item_id", "tag"], "left")
    some = weighted.where("w > 0").select("item_id").distinct().withColumn("some", F.lit(True))
    plan = weighted.join(some, "item_id", "left").where("some is null or w > 0").select("item_id", "tag", F.when(F.col("some"), F.col("w")).otherwise(1.0).alias("share"))
    content = v.join(plan, "item_id").select("item_id", "tag", (F.col("raw") * F.col("share")).alias("raw"), F.lit(1.0).alias("weight"), "seq")
    return repo.unionByName(content)


def explicit_feedback(feedback: DataFrame, item_tags: DataFrame) -> DataFrame:
    """Tag events of direct feedback (item_id, applicable, tag_scores map, seq).

    Scores given by tag count double, for tags the item has or that are namespaced; without any,
    all its tags move by half a point.
    """
    given = feedback.where(F.size(F.coalesce("tag_scores", F.create_map().cast("map<string,double>"))) > 0).select("item_id", "seq", F.explode("tag_scores").alias("tag", "raw"))
    known = given.join(item_tags.select("item_id", "tag").withColumn("has", F.lit(True)), ["item_id", "tag"], "left").where("has or contains(tag, ':')").select("item_id", "tag", "raw", F.lit(2.0).alias("weight"), "seq")
    plain = feedback.where(F.size(F.coalesce("tag_scores", F.create_map().cast("map<string,double>"))) == 0).join(item_tags, "item_id").select("item_id", "tag", F.when(F.col("applicable"), 0.5).otherwise(-0.5).alias("raw"), F.lit(1.0).alias("weight"), "seq")
    return known.unionByName(plain)


def merged_relevance(rel: DataFrame, id_map: DataFrame) -> DataFrame:
    """Relevance of merged items: evidence-weighted means; without evidence the survivor's row, then the least absorbed id."""
    m = rel.join(id_map.withColumnRenamed("absorbed", "item_id"), "item_id", "left").withColumn("to", F.coalesce("survivor", "item_id"))
    ev = F.col("positive_evals") + F.col("negative_evals")
    first = F.min_by("score", F.struct((F.col("item_id") != F.col("to")).cast("int"), "item_id"))
    return m.groupBy(F.col("to").alias("item_id"), "tag").agg(
        F.when(F.sum(ev) > 0, F.sum(F.col("score") * ev) / F.sum(ev)).otherwise(first).alias("score"),
        F.sum("positive_evals").cast("int").alias("positive_evals"),
        F.sum("negative_evals").cast("int").alias("negative_evals"),
    )


def evaluation_status(attempts: DataFrame) -> DataFrame:
    """session_id, status, retry_count: last status; only failures count as retries."""
    return attempts.groupBy("session_id").agg(F.max_by("status", "ts").alias("status"), F.count_if(F.col("status") == "failed").cast("int").alias("retry_count"))


def pending(audit: DataFrame, processed: DataFrame, limit: int | None = None, disabled: list[str] | None = None, retries: int = 3) -> DataFrame:
    """Sessions still to evaluate, oldest first; the limit is cut before disabled repositories go."""
    j = audit.join(processed.select("session_id", "status", "retry_count"), "session_id", "left")
    out = j.where(F.col("status").isNull() | ((F.col("status") != "completed") & (F.col("retry_count") < retries))).orderBy("ts", "session_id")
    if limit is not None:
        out = out.limit(limit)
    return out.where(~F.coalesce(F.col("repo").isin(disabled), F.lit(False))) if disabled else out
