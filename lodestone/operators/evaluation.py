"""Reports over results, verdicts and labels (A10-A31 but A22, E07-E16 but E10-E12, W03-W09, T10, T11)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A useful result scores at least this much; a query that should abstain stays below that.
USEFUL, ABSTAIN = 0.40, 0.30
#: Weights of p1, p3, abstain, separation and useful in the three objectives.
OBJECTIVES = {"composite": (0.35, 0.20, 0.25, 0.10, 0.10), "hook": (0.30, 0.15, 0.35, 0.10, 0.10), "interactive": (0.25, 0.30, 0.10, 0.10, 0.25)}


def _share(hit: Column) -> Column:
    return F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))


def _judged(results: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """A row for each labelled query (and value of by): expect, best score (0 without results), hits among one and three."""
    first = results.where("rank0 = 0").select(*by, "query_id", F.col("id").alias("top"), F.col("score").alias("best"))
    three = results.where("rank0 < 3").groupBy(*by, "query_id").agg(F.collect_set("id").alias("three"))
    base = results.select(*by).distinct().crossJoin(labels) if by else labels
    j = base.join(first, [*by, "query_id"], "left").join(three, [*by, "query_id"], "left")
    j = j.withColumns({"h1": F.coalesce(F.array_contains("expected", F.col("top")), F.lit(False)), "h3": F.coalesce(F.arrays_overlap("expected", "three"), F.lit(False)), "best": F.coalesce("best", F.lit(0.0))})
    return j.drop("top", "three")


def _measured(judged: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of judged rows, by keys."""
    rel, use, no = (F.col("expect") == x for x in ("relevant", "useful", "abstain"))
    exact = rel & (F.size("expected") > 0)
    best = F.col("best")
    m = judged.groupBy(*by).agg(
        _share(F.when(exact, F.col("h1"))).alias("p1"),
        _share(F.when(exact, F.col("h3"))).alias("p3"),
        _share(F.when(use, best >= USEFUL)).alias("useful"),
        _share(F.when(no, best < ABSTAIN)).alias("abstain"),
        F.coalesce(F.stddev_samp(best), F.lit(0.0)).alias("score_std"),
        *(F.coalesce(F.avg(F.when(x, best)), F.lit(0.0)).alias(f"mean_{n}") for n, x in (("relevant", exact), ("useful", use), ("abstain", no))),
        F.count_if(exact | use | no).alias("n_labels"),
    )
    m = m.withColumn("separation", F.col("mean_relevant") - F.col("mean_abstain"))
    parts = [F.col("p1"), F.col("p3"), F.col("abstain"), F.least("separation", F.lit(1.0)), F.col("useful")]
    return m.withColumns({n: 1.0 - sum((p * x for p, x in zip(parts, w, strict=True)), F.lit(0.0)) for n, w in OBJECTIVES.items()})


def retrieval_metrics(results: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """p1, p3, useful, abstain, score_std, separation, the means behind it, n_labels and three objectives (lower is better), by extra keys.

    labels: query_id, expect (relevant, useful, abstain), expected array<long>; results: query_id,
    rank0, id, score (and keys). A query without results (filtered ones too) scores 0: it is no hit,
    not useful, and right to abstain. Separation counts as 1 at most in the objectives.
    """
    by = by or []
    return _measured(_judged(results, labels, by), by)


def bucket_metrics(results: DataFrame, labels: DataFrame) -> DataFrame:
    """retrieval_metrics() of each bucket: expect:<label> and type:<type> (labels.type; null is a prompt)."""
    keys = F.array(F.concat(F.lit("expect:"), "expect"), F.concat(F.lit("type:"), F.coalesce("type", F.lit("prompt"))))
    return _measured(_judged(results, labels, []).withColumn("bucket", F.explode(keys)), ["bucket"])


def yield_tiers(evaluations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, applied, relevant, neutral, negative and yield_rate of evaluations (relevance string, tag_scores map<string, double>).

    A relevance that is given decides (unknown ones are neutral). Without it the mean of the tag
    scores does: applied above 0.3, relevant above 0, negative below -0.1; no scores are neutral.
    """
    given = F.coalesce("relevance", F.lit(""))
    scores = F.map_values("tag_scores")
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores))
    inferred = F.when(mean > 0.3, "applied").when(mean > 0, "relevant").when(mean < -0.1, "negative").otherwise("neutral")
    tier = F.when(given == "", inferred).when(given.isin("applied", "relevant", "negative"), given).otherwise("neutral")
    g = evaluations.withColumn("_tier", tier).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("_tier") == t).alias(t) for t in ("applied", "relevant", "neutral", "negative")))
    return g.withColumn("yield_rate", F.round((F.col("applied") + F.col("relevant")) / F.greatest("total", F.lit(1)), 4))


def sweep(parts: DataFrame, labels: DataFrame, configs: DataFrame, top: int = 3) -> DataFrame:
    """Metrics of every configuration from cached score parts.

    parts: query_id, id, base, tag, repo, vec_best; configs: config_id, w_tag, w_repo, abstain,
    min_top1 (a small table, held by every task). Candidates are scored once per configuration
    where they lie; only the k best per query and configuration are shuffled on.
    """
    j = parts.crossJoin(F.broadcast(configs)).where(F.col("vec_best").isNull() | (F.col("vec_best") >= F.col("abstain")))
    s = j.withColumn("score", F.col("base") + F.col("w_tag") * F.col("tag") + F.col("w_repo") * F.col("repo"))
    w = Window.partitionBy("config_id", "query_id").orderBy(F.round("score", 9).desc(), "id")
    ranked = s.withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < top)
    best = ranked.withColumn("b", F.max("score").over(Window.partitionBy("config_id", "query_id"))).where(F.col("b") >= F.col("min_top1"))
    return retrieval_metrics(best.select("config_id", "query_id", "rank0", "id", "score"), labels, ["config_id"])


def best_configs(metrics: DataFrame, n: int = 20) -> DataFrame:
    return metrics.orderBy(F.round("composite", 9), "config_id").limit(n)


def tag_signal(rel: DataFrame) -> DataFrame:
    """How much the (item, tag) table knows: counts by sign and evidence, sums, means."""
    n = F.col("positive_evals") + F.col("negative_evals")
    return rel.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("score") > 0).alias("n_positive"), F.count_if(F.col("score") < 0).alias("n_negative"), F.count_if(n >= 3).alias("n_strong"), F.sum(n).alias("evaluations"), F.avg("score").alias("mean_score"), F.sum(F.abs("score")).alias("total_signal"))


def evidence_histogram(rel: DataFrame) -> DataFrame:
    return rel.groupBy((F.col("positive_evals") + F.col("negative_evals")).cast("long").alias("evals")).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("score").alias("mean_score"))


def recovery(rel: DataFrame) -> DataFrame:
    """Pairs that score badly though they were judged well before."""
    bad = F.col("score") < 0
    return rel.agg(F.count_if(bad).alias("n_bad"), F.count_if(bad & (F.col("positive_evals") > 0)).alias("n_recoverable"), F.sum(F.when(bad, F.col("score"))).alias("bad_sum"))


def tag_subsets(stats: DataFrame, least: int = 15, most_size: int = 4) -> DataFrame:
    """item_id, subset, support: the smallest tag subset whose weighted support reaches least.

    stats: item_id, tag_set array<string>, times_matched. Subsets of every observed set are counted
    where they occur; of those that reach the support the smallest, then alphabetically first, wins.
    """
    t = stats.select("item_id", F.array_sort(F.array_distinct("tag_set")).alias("s"), "times_matched")
    sub = F.transform("s", lambda x: F.array(x))
    level, every = sub, sub

    def longer(a: Column) -> Column:
        return F.transform(F.filter("s", lambda x: x > F.element_at(a, -1)), lambda x: F.concat(a, F.array(x)))

    for _ in range(most_size - 1):
        level = F.flatten(F.transform(level, longer))
        every = F.concat(every, level)
    e = t.select("item_id", "times_matched", F.explode(every).alias("subset"))
    c = e.groupBy("item_id", "subset").agg(F.sum("times_matched").cast("long").alias("support")).where(F.col("support") >= least)
    w = Window.partitionBy("item_id").orderBy(F.size("subset"), "subset")
    return c.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def trajectory(ranks: DataFrame, missing: int = 21) -> DataFrame:
    """query_id, first_rank, last_rank, improvement, converged: ranks (query_id, round, rank) over rounds.

    A missing rank counts as ``missing``; converged is the first round from 1 on that already has
    the final rank.
    """
    r = ranks.withColumn("rank", F.coalesce("rank", F.lit(missing)))
    g = r.groupBy("query_id").agg(F.min_by("rank", "round").alias("first_rank"), F.max_by("rank", "round").alias("last_rank"))
    conv = r.join(g, "query_id").where((F.col("round") >= 1) & (F.col("rank") == F.col("last_rank"))).groupBy("query_id").agg(F.min("round").alias("converged"))
    return g.join(conv, "query_id", "left").withColumn("improvement", F.col("first_rank") - F.col("last_rank"))


def trajectory_summary(t: DataFrame, n_rounds: int) -> DataFrame:
    """Sums over trajectory() of rounds 0 .. n_rounds - 1: improved queries, gains of first and of third places, mean convergence (n_rounds where there is none) and the composite."""
    n = lambda c, most: F.count_if(F.col(c) <= most)
    m = t.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("improvement") > 0).alias("improved"),
        F.avg("improvement").alias("avg_improvement"),
        (n("last_rank", 1) - n("first_rank", 1)).alias("top1_gain"),
        (n("last_rank", 3) - n("first_rank", 3)).alias("top3_gain"),
        F.avg(F.coalesce("converged", F.lit(n_rounds))).alias("avg_convergence"),
    ).where("total > 0")
    return m.withColumn("composite", F.col("top1_gain") * 3.0 + F.col("top3_gain") * 1.5 + F.col("improved") / F.col("total") * 5.0 + F.col("avg_improvement"))


def recall_metrics(matches: DataFrame, direct: float = 0.90, border: float = 0.80) -> DataFrame:
    """Direct, borderline and missed labels (kind good or bad, best similarity), recall and avoidance."""
    s = F.coalesce("similarity", F.lit(0.0))
    good, bad = F.col("kind") == "good", F.col("kind") == "bad"
    return matches.agg(F.count_if(s >= direct).alias("direct"), F.count_if((s < direct) & (s >= border)).alias("borderline"), F.count_if(s < border).alias("missed"), F.avg(F.when(good, (s >= 0.85).cast("double"))).alias("recall"), F.avg(F.when(bad, (s < 0.85).cast("double"))).alias("avoidance"))


def merge_precision(verdicts: DataFrame) -> DataFrame:
    """precision of judged merges (correct, partial, wrong, error)."""
    n = F.count_if(F.col("verdict") != "error")
    return verdicts.agg(((F.count_if(F.col("verdict") == "correct") + 0.5 * F.count_if(F.col("verdict") == "partial")) / n).alias("precision"), n.alias("judged"))


def judged_evaluations(evaluations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """item_id, avg_score, direction, verdict, judge_confidence: evaluations (item_id, tag_scores map) with a judge's verdicts (item_id, verdict, confidence).

    The direction is that of the mean score, neutral within 0.1 of 0. An evaluation that the judge
    gave no verdict for has the verdict error.
    """
    scores = F.map_values("tag_scores")
    mean = F.coalesce(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(scores), F.lit(0)), F.lit(0.0))
    e = evaluations.select("item_id", F.round(mean, 3).alias("avg_score"), F.when(mean > 0.1, "POSITIVE").when(mean < -0.1, "NEGATIVE").otherwise("NEUTRAL").alias("direction"))
    v = verdicts.select("item_id", "verdict", F.col("confidence").alias("judge_confidence"))
    return e.join(v, "item_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("error")))


def judged_merges(groups: DataFrame, items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """group_id, n_known, original_confidence, verdict, judge_confidence: merge groups (group_id, ids, confidence) with verdicts (group_id, verdict, confidence).

    Groups with fewer than two known items are not judged and left out.
    """
    known = groups.select("group_id", F.explode("ids").alias("id")).join(items.select("id"), "id", "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_known")).where("n_known >= 2")
    j = groups.select("group_id", F.col("confidence").alias("original_confidence")).join(known, "group_id")
    j = j.join(verdicts.select("group_id", "verdict", F.col("confidence").alias("judge_confidence")), "group_id", "left")
    return j.select("group_id", "n_known", "original_confidence", F.coalesce("verdict", F.lit("error")).alias("verdict"), "judge_confidence")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of items (item_id, score) on whose sign two judges agree."""
    sign = lambda c: F.when(F.col(c) > 0.1, 1).when(F.col(c) < -0.1, -1).otherwise(0)
    j = a.select("item_id", F.col("score").alias("x")).join(b.select("item_id", F.col("score").alias("y")), "item_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg((sign("x") == sign("y")).cast("double")).alias("agreement"))


def yield_by(results: DataFrame, by: str) -> DataFrame:
    """Two means of positive shares: of sessions' ratios (0 where a session has nothing) and pooled."""
    return results.groupBy(by).agg(F.avg(F.coalesce(F.col("positive") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))).alias("mean_ratio"), (F.sum("positive") / F.sum("total")).alias("pooled"), F.count(F.lit(1)).alias("n_sessions"))


def similarity_summary(parts: DataFrame) -> DataFrame:
    """mean_sim, max_sim, n_above of the parts that metric_join.pair_parts() gives."""
    return parts.agg((F.sum("total") / F.sum("n")).alias("mean_sim"), F.max("top").alias("max_sim"), F.coalesce(F.sum("n_above"), F.lit(0)).alias("n_above"))


def top_pairs(parts: DataFrame, k: int = 10) -> DataFrame:
    """a, b, similarity: the k best pairs of the parts."""
    return parts.select(F.inline("best")).orderBy(F.desc("similarity"), "a", "b").limit(k)


def reduction(groups: DataFrame) -> DataFrame:
    """kept groups, ids in them and share removed: a group counts if two of its ids are new.

    Groups (pos, ids) are folded in order, as each depends on those before it; all ids of a counted
    group are then known. One task streams the sorted groups and holds the known ids as a set, so
    its time grows with the groups and its memory with the ids.
    """

    def fold(batches):
        seen, kept = set(), 0
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                for ids in b.column(0).slice(i, 1000).to_pylist():
                    new = set(ids).difference(seen)
                    if len(new) >= 2:
                        seen |= new
                        kept += 1
        yield pa.RecordBatch.from_pydict({"kept": [kept], "known": [len(seen)]})

    one = groups.select("pos", "ids").repartition(1).sortWithinPartitions("pos", "ids").select("ids").mapInArrow(fold, "kept long, known long")
    n = one.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("int").alias(c) for c in ("kept", "known")))
    return n.select(F.col("kept").alias("n_groups"), F.col("known").alias("n_ids"), (F.col("known") - F.col("kept")).alias("n_removed"))


def judge_sample(scores: DataFrame, n: int) -> DataFrame:
    """The n items (item_id, avg_score) of largest absolute score, then largest score, then id."""
    return scores.orderBy(F.abs(F.round("avg_score", 9)).desc(), F.round("avg_score", 9).desc(), F.desc("item_id")).limit(n)


def divergence(results: DataFrame, a: str, b: str, least: float = 0.05) -> DataFrame:
    """query_id where two strategies (column strategy) differ in the top item or its score."""
    top = results.where("rank0 = 0").select("strategy", "query_id", "id", "score")
    x = top.where(F.col("strategy") == a).select("query_id", F.col("id").alias("ia"), F.col("score").alias("sa"))
    y = top.where(F.col("strategy") == b).select("query_id", F.col("id").alias("ib"), F.col("score").alias("sb"))
    j = x.join(y, "query_id", "full")
    return j.where(~F.col("ia").eqNullSafe(F.col("ib")) | (F.abs(F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0))) > least))


def pivot_report(rows: DataFrame, by: str, across: str, value: str) -> DataFrame:
    """Mean of value by one key, a column for each value of another; rows with errors left out."""
    return rows.where(F.col("error").isNull()).groupBy(by).pivot(across).agg(F.avg(value))


def threshold_report(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """threshold, n_pairs, n_items, mean_similarity of candidate pairs (source_id, target_id, similarity) from each threshold on."""
    j = pairs.crossJoin(F.broadcast(thresholds)).where(F.round("similarity", 9) >= F.col("threshold"))
    return j.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("source_id").alias("n_items"), F.avg("similarity").alias("mean_similarity"))


def variant_report(verdicts: DataFrame, baseline: str) -> DataFrame:
    """variant, n, positive, yield_ and agreement with the baseline variant on items that both judged.

    verdicts: variant, item_id, score (one a variant and item).
    """
    sign = F.when(F.col("score") > 0.1, 1).when(F.col("score") < -0.1, -1).otherwise(0)
    v = verdicts.select("variant", "item_id", sign.alias("sign"))
    base = v.where(F.col("variant") == baseline).select("item_id", F.col("sign").alias("base"))
    g = v.join(base, "item_id", "left").groupBy("variant")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sign") == 1).alias("positive"), F.avg((F.col("sign") == 1).cast("double")).alias("yield_"), F.avg((F.col("sign") == F.col("base")).cast("double")).alias("agreement"))
