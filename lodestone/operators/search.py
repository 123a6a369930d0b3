"""Hybrid retrieval for a whole set of queries at once: BM25, vectors, rank fusion and priors.

Every function takes and returns DataFrames keyed by query_id and id, so a query set is one plan.
Ties are broken by score rounded to nine digits, then id. Query sets are taken in blocks of bounded
size: the two lists need the blocks on the driver, so they run small jobs while the plan is built.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import values as V


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score") -> DataFrame:
    """rank0 and the k best rows of each query."""
    w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col("id"))
    return scored.withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < k)


class Best:
    """The k best (score rounded to nine digits, then least id) of each of n queries, fed in batches."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, 0), -np.inf), np.zeros((n, 0), np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row per query, a column per id; -inf for no candidate."""
        s = np.concatenate([self.scores, scores], 1)
        i = np.concatenate([self.ids, np.broadcast_to(ids, scores.shape)], 1)
        if s.shape[1] <= self.k:
            self.scores, self.ids = s, i
            return
        r = -np.round(s, 9)
        least = np.partition(r, self.k - 1, axis=1)[:, self.k - 1]
        row, col = np.nonzero(r <= least[:, None])
        order = np.lexsort((i[row, col], r[row, col], row))
        row, col = row[order], col[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[nth < self.k].reshape(-1, self.k), col[nth < self.k].reshape(-1, self.k)
        self.scores, self.ids = s[row, col], i[row, col]

    def batch(self, query_ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        row, col = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(self.ids[row, col]), pa.array(self.scores[row, col])], schema=schema)


_FOUND = "query_id long, id long, score double"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


# --- lists ------------------------------------------------------------------------------------
def bm25(items: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, block: int = 2000) -> DataFrame:
    """query_id, id, score, rank0: best items (id, text) that share a token with a query (query_id, text).

    Negative idf is replaced by ``floor`` times the mean idf of the vocabulary. Document frequencies
    come from one token scan. Then each block of at most ``block`` queries, with the idf of its
    terms, goes to all tasks; a task scores its items as they stream by and keeps k per query.
    """
    docs = items.select(F.col("id").cast("long").alias("id"), F.coalesce(T.tokens("text"), F.array().cast("array<string>")).alias("tokens"))
    n = items.count()
    seen = docs.select(F.posexplode(F.array_distinct("tokens")).alias("pos", "term"), F.size("tokens").alias("dl"))
    df = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("pos") == 0, F.col("dl"))).alias("dl")).persist()
    raw = F.log(F.lit(n + 0.5) - F.col("df")) - F.log(F.col("df") + 0.5)
    stats = df.agg(F.sum("dl").alias("total"), F.avg(raw).alias("mean")).first()
    avgdl, low = (stats["total"] or 0) / n if n else 0.0, floor * (stats["mean"] or 0.0)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce(T.tokens("text"), F.array().cast("array<string>")).alias("tokens"))
    out = None
    for rows in _blocks_of(asked, block):
        counts = [Counter(r.tokens) for r in rows]
        words = docs.sparkSession.createDataFrame([(w,) for w in sorted(set().union(*counts))], "term string")
        idf = {r.term: low if r.raw < 0 else r.raw for r in df.join(F.broadcast(words), "term").select("term", raw.alias("raw")).collect()}
        terms = sorted(idf)
        place = {w: i for i, w in enumerate(terms)}
        use = sorted((place[w], q, c * idf[w]) for q, cs in enumerate(counts) for w, c in cs.items() if w in place)
        t, q, weight = (np.array(x) for x in zip(*use, strict=True)) if use else (np.zeros(0, np.int64),) * 3
        starts = np.searchsorted(t, np.arange(len(terms) + 1))
        ids = np.array([r.query_id for r in rows], np.int64)
        shared = docs.sparkSession.sparkContext.broadcast((ids, terms, starts, q.astype(np.int64), weight.astype(np.float64)))
        part = docs.mapInArrow(_bm25_scan(shared, k, k1, b, avgdl), _FOUND)
        out = part if out is None else out.unionAll(part)
    df.unpersist()
    return top_k(docs.sparkSession.createDataFrame([], _FOUND) if out is None else out, k)


#: Matches of tokens and queries that a scan holds at a time (one item's may be more).
_MATCHES = 1 << 18


def _bm25_scan(shared, k: int, k1: float, b: float, avgdl: float):
    def run(batches):
        query_ids, terms, starts, q, weight = shared.value
        best, words, n_q = Best(len(query_ids), k), pa.array(terms, pa.string()), len(query_ids)
        for t in _slices(batches, max(1, min(1000, 1_000_000 // max(1, n_q)))):
            ids, tokens = t.column("id").to_numpy(zero_copy_only=False), t.column("tokens")
            size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(ids)), size)[term >= 0]
            key, tf = np.unique(doc * max(1, len(terms)) + term[term >= 0], return_counts=True)
            if not len(key):
                continue
            doc, term = key // len(terms), key % len(terms)
            value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / avgdl))
            n = starts[term + 1] - starts[term]
            part = (np.cumsum(n) - n) // _MATCHES
            edges = np.unique(np.concatenate([np.searchsorted(doc, doc[np.flatnonzero(np.diff(part, prepend=-1))]), [len(doc)]]))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # whole items, so that sums keep their order
                first, m, of = doc[x], n[x:y], doc[x:y] - doc[x]
                own = ids[first : doc[y - 1] + 1]
                at = np.arange(m.sum()) + np.repeat(starts[term[x:y]] - (np.cumsum(m) - m), m)
                cell = np.repeat(of, m) + q[at] * len(own)
                score = np.bincount(cell, weights=np.repeat(value[x:y], m) * weight[at], minlength=n_q * len(own))
                score[np.bincount(cell, minlength=len(score)) == 0] = -np.inf
                best.add(own, score.reshape(n_q, len(own)))
        yield best.batch(query_ids, _FOUND_ARROW)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2000) -> DataFrame:
    """query_id, id, score, rank0: best vectors (id, embedding) by cosine for queries (query_id, embedding).

    The query set is taken in blocks of at most ``block`` rows, each a matrix that goes to all
    tasks; a task keeps k rows per query, and one small shuffle picks the k best of all.
    """

    def scan(shared):
        def run(batches):
            ids_q, m = shared.value
            best = Best(len(ids_q), k)
            for t in _slices(batches, 1000):
                best.add(t.column("id").to_numpy(zero_copy_only=False), m @ _unit(t.column("embedding").to_pylist()).T)
            yield best.batch(ids_q, _FOUND_ARROW)

        return run

    return top_k(_scanned(vectors, queries, scan, _FOUND, block), k)


def similarities(vectors: DataFrame, queries: DataFrame, block: int = 2000, rows: int = 250) -> DataFrame:
    """query_id, id, score: the cosine of every query with every vector, in the blocks of nearest().

    A task streams its vectors, ``rows`` at a time against the block; nothing is ranked, capped or shuffled.
    """
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def scan(shared):
        def run(batches):
            ids_q, m = shared.value
            for t in _slices(batches, rows):
                ids = t.column("id").to_numpy(zero_copy_only=False)
                s = m @ _unit(t.column("embedding").to_pylist()).T
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids_q, len(ids))), pa.array(np.tile(ids, len(ids_q))), pa.array(s.ravel())], schema=schema)

        return run

    return _scanned(vectors, queries, scan, "query_id long, id long, score double", block)


def _unit(embeddings: list) -> np.ndarray:
    e = np.array(embeddings, np.float64)
    return e / (np.sqrt((e * e).sum(1, keepdims=True)) + 1e-10)


def _slices(batches, rows: int):
    for t in batches:
        for i in range(0, t.num_rows, rows):
            yield t.slice(i, rows)


def _blocks_of(rows: DataFrame, block: int):
    """Lists of at most ``block`` rows, fetched a partition at a time."""
    held = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def _scanned(vectors: DataFrame, queries: DataFrame, scan, schema: str, block: int) -> DataFrame:
    """Union of scan(broadcast of ids and unit vectors) over vectors, for blocks of queries."""
    spark = vectors.sparkSession
    out = None
    slim = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
    for rows in _blocks_of(queries.where("embedding is not null").select("query_id", "embedding"), block):
        shared = spark.sparkContext.broadcast((np.array([r.query_id for r in rows], np.int64), _unit([r.embedding for r in rows])))
        part = slim.mapInArrow(scan(shared), schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out


def rescope(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """Drops ids outside items after a top-k was cut, and numbers the rest anew."""
    w = Window.partitionBy("query_id").orderBy("rank0")
    return ranked.join(items.select("id"), "id", "left_semi").withColumn("rank0", F.row_number().over(w) - 1)


# --- fusion -----------------------------------------------------------------------------------
def anchors(items: DataFrame) -> DataFrame:
    """k, ceiling, floor of rank fusion over items, as one row."""
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    one = items.agg(F.count(F.lit(1)).alias("n")).select(k.cast("int").alias("k"))
    return one.select("k", (F.lit(2.0) / (F.col("k") + 1)).alias("ceiling"), (F.lit(1.0) / (F.col("k") + 10)).alias("floor"))


def fuse(lists: list[DataFrame], scale: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """query_id, id, rrf, score: sum of 1 / (k + rank0 + 1) over ranked lists, and that between the anchors of scale.

    With names, also the score of each list under its name, null where the list does not hold the id.
    """
    both = None
    for i, x in enumerate(lists):
        own = [(F.col("score") if i == j else F.lit(None).cast("double")).alias(n) for j, n in enumerate(names)]
        x = x.select("query_id", "id", "rank0", *own)
        both = x if both is None else both.unionByName(x)
    j = both.crossJoin(F.broadcast(scale))  # one row
    f = j.groupBy("query_id", "id").agg(F.sum(1.0 / (F.col("k") + 1 + F.col("rank0"))).alias("rrf"), F.first("ceiling").alias("ceiling"), F.first("floor").alias("floor"), *(F.max(n).alias(n) for n in names))
    return f.select("query_id", "id", "rrf", ((F.col("rrf") - F.col("floor")) / (F.col("ceiling") - F.col("floor"))).alias("score"), *names)


def abstain(fused: DataFrame, vector_list: DataFrame, least: float = 0.55) -> DataFrame:
    """Drops queries whose best vector similarity is below least; queries without vectors stay."""
    weak = vector_list.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") < least)
    return fused.join(weak, "query_id", "left_anti")


def best_at_least(results: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Empties queries whose best result is below least."""
    w = Window.partitionBy("query_id")
    return results.withColumn("_best", F.max(score).over(w)).where(F.col("_best") >= least).drop("_best")


# --- priors -----------------------------------------------------------------------------------
def repo_prior(relevance: DataFrame, tag_of_repo: Column | str) -> DataFrame:
    """id, repo_prior for items with enough evaluations on the repository's tag."""
    n = F.col("positive_evals") + F.col("negative_evals")
    s = F.col("score")
    value = F.when(s > 0, 0.05 * F.least(s, F.lit(1.0))).when(s < 0, -0.08 * F.least(F.abs(s), F.lit(1.0))).otherwise(0.0)
    return relevance.where((F.col("tag") == tag_of_repo) & (n >= 3)).select(F.col("item_id").alias("id"), value.alias("repo_prior"))


def prompt_tags(similar: DataFrame, vocabulary: DataFrame, queries: DataFrame, top: int = 3, least: float = 0.6, damping: float = 0.3, gap_after: int | None = None) -> DataFrame:
    """query_id, tag, tag_score: vocabulary tags that a query is about.

    similar: query_id, tag, sim; vocabulary: tag, freq; queries: query_id, text. A query that is
    close to a large share of the vocabulary abstains; with more than ``gap_after`` (default: top)
    tags left, so does one whose best tag does not stand out from the median.
    """
    most = vocabulary.agg(F.max("freq").alias("most"), F.count(F.lit(1)).alias("n_tags"))
    s = similar.join(vocabulary, "tag", "left").crossJoin(F.broadcast(most))
    s = s.select("query_id", "tag", "n_tags", (F.col("sim") * (1 - damping * F.coalesce(F.col("freq"), F.lit(1)) / F.col("most"))).alias("tag_score")).where(F.col("tag_score") >= least)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    q = queries.where(F.length("text") >= 3).select("query_id", words.alias("words"))
    share = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), F.sort_array(F.collect_list(F.round("tag_score", 9)), False).alias("all"), F.max("n_tags").alias("n_tags")).join(q, "query_id")
    limit = F.least(0.30 + 0.03 * F.col("words"), F.lit(0.55))
    ok = share.where(F.col("m") / F.col("n_tags") <= limit)
    best, middle = F.get("all", F.lit(0)), F.get("all", F.floor(F.col("m") / 2).cast("int"))
    crowded = F.col("m") > (top if gap_after is None else gap_after)
    ok = ok.where(~crowded | (best - middle >= 0.03)).select("query_id", F.when(crowded, best - 0.6 * (best - middle)).otherwise(F.lit(-1.0)).alias("cut"))
    kept = s.join(ok, "query_id").where(F.round("tag_score", 9) >= F.round("cut", 9))
    w = Window.partitionBy("query_id").orderBy(F.round("tag_score", 9).desc(), "tag")
    return kept.withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < top).select("query_id", "tag", "tag_score", "rank0")


def affinity(candidates: DataFrame, item_tags: DataFrame, prompt: DataFrame, tag_pairs: DataFrame, weight: float = 0.25, floor: float = 0.5, miss: float = 0.20, penalty: float = 0.0) -> DataFrame:
    """query_id, id, affinity: squared closeness of item tags to prompt tags, or a penalty.

    tag_pairs: tag, other, sim (vocabulary similarities). Untagged items get half the penalty;
    queries without prompt tags get nothing.
    """
    asked = prompt.select("query_id", F.col("tag").alias("other"))
    tagged = candidates.select("query_id", "id").join(item_tags.select(F.col("item_id").alias("id"), "tag"), "id")
    best = tagged.join(asked, "query_id").join(tag_pairs, ["tag", "other"]).groupBy("query_id", "id", "tag").agg(F.max("sim").alias("b"))
    gain = F.greatest(F.lit(0.0), (F.col("b") - floor) / (1 - floor))
    agg = best.groupBy("query_id", "id").agg(F.sum(gain * gain).alias("gain"), F.max("b").alias("near"))
    has = tagged.select("query_id", "id").distinct().withColumn("tagged", F.lit(True))
    base = candidates.select("query_id", "id").join(asked.select("query_id").distinct(), "query_id", "left_semi")
    value = F.when(F.col("tagged").isNull(), penalty / 2).when(F.coalesce("near", F.lit(0.0)) < miss, penalty).otherwise(weight * F.col("gain"))
    return base.join(has, ["query_id", "id"], "left").join(agg, ["query_id", "id"], "left").select("query_id", "id", value.alias("affinity"))


def feedback(candidates: DataFrame, item_tags: DataFrame, relevance: DataFrame) -> DataFrame:
    """candidates with feedback added to score, rejected ones dropped.

    The mean runs over an item's requested tags (matched ones where candidates carry an array
    column matched, else all), tags without a score counting as 0.
    """
    tags = item_tags.select(F.col("item_id").alias("id"), "tag")
    rel = relevance.select(F.col("item_id").alias("id"), "tag", F.col("score").alias("rel"), (F.col("positive_evals") + F.col("negative_evals")).alias("ev"))
    per = tags.join(rel, ["id", "tag"], "left").groupBy("id").agg((F.sum(F.coalesce("rel", F.lit(0.0))) / F.count(F.lit(1))).alias("avg_rel"), F.sum(F.coalesce("ev", F.lit(0))).alias("evals"))
    j = candidates.join(per, "id", "left")
    drop = (F.coalesce("evals", F.lit(0)) >= V.FEEDBACK_EVALUATIONS) & (F.coalesce("avg_rel", F.lit(0.0)) < V.FEEDBACK_FLOOR)
    return j.where(~drop).withColumn("feedback", V.FEEDBACK_WEIGHT * F.coalesce("avg_rel", F.lit(0.0))).withColumn("score", F.col("score") + F.col("feedback")).drop("avg_rel", "evals")


def in_category(items: DataFrame, bridge: DataFrame, prefix: str) -> DataFrame:
    """Items whose own category, or one linked by bridge (item_id, path), starts with prefix."""
    ids = items.where(F.col("category").startswith(prefix)).select("id").union(bridge.where(F.col("path").startswith(prefix)).select("item_id")).distinct()
    return items.join(ids, "id", "left_semi")


def with_all_tags(items: DataFrame, item_tags: DataFrame, tags: list[str]) -> DataFrame:
    """Items that hold every one of tags."""
    want = sorted(set(tags))
    has = item_tags.where(F.col("tag").isin(want)).groupBy("item_id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(want))
    return items.join(has.select(F.col("item_id").alias("id")), "id", "left_semi")


def not_shown(results: DataFrame, shown: DataFrame) -> DataFrame:
    """Results (session_id, id, ...) that a session has not seen."""
    return results.join(shown.select("session_id", F.col("item_id").alias("id")), ["session_id", "id"], "left_anti")


def isolated_scope(items: DataFrame, item_tags: DataFrame, audit: DataFrame, repo: str, isolated: list[str]) -> DataFrame:
    """Items that a repository may see: those tied to an isolated repository only show there.

    Ties come from origin_repo, repo: tags and the repositories of source sessions.
    """
    own = items.where("origin_repo is not null").select("id", F.col("origin_repo").alias("repo"))
    tagged = item_tags.where(F.col("tag").startswith("repo:")).select(F.col("item_id").alias("id"), F.expr("substring(tag, 6)").alias("repo"))
    from_sessions = items.select("id", F.explode("source_sessions").alias("session_id")).join(audit.select("session_id", "repo"), "session_id").select("id", "repo")
    ties = own.unionByName(tagged).unionByName(from_sessions).where(F.col("repo").isNotNull()).distinct()
    if repo in isolated:
        return items.join(ties.where(F.col("repo") == repo).select("id"), "id", "left_semi")
    return items.join(ties.where(F.col("repo").isin(isolated or [""])).select("id"), "id", "left_anti")


@dataclass(frozen=True)
class Settings:
    """Thresholds and weights of search(); the defaults are those of a normal session."""

    list_size: int = 10
    top: int = 3
    abstain_below: float = 0.55
    min_top1: float = 0.40
    floor: float | None = None
    tag_weight: float = 0.25
    tag_floor: float = 0.5
    tag_miss: float = 0.20
    tag_penalty: float = 0.0
    feedback_weight: float = V.FEEDBACK_WEIGHT
    recency: float = 0.003


def tag_evidence(candidates: DataFrame, item_tags: DataFrame, prompt: DataFrame | None, tag_pairs: DataFrame | None, relevance: DataFrame | None, floor: float) -> DataFrame:
    """query_id, id, asked, gain, near, avg_rel, evals: what the content tags of candidates say.

    Each tag gets its best similarity to the query's prompt tags (gain: sum of squares above floor,
    near: the best). Relevance is averaged over the tags from floor on if there are any, else over
    all; tags without a score count as 0.
    """
    t = candidates.select("query_id", "id").join(item_tags.select(F.col("item_id").alias("id"), "tag"), "id")
    if prompt is not None and tag_pairs is not None:
        asked = prompt.groupBy("query_id").agg(F.collect_set("tag").alias("others"))
        e = t.join(asked, "query_id", "left").select("query_id", "id", "tag", F.explode_outer("others").alias("other"))
        e = e.join(tag_pairs.select("tag", "other", "sim"), ["tag", "other"], "left")
        t = e.groupBy("query_id", "id", "tag").agg(F.max("sim").alias("b"), F.max(F.col("other").isNotNull()).alias("asked"))
    else:
        t = t.select("query_id", "id", "tag", F.lit(None).cast("double").alias("b"), F.lit(False).alias("asked"))
    if relevance is not None:
        t = t.join(relevance.select(F.col("item_id").alias("id"), "tag", F.col("score").alias("rel"), (F.col("positive_evals") + F.col("negative_evals")).alias("ev")), ["id", "tag"], "left")
    else:
        t = t.withColumns({"rel": F.lit(0.0), "ev": F.lit(0)})
    hit = F.coalesce(F.col("b") >= floor, F.lit(False))
    rel, ev, gain = F.coalesce("rel", F.lit(0.0)), F.coalesce("ev", F.lit(0)), F.greatest(F.lit(0.0), (F.coalesce("b", F.lit(0.0)) - floor) / (1 - floor))
    hits = F.count_if(hit)
    return t.groupBy("query_id", "id").agg(
        F.max("asked").alias("asked"),
        F.sum(gain * gain).alias("gain"),
        F.max("b").alias("near"),
        F.when(hits > 0, F.sum(F.when(hit, rel).otherwise(0.0)) / hits).otherwise(F.sum(rel) / F.count(F.lit(1))).alias("avg_rel"),
        F.when(hits > 0, F.sum(F.when(hit, ev).otherwise(0))).otherwise(F.sum(ev)).alias("evals"),
    )


def search(items: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, item_tags: DataFrame | None = None, relevance: DataFrame | None = None, prompt: DataFrame | None = None, tag_pairs: DataFrame | None = None, now: Column | None = None, category: str | None = None, bridge: DataFrame | None = None, tags: list[str] | None = None, settings: Settings | None = None, diagnostics: bool = False, index=None) -> DataFrame:
    """query_id, rank0, id, score of the whole path, for a set of queries.

    Gate, two lists over items (id, text, category, refreshed_at; those in scope), abstention, fusion
    between anchors, then one prior after another: the query's repository (column repo of queries),
    closeness of content tags to prompt tags (prompt: query_id, tag; tag_pairs: tag, other, sim),
    feedback over the tags that match, recency. Last come the filters by category (bridge: item_id,
    path) and by required tags, the cut, the least best score and the floor. What is not given is
    left out. diagnostics adds the nine parts of each score. index (postings.Postings over the same
    items) gives the keyword list in place of a scan of items.
    """
    o = settings or Settings()
    asked = queries.where(T.low_information("text").isNull())
    vec = rescope(nearest(vectors, query_vectors.join(asked.select("query_id"), "query_id", "left_semi"), o.list_size), items)
    docs = items.select("id", F.concat_ws(" ", "text", *(["category"] if "category" in items.columns else [])).alias("text"))
    kw = bm25(docs, asked, o.list_size) if index is None else index.search(asked, o.list_size)
    c = fuse([vec, kw], anchors(items), ("vector_sim", "bm25"))
    best_vector = F.max("vector_sim").over(Window.partitionBy("query_id"))
    c = c.withColumn("_best", best_vector).where(F.col("_best").isNull() | (F.col("_best") >= o.abstain_below)).drop("_best", "rrf")
    c = c.na.fill(0.0, ["vector_sim", "bm25"]).withColumnRenamed("score", "rrf_normalized")
    zero = F.lit(0.0)
    parts = {"repo_delta": zero, "feedback_delta": zero, "tag_affinity": zero, "best_tag_sim": zero, "tag_bonus": zero, "recency_multiplier": F.lit(1.0)}
    c = c.withColumns(parts)
    if relevance is not None and "repo" in queries.columns:
        at = asked.where("repo is not null").select("query_id", F.concat(F.lit("repo:"), "repo").alias("tag"))
        s = F.col("rel_score")
        delta = F.when(s > 0, 0.05 * F.least(s, F.lit(1.0))).when(s <= 0, -0.08 * F.least(F.abs(s), F.lit(1.0)))
        rel = relevance.where(F.col("positive_evals") + F.col("negative_evals") >= 3).select(F.col("item_id").alias("id"), "tag", F.col("score").alias("rel_score"))
        c = c.join(at, "query_id", "left").join(rel, ["id", "tag"], "left").withColumn("repo_delta", F.coalesce(delta, zero)).drop("tag", "rel_score")
    if item_tags is not None:
        c = c.join(tag_evidence(c, item_tags, prompt, tag_pairs, relevance, o.tag_floor), ["query_id", "id"], "left")
        if prompt is not None:
            c = c.join(prompt.select("query_id", F.lit(True).alias("prompted")).distinct(), "query_id", "left")
            miss = F.when(F.col("near") < o.tag_miss, o.tag_penalty).otherwise(0.0)
            value = F.when(F.col("prompted").isNull(), zero).when(F.col("evals").isNull(), o.tag_penalty / 2).otherwise(o.tag_weight * F.coalesce("gain", zero) + miss)
            c = c.withColumns({"tag_affinity": value, "best_tag_sim": F.coalesce("near", zero), "tag_bonus": F.coalesce("gain", zero)}).drop("prompted")
        bad = (F.coalesce("evals", F.lit(0)) >= V.FEEDBACK_EVALUATIONS) & (F.coalesce("avg_rel", zero) < V.FEEDBACK_FLOOR)
        c = c.where(~bad).withColumn("feedback_delta", o.feedback_weight * F.coalesce("avg_rel", zero)).drop("asked", "gain", "near", "avg_rel", "evals")
    if now is not None:
        fresh = items.select("id", T.recency("refreshed_at", F.lit(None).cast("timestamp"), now, o.recency).alias("fresh"))
        c = c.join(fresh, "id", "left").withColumn("recency_multiplier", F.coalesce("fresh", F.lit(1.0))).drop("fresh")
    c = c.withColumn("score", (F.col("rrf_normalized") + F.col("repo_delta") + F.col("tag_affinity") + F.col("feedback_delta")) * F.col("recency_multiplier"))
    if category is not None:
        linked = bridge if bridge is not None else items.select(F.col("id").alias("item_id"), F.col("category").alias("path"))
        c = c.join(in_category(items, linked, category).select("id"), "id", "left_semi")
    if tags:
        c = c.join(with_all_tags(items, item_tags, [t.strip().lower() for t in tags]).select("id"), "id", "left_semi")
    best = top_k(c, o.top)
    w = Window.partitionBy("query_id")
    best = best.withColumn("_best", F.max(F.round("score", 4)).over(w)).where(F.col("_best") >= o.min_top1).drop("_best")
    if o.floor is not None:
        best = best.where(F.round("score", 4) >= o.floor)
    out = best.withColumn("score", F.round("score", 4))
    return out.select("query_id", "rank0", "id", "score", *(["vector_sim", "bm25", "rrf_normalized", *parts] if diagnostics else []))
