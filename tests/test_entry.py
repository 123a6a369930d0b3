"""The driver's entry points: registered queries have oracles and agree on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import registry, stream_queries, upkeep_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NEW = ["a14_retrieval_metrics", "a15_bucket_metrics", "a16_trajectory_summary", "a20_yield_tiers", "a28_similarity_summary", "a28_top_pairs", "e08_ablation", "e14_judged_evaluations", "e14_judged_merges", "index_search_t01_s08", "j11_self_candidates", "m09_dedup_outcomes", "t08_category_listing", "x08_s27_snapshots", "x09_passes"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:4] == ["query_id", "rank0", "id", "score"]


def test_oracles_belong_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", ["r04_bm25_topk", "r06_r07_fusion", "r_hybrid_search", "r_full_search", "a07_relevance", "j10_dedup_candidates", "m12_merge_items", "e07_sweep", "s11_s12_turns", "r11_affinity", "a13_tag_subsets", *NEW, *sorted(stream_queries.QUERIES), *sorted(upkeep_queries.QUERIES)])
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a = registry.queries()[name](spark, SF)
    cols = sorted(a.columns)
    b = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in b.description]
    show = lambda v: "" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    left = sorted(tuple(show(r[c]) for c in cols) for r in a.collect())
    right = sorted(tuple(show(r[names.index(c)]) for c in cols) for r in b.fetchall())
    assert left == right
