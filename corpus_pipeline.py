"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

toxicity: documents whose score is 0.5 or more go. line_dedup: lines that repeat earlier lines, or
differ from them by two edits at most, are taken out of the texts. set_join: of each group of
documents linked by a Jaccard similarity of at least 0.8 of their 5-word shingles, the one with the
least doc_id stays.
decontamination: documents that hold a benchmark passage go. packing: what is left becomes pieces
of full sequences in Hilbert-curve order.

Defined cases: a null text or an empty one has no toxic neighbour, no line, no shingle and no
benchmark passage, so it stays through all stages and is packed as its end id; rows with a null
doc_id, repeated rows and very long texts go through every stage as its operator states; an empty
table gives no pieces; further columns of documents are carried to the last stage, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, line_dedup, packing, set_join, toxicity
from lodestone.llm.common import small_batches, written
from lodestone.llm.encoding import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def set_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return set_join.one_of_each(docs, n=5, pct=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontamination.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pieces(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("set_join", set_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The first stage learns a model and the last runs a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
