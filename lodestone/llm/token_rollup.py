"""Token-count rollups kept up to date by signed deltas.

A change batch holds inserts, deletes and revised counts of documents. It is folded to one signed
row per (source, lang, tokenizer) before anything is stored, written below a fresh attempt folder,
and becomes visible by one commit marker whose name is the batch id. A batch that is already
committed is skipped, an attempt that died leaves no marker and is never read, and totals are the
plain sum of the committed deltas, so any replay gives the same totals.

``compact`` sums what is committed into one folder. Its marker names the batches it stands for and
is put in place whole, by a rename, before any marker it replaces goes: a driver that dies in
between leaves totals as they were, and a batch stays committed for ever.

Defined cases: null source, lang or tokenizer are groups of their own; null counts are 0; a null
text has 0 tokens; an empty batch commits and changes nothing; groups whose documents and tokens
have all been taken back stay, with zeros. Repeated rows count each, also under one doc_id or a
null one; the order of rows, and ties in it, change nothing; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SQL, documents_only, shared_dir, written

KEYS = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizer versions by name; each is one native expression over a text.
TOKENIZERS = {
    "words@1": lambda text: F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long"),
    "pieces@2": lambda text: F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")), F.lit(0)).cast("long"),
}


def inserts(counted: DataFrame) -> DataFrame:
    """counted: source, lang, tokenizer, n_tokens, a row per document."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    return inserts(counted).select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts that replace others: the old ones go, the new ones come, in one batch."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _markers(self) -> list[str]:
        at = self._path(f"{self.path}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in names if "-" in n and not n.startswith("_"))

    def _read(self, name: str) -> list[str]:
        stream = self._fs.open(self._path(f"{self.path}/commits/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _commit(self, name: str, content: str = "") -> None:
        """Puts a marker in place whole: it is there with all its content, or not at all."""
        made, final = (self._path(f"{self.path}/commits/{x}") for x in (f"_{uuid.uuid4().hex}", name))
        out = self._fs.create(made, True)
        out.write(content.encode())
        out.close()
        if not self._fs.rename(made, final):
            raise OSError(f"the marker {name} could not be put in place")

    def state(self) -> tuple[list[str], set[int]]:
        """Delta folders that make up the totals, and the ids of all committed batches."""
        names = self._markers()
        replaced, done, folders = set(), set(), []
        compacted = [n for n in names if n.startswith("all-")]
        for n in compacted:
            kinds = [x.split(":", 1) for x in self._read(n)]
            replaced.update(v for k, v in kinds if k == "folder")
            done.update(int(v) for k, v in kinds if k == "batch")
        folders += [n for n in compacted if n not in replaced]
        first: dict[int, str] = {}
        for n in names:
            if n not in compacted and int(n.split("-", 1)[0]) not in done:  # of two attempts at a batch one counts
                first.setdefault(int(n.split("-", 1)[0]), n)
        return folders + list(first.values()), done | set(first)

    def committed(self) -> set[int]:
        return self.state()[1]

    def apply(self, batch_id: int, changes: DataFrame) -> bool:
        """Commits a batch once; False if it was committed before, compacted or not."""
        if batch_id in self.committed():
            return False
        name = f"{batch_id}-{uuid.uuid4().hex}"
        delta = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.write.parquet(f"{self.path}/deltas/{name}")
        self._commit(name)
        return True

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _DELTA)
        deltas = self.spark.read.schema(_DELTA).parquet(*(f"{self.path}/deltas/{n}" for n in folders))
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))

    def totals(self) -> DataFrame:
        return self._sum(self.state()[0])

    def compact(self) -> None:
        """Folds what is committed into one folder. One caller at a time; batches may commit meanwhile."""
        folders, done = self.state()
        old = self._markers()
        name = f"all-{uuid.uuid4().hex}"
        self._sum(folders).write.parquet(f"{self.path}/deltas/{name}")
        compacted = [n for n in old if n.startswith("all-")]
        self._commit(name, "\n".join([f"folder:{n}" for n in compacted] + [f"batch:{b}" for b in sorted(done)]))
        for n in old:
            if n.startswith("all-") or int(n.split("-", 1)[0]) in done:
                self._fs.delete(self._path(f"{self.path}/commits/{n}"), False)


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), TOKENIZERS[tokenizer](F.col("text")).alias("n_tokens"))


def texts_by_group(docs: DataFrame) -> DataFrame:
    """h, source, lang, copies, old, new, lead: rows of each distinct text by source and lang.

    Rows are counted before anything is shuffled, so a text that very many rows hold is a few rows
    here. lead marks the one group that holds the text's first row (least doc_id, nulls first, then
    source and lang). new is null where the text has no markup symbol.
    """
    text = F.col("text")
    new = F.when(text.rlike(r"[#*$%&|<>]"), TOKENIZERS["pieces@2"](text))
    sized = docs.where(text.isNotNull()).select("source", "lang", F.sha2("text", 256).alias("h"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), TOKENIZERS["words@1"](text).alias("old"), new.alias("new"))
    per = sized.groupBy("h", "source", "lang").agg(F.count(F.lit(1)).alias("copies"), F.min("d").alias("d"), F.max("old").alias("old"), F.max("new").alias("new"))
    first = F.struct("d", "source", "lang")
    lead = per.groupBy("h").agg(F.min(first).alias("first")).withColumnRenamed("h", "of")
    return per.join(lead, F.col("h") == F.col("of")).withColumn("lead", first.eqNullSafe(F.col("first"))).drop("of", "first", "d")


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all come in; of each text all rows but the first go; texts with markup symbols are counted anew by the second tokenizer. Then all is compacted, and the second batch is delivered again."""
    docs = documents_only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang", "source")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup")
    rollup.apply(0, inserts(counted(docs, "words@1")))
    texts = written(texts_by_group(docs), "texts")
    extra = F.col("copies") - F.col("lead").cast("long")
    gone = texts.select("source", "lang", F.lit("words@1").alias("tokenizer"), (-extra).alias("n_docs"), (-extra * F.col("old")).alias("n_tokens")).where("n_docs <> 0")
    rollup.apply(1, gone)
    marked = texts.where("lead and new is not null")
    old, new = (marked.select("source", "lang", F.lit(name).alias("tokenizer"), F.col(c).alias("n_tokens")) for name, c in (("words@1", "old"), ("pieces@2", "new")))
    rollup.apply(2, revisions(old, new))
    rollup.compact()
    rollup.apply(1, gone)
    return rollup.totals()


ORACLE = r"""
WITH d AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS a,
                  len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS b,
                  text IS NOT NULL AND regexp_matches(text, '[#*$%&|<>]') AS marked,
                  text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS FIRST, source NULLS FIRST, lang NULLS FIRST) > 1 AS copy FROM documents),
x AS (SELECT source, lang, 'words@1' AS tokenizer, 1 AS n, a AS t FROM d
      UNION ALL SELECT source, lang, 'words@1', -1, -a FROM d WHERE copy
      UNION ALL SELECT source, lang, 'words@1', -1, -a FROM d WHERE marked AND NOT copy
      UNION ALL SELECT source, lang, 'pieces@2', 1, b FROM d WHERE marked AND NOT copy)
SELECT source, lang, tokenizer, sum(n)::BIGINT AS n_docs, sum(t)::BIGINT AS n_tokens FROM x GROUP BY ALL
"""
