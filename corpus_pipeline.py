"""The document pipeline: quality, line dedup, near duplicates, benchmark leaks, tokens.

Each stage takes what the one before kept; all but the last return the columns of ``documents``.  ``run`` applies them
in turn, each written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import batches, bpe, crf_quality, decontaminate, lines, ngram_join
from siltstone.llm.sieve import marked, sieve

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _packed(docs: DataFrame) -> DataFrame:
    """``row`` (a document with all its columns, whatever their names), and its doc_id, text (null: empty), text_hash and
    node (the MD5 of the text), by which decisions are joined."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce("row.text", F.lit(""))
    return packed.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.unhex(F.md5(text)).alias("node"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose lines the field takes for bad; a null or empty text is one empty line.  Scores are joined to the rows they were made of: the
    model runs on the rows themselves, so no text is shuffled."""
    return crf_quality.keep_good(docs, batches.read(spark, sf_dir, "documents"), batches.read(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier one.  A document of which nothing is left but white space goes, if it had
    something; n_chars follows the text."""
    out = lines.removed(_packed(docs).drop("node"), lines.duplicate_lines(lines.keyed(docs), least_words=1))
    had = F.coalesce("row.text", F.lit("")).rlike(r"\S")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("text")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.where(~had | F.col("text").rlike(r"\S")).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal or similar documents the row of the least (doc_id, MD5 of the text) stays, a null doc_id
    last; of rows that agree in both, one.  A class is told by its root: documents that share a doc_id, or have none,
    are alike only if their texts are."""
    found = ngram_join.similarity_join(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    several = batches.cut(found.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1").select("root", "first"))
    inside = found.join(several, "root").select("doc_id", "node", "root", order.eqNullSafe(F.col("first")).alias("stays"))
    inside = batches.cut(inside.distinct())
    rows = marked(_packed(docs).select("row", "doc_id", "node"), F.col("node"), sieve(inside, "node"))
    named = inside.select(F.col("doc_id").alias("i"), F.col("node").alias("k"), "root", "stays")
    rest = rows.where("may_match").join(named, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("k")), "left")
    best = rest.where("stays").groupBy("root").agg(F.min("row").alias("row")).select("row")
    kept = rows.where("not may_match").select("row").unionByName(rest.where("stays is null").select("row")).unionByName(best)
    return kept.select("row.*")


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of a test item; a null text has none."""
    return decontaminate.keep_clean(docs, batches.read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of what is left."""
    return bpe.round_trip(docs, keep_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", new_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", not_in_benchmark),
    ("byte-level BPE encoding and decoding", tokens),
]
#: Training a field, MinHash and recursive merges have no SQL form that is exact; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = batches.read(spark, sf_dir, "documents")
    batches.shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # the stage before is read no more
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return docs
