"""Test tables in the shape of file records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.files import name_of, parent

EXTENSIONS = [".pdf", ".txt", ".png", ".py", ".mp3", "", ".key", ".DOCX"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, parent, size and modified of file-like records made of ``part``."""
    p = table(spark, sf_dir, "part")
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("p_partkey") % len(EXTENSIONS)).cast("int"))
    path = F.concat_ws("", "p_brand", F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), ext)
    p = p.select(path.alias("path"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("modified"), "p_partkey")
    return p.withColumns({"name": name_of(F.col("path")), "parent": parent(F.col("path"))})


PARTS_SQL = f"""p AS (SELECT *, list_extract(string_split(path, '/'), -1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM (
  SELECT p_partkey, p_size::BIGINT AS size, p_retailprice AS modified,
         p_brand || '/' || replace(p_type, ' ', '_') || '/' || replace(p_name, ' ', '_') || '_' || p_partkey::VARCHAR || list_extract({EXTENSIONS!r}, (p_partkey % {len(EXTENSIONS)})::INT + 1) AS path FROM part)),
s AS (SELECT *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext FROM p)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text and doc_id of ``documents`` as files under source and language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("", "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "doc_id")


DOCUMENTS_SQL = "d AS (SELECT source || '/' || lang || '/doc_' || doc_id::VARCHAR || '.txt' AS path, text, doc_id FROM documents)"
