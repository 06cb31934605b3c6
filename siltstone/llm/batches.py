"""Arrow batches cut to a bounded number of text bytes, and small helpers that several operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a worker holds at once; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in slices whose texts have about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def map_slices(df: DataFrame, column: str, schema: str, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """``work()`` runs once a task and returns the function that turns a slice into result rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for part in slices(batches, column):
            step = step or work()
            yield step(part)

    return df.mapInArrow(run, schema)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; a null text counts as empty."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies: under $PUBLIC_TOKENIZERS if set, else in the installed package."""
    if at := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(at, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> None:
    """The checkpoint folder that the cluster names; one of our own only where there is no cluster, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="siltstone-checkpoints-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, without lineage: they survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Shuffle files of a finished write are of no more use, since the table that it made is read instead.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The rows as a table in the shared folder, read again: they survive lost executors, and the shuffles that made them
    are deleted at once.  ``dropped`` deletes the table."""
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later step reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
