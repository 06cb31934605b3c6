"""Tables of one search, in the folder that the cluster shares, deleted when the search is over."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where there is no cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltstone-"))
    return context._jsc.sc().getCheckpointDir().get()


class Scratch:
    """``with Scratch(spark) as keep:`` – ``keep(df)`` writes rows once and reads them from then on."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared(spark)}/search-{uuid.uuid4().hex}", 0

    def __enter__(self):
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
