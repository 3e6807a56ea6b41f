"""Working tables in the folder that all executors share.

Every iterative operator cuts its lineage by writing a Parquet table and
reading it back, so a lost executor costs a re-read and never a recomputation
of earlier rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """A folder of intermediate tables that one operator call owns."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def new_path(self, label: str = "t") -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{label}"

    def save(self, df: DataFrame, label: str = "t", **options: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = self.new_path(label)
        df.write.options(**options).parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._sparkloom_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later result reads."""
        for t in tables:
            self.delete(t._sparkloom_path)

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
