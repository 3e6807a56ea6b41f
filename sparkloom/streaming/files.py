"""An extension: new source files as a stream, with running counts and findings.

The batch functions apply unchanged; only the reader and the sinks differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T

SCHEMA = "path string, content string, seen timestamp"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """files(path, content, seen) of Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def language_counts(files: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Files and tokens per language and window; rows later than ``late`` are dropped by the watermark."""
    one = files.select("seen", T.language(T.extension(F.col("path"))).alias("language"), T.token_estimate(F.col("content")).alias("tokens"))
    grouped = one.withWatermark("seen", late).groupBy(F.window("seen", window), "language")
    return grouped.agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "language", "files", "tokens")


def secret_alerts(files: DataFrame) -> DataFrame:
    """(path, line_no, category) as files arrive; no state."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    return lines.select("path", (F.col("pos") + 1).alias("line_no"), T.secret_category(F.col("line")).alias("category")).where("category IS NOT NULL")
