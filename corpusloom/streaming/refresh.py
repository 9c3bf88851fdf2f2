"""Keeping the hash state of a corpus up to date from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "repo_id string, path string, content string, seen timestamp"


def latest_hashes(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Per window of ``late`` and file the hash of its newest contents; rows later than the watermark are dropped from the state."""
    rows = stream.withWatermark("seen", late).select("repo_id", "path", "seen", F.sha2("content", 256).alias("sha256"))
    return rows.groupBy(F.window("seen", late), "repo_id", "path").agg(F.max_by("sha256", "seen").alias("sha256"), F.count("*").alias("versions"))


def watch(spark: SparkSession, source: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows of a Parquet file stream to ``out``."""
    hashes = latest_hashes(spark.readStream.schema(FILES).parquet(source))
    return hashes.select("repo_id", "path", "sha256", "versions", F.col("window.end").alias("until")).writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start(out)
