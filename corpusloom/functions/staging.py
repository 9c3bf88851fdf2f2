"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temporary one; on a cluster
    that is an error, since executors don't share local folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps start from the files, and a lost
    executor costs a re-read, not a recomputation."""
    return stage_at(df)[0]


def stage_at(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    # what the write shuffled isn't read again: its files go with it
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path), path


def stage_by(df: DataFrame, *keys: str) -> DataFrame:
    """``stage``, with the rows of equal ``keys`` in one bucket: joins and groupings that begin with these columns leave the table where it
    is. The buckets are as many as the session's shuffle partitions; the table is an external one in the shared folder."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"staged_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def unstage(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
