"""Reading a corpus: source trees or tables as files(repo_id, path, content)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All regular files below ``root``; the first directory is the repository, the rest the path. Bytes that aren't UTF-8 become
    replacement characters."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rest = below(F.col("path"), root)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select(rest.alias("rest"), text.alias("content")).select(
        F.substring_index("rest", "/", 1).alias("repo_id"), F.regexp_replace("rest", r"^[^/]*/", "").alias("path"), "content"
    )


def below(path: Column, root: str) -> Column:
    """What of ``path`` lies below ``root``. Scheme and authority (``s3a://bucket``, ``hdfs://host:1``, ``file:``) don't count on either
    side; a root within the bucket or file system may be written with or without them."""
    top = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", root).strip("/")
    bare = F.ltrim(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", ""), F.lit("/"))
    return F.substring(bare, F.lit(len(top) + 2 if top else 1), F.length(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("repo_id", "path", "content")
