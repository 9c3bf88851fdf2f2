"""Keeping texts out of a shuffle when few of them are wanted.

Keys are hashed into a fixed number of buckets. The buckets that hold a wanted key, at most ``BUCKETS`` rows whatever the data, go
to all tasks; rows in other buckets can't match and needn't be shuffled. When most buckets are wanted, the rows simply take
part in the join."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20


def bucket(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def fresh(columns: Iterable[str], name: str) -> str:
    """A name that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _wanted(rows: DataFrame, column: str, keys: DataFrame, key: str, how: str) -> DataFrame:
    name = fresh(rows.columns, "bucket")
    return rows.join(F.broadcast(keys.select(bucket(key).alias(name)).distinct()), bucket(column) == F.col(name), how)


def maybe(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` may be among ``keys``."""
    return _wanted(rows, column, keys, key, "left_semi")


def others(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rest: rows that can't be."""
    return _wanted(rows, column, keys, key, "left_anti")
