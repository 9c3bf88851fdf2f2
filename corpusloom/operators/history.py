"""Commit history over commits(repo_id, hash, author, ts, message) and commit_files(hash, file)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.corpus import per_repo_top

#: Commits per repository that count as recent history.
NEWEST = 500


def newest(commits: DataFrame, n: int = NEWEST) -> DataFrame:
    return per_repo_top(commits, n, F.col("ts").desc(), F.col("hash"))


def top_changed_files(commits: DataFrame, commit_files: DataFrame, n: int = 20) -> DataFrame:
    touched = newest(commits).select("repo_id", "hash").join(commit_files, "hash").groupBy("repo_id", "file").agg(F.count("*").alias("changes"))
    return per_repo_top(touched, n, F.col("changes").desc(), F.col("file"))


def contributors(commits: DataFrame, n: int = 10) -> DataFrame:
    by_author = commits.groupBy("repo_id", "author").agg(F.count("*").alias("commits"))
    total = by_author.groupBy("repo_id").agg(F.count("*").alias("contributors"))
    return per_repo_top(by_author, n, F.col("commits").desc(), F.col("author")).join(total, "repo_id")


def monthly_activity(commits: DataFrame, n: int = 12) -> DataFrame:
    """Commits of the last n months that have any."""
    months = newest(commits).groupBy("repo_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("commits"))
    return per_repo_top(months, n, F.col("month").desc()).drop("rank")


def weekday_activity(commits: DataFrame) -> DataFrame:
    """Commits of each day of the week, zero where there are none."""
    days = F.array(*(F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")))
    every = commits.select("repo_id").distinct().withColumn("weekday", F.explode(days))
    counted = newest(commits).groupBy("repo_id", F.date_format("ts", "E").alias("weekday")).agg(F.count("*").alias("n"))
    return every.join(counted, ["repo_id", "weekday"], "left").select("repo_id", "weekday", F.coalesce("n", F.lit(0)).alias("commits"))


def recent_commits(commits: DataFrame, n: int = 10) -> DataFrame:
    return newest(commits, n).select("repo_id", "rank", "hash", "author", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.left("message", F.lit(80)).alias("message"))


def repo_basics(commits: DataFrame, refs: DataFrame | None = None, n_tags: int = 10) -> DataFrame:
    """Commits, authors, first and last commit; with refs(repo_id, kind, name) also the number of branches and the first tags by
    name."""
    out = commits.groupBy("repo_id").agg(F.count("*").alias("commits"), F.count_distinct("author").alias("authors"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    if refs is None:
        return out
    branches = refs.where("kind = 'branch'").groupBy("repo_id").agg(F.count_distinct("name").alias("branches"))
    tags = per_repo_top(refs.where("kind = 'tag'").select("repo_id", "name").distinct(), n_tags, F.col("name"))
    tags = tags.groupBy("repo_id").agg(F.array_sort(F.collect_list("name")).alias("tags"))
    out = out.join(branches, "repo_id", "left").join(tags, "repo_id", "left")
    return out.withColumns({"branches": F.coalesce("branches", F.lit(0)), "tags": F.coalesce("tags", F.array().cast("array<string>"))})
