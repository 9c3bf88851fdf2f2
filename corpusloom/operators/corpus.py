"""Scanning, labelling, hashing and refreshing a corpus of files(repo_id, path, content)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.catalog import LANGUAGES, SKIPPED_DIRS, SKIPPED_NAMES


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix of the file name; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def _glob(pattern: str) -> str:
    special = {"*": "[^/]*", "?": "[^/]"}
    return "(^|/)" + "".join(special.get(c, "\\" + c if not c.isalnum() and c not in "/_-" else c) for c in pattern) + "$"


def scan_files(files: DataFrame, exclude_dirs: Sequence[str] = SKIPPED_DIRS, exclude_patterns: Sequence[str] = SKIPPED_NAMES) -> DataFrame:
    """Files of known languages, outside excluded directories and names."""
    bad = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, exclude_dirs)))
    for pattern in exclude_patterns:
        bad = bad | F.col("path").rlike(_glob(pattern))
    return files.where(~bad & language_of(F.col("path")).isNotNull())


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def language_counts(files: DataFrame) -> DataFrame:
    return with_language(files).groupBy("repo_id", "language").agg(F.count("*").alias("n_files"))


def dominant_language(files: DataFrame, configured: str | None = None, default: str = "python") -> DataFrame:
    """The configured language, else the one with most files (the first by name on ties), else the default."""
    if configured:
        return files.select("repo_id").distinct().withColumn("language", F.lit(configured))
    best = F.min_by("language", F.struct(-F.col("n_files"), "language")).alias("language")
    known = language_counts(files).where("language is not null").groupBy("repo_id").agg(best)
    return files.select("repo_id").distinct().join(known, "repo_id", "left").select("repo_id", F.coalesce("language", F.lit(default)).alias("language"))


def content_hash(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "path", F.sha2("content", 256).alias("sha256"))


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs from state(repo_id, path, sha256). Hash columns only are shuffled."""
    prior = state.select("repo_id", "path", F.col("sha256").alias("prior"))
    joined = content_hash(files).join(prior, ["repo_id", "path"], "left")
    return joined.where(~F.col("sha256").eqNullSafe(F.col("prior"))).select("repo_id", "path", "sha256")


def stale_entries(files: DataFrame, state: DataFrame) -> DataFrame:
    return state.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def incremental_refresh(files: DataFrame, state: DataFrame) -> DataFrame:
    """The next state: unchanged entries as they were, changed ones with their new hash, no stale ones."""
    hashes = content_hash(files)
    prior = state.select("repo_id", "path", F.col("sha256").alias("prior"))
    status = F.when(F.col("prior").isNull(), "new").when(F.col("prior") == F.col("sha256"), "cached").otherwise("changed")
    return hashes.join(prior, ["repo_id", "path"], "left").select("repo_id", "path", "sha256", status.alias("status"))


def line_count(files: DataFrame) -> DataFrame:
    """Lines of each file; a trailing newline begins no line."""
    pieces = F.size(F.split("content", "\n", -1))
    lines = F.when(F.length("content") == 0, 0).otherwise(pieces - F.when(F.col("content").endswith("\n"), 1).otherwise(0))
    return files.select("repo_id", "path", lines.cast("long").alias("n_lines"))


def search_files(files: DataFrame, text: str) -> DataFrame:
    """Paths that contain ``text``, in either case."""
    return files.where(F.contains(F.lower("path"), F.lit(text.lower()))).select("repo_id", "path")


def prompt_table(docs: DataFrame, most: int = 8000, described: DataFrame | None = None) -> DataFrame:
    """What a describing model would be given, by repository and path: name, language (where the path tells one), lines, and at most
    ``most`` characters of each text, with a mark if cut. described(repo_id, path): files that have a description already are left out."""
    if described is not None:
        docs = docs.join(described.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")
    cut = F.when(F.length("content") > most, F.concat(F.left("content", F.lit(most)), F.lit("\n... (truncated)"))).otherwise(F.col("content"))
    known = F.coalesce(F.concat(F.lit("\nLanguage: "), language_of(F.col("path"))), F.lit(""))
    head = F.concat(F.lit("File: "), "path", known, F.lit("\nLines: "), F.size(F.split("content", "\n", -1)).cast("string"), F.lit("\n\n"))
    return docs.select("repo_id", "path", F.concat(head, cut).alias("prompt"))


def merge_descriptions(nodes: DataFrame, described: DataFrame) -> DataFrame:
    """nodes(repo_id, path, purpose, ...) with what a model said, described(repo_id, path, description), in place of the purpose where it isn't
    blank; purpose_source tells model or parser. Of several descriptions of a file the least counts."""
    said = described.where(F.trim("description") != "").groupBy("repo_id", "path").agg(F.min("description").alias("said"))
    rows = nodes.join(said, ["repo_id", "path"], "left")
    return rows.withColumns({"purpose": F.coalesce("said", "purpose"), "purpose_source": F.when(F.col("said").isNotNull(), "model").otherwise("parser")}).drop("said")


def per_repo_top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each repository; Spark limits groups before the shuffle."""
    turn = F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))
    return rows.withColumn("rank", turn).where(F.col("rank") <= n)
