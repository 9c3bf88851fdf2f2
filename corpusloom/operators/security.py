"""Security findings over files(repo_id, path, content): catalogue rules, one row per match, in one pass over the files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.catalog import SECURITY_RULES, SENSITIVE_EXTENSIONS, SENSITIVE_NAMES, UNCHECKED_DIRS
from corpusloom.operators.corpus import basename, extension
from corpusloom.operators.hits import Lines, holds, rows_of_files, suffix
from corpusloom.operators.literals import literals

#: Characters of a snippet; of a masked secret.
SNIPPET, LONG, HEAD, TAIL, SHORT = 80, 30, 20, 5, 10


def checked(files: DataFrame) -> DataFrame:
    """Files that no unchecked directory holds."""
    parts = F.split("path", "/")
    return files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, UNCHECKED_DIRS))))


def sensitive_files(files: DataFrame) -> DataFrame:
    """SEC-001: by extension (high) or by name (medium), in either case."""
    high = extension(F.col("path")).isin(*SENSITIVE_EXTENSIONS)
    medium = F.lower(basename(F.col("path"))).isin(*SENSITIVE_NAMES)
    severity = F.when(high, "high").when(medium, "medium")
    return checked(files).where(high | medium).select("repo_id", "path", F.lit("SEC-001").alias("rule_id"), severity.alias("severity"))


def mask_secret(text: Column) -> Column:
    return F.when(F.length(text) > LONG, F.concat(F.left(text, F.lit(HEAD)), F.lit("***"), F.right(text, F.lit(TAIL)))).otherwise(F.concat(F.left(text, F.lit(SHORT)), F.lit("***")))


def security_scan(files: DataFrame, rules=SECURITY_RULES) -> DataFrame:
    """repo_id, path, rule_id, title, severity, line, snippet of all content rules; secrets are masked. Files that are sensitive
    by their extension aren't read. A rule's pattern runs only on texts that have the literals it needs (see literals)."""
    clean = checked(files).where(~extension(F.col("path")).isin(*SENSITIVE_EXTENSIONS))

    def read(path: str, text: str) -> Iterator[tuple]:
        ext, line = suffix(path), None
        own = tuple(rule for rule in rules if rule[3] is None or ext in rule[3])
        for i in literals(tuple(rule[4] for rule in own)).wanted(text):
            rule_id, title, severity, _, pattern, conditions = own[i]
            for m in re.finditer(pattern, text, re.ASCII):
                if holds(text, m.start(), m.end(), conditions):
                    line = line or Lines(text)
                    yield rule_id, title, severity, line(m.start()), m[0]

    found = rows_of_files(clean, read, "rule_id string, title string, severity string, line long, whole string")
    snippet = F.when(F.col("rule_id") == "SEC-002", mask_secret(F.col("whole"))).otherwise(F.left("whole", F.lit(SNIPPET)))
    return found.select("repo_id", "path", "rule_id", "title", "severity", "line", snippet.alias("snippet"))


def all_issues(files: DataFrame) -> DataFrame:
    """The findings of security_scan and the sensitive files, which have line 0 and their path as snippet."""
    title = F.when(F.col("severity") == "high", "sensitive file by extension").otherwise("sensitive file by name")
    named = sensitive_files(files).select("repo_id", "path", "rule_id", title.alias("title"), "severity", F.lit(0).cast("long").alias("line"), F.left("path", F.lit(SNIPPET)).alias("snippet"))
    return security_scan(files).unionByName(named)


def security_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("repo_id").agg(F.count("*").alias("n_issues"), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "high", "medium", "low")))


def first_issues(issues: DataFrame, n: int = 50) -> DataFrame:
    order = Window.partitionBy("repo_id").orderBy("path", "line", "rule_id", "title", "snippet")
    return issues.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
