"""Line, comment and complexity metrics over files(repo_id, path, content). Everything is computed within a file's row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.catalog import BRANCHES, DASH_COMMENTS, HASH_COMMENTS, SLASH_COMMENTS
from corpusloom.operators.corpus import extension, per_repo_top
from corpusloom.operators.hits import Lines, brace_body, first, indented_body, rows_of_files, suffix

#: Characters after a function's start that count, the cap, and from where a function is complex.
WINDOW, MOST, COMPLEX = 2000, 100, 10
RUBY_WINDOW, RUBY_BRANCHES = 500, ("if ", "while ", "case ")

SCRIPTS = ("js", "jsx", "ts", "tsx", "mjs", "cjs")

#: Function heads: (extensions, pattern, pattern of the name in it, names that are none).
FUNCTIONS = (
    (("py",), r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*\(", r"def[ \t]+(\w+)", ()),
    (
        ("java",), r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native)[ \t]+)*[\w<>\[\],.? \t]+?[ \t]+\w+[ \t]*\([^)]*\)\s*(?:throws\s+[\w., \t]+)?\{",
        r"(\w+)[ \t]*\(", ("toString", "equals", "hashCode", "clone", "if", "for", "while", "switch", "catch", "synchronized"),
    ),
    (SCRIPTS, r"function\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", r"(?:function|const|let|var)\s+(\w+)", ()),
    (("go",), r"func\s+(?:\([^)]*\)\s*)?\w+\s*\(", r"(\w+)\s*\($", ()),
    (("php",), r"function\s+\w+\s*\(", r"function\s+(\w+)", ()),
    (("rb",), r"\bdef\s+\w+", r"def\s+(\w+)", ()),
    (
        ("cs",), r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|async|abstract)[ \t]+)*[\w<>\[\],.? \t]+?[ \t]+\w+[ \t]*\([^)]*\)\s*\{",
        r"(\w+)[ \t]*\(", ("ToString", "Equals", "GetHashCode", "Dispose", "if", "for", "foreach", "while", "switch", "catch", "using", "lock"),
    ),
)


def comment_lines(content: Column, ext: Column) -> Column:
    """Lines that begin with #, or that begin with // or lie in a block; a block opens on a line that begins with /* and closes
    after a later line that holds */."""
    lines = F.split(content, "\n", -1)
    hashes = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("#")))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        bare = F.trim(line)
        slash, opens, closes = bare.startswith("//"), bare.startswith("/*"), F.contains(bare, F.lit("*/"))
        counts = acc["open"] | slash | opens | closes
        still = F.when(slash, acc["open"]).when(opens, True).when(closes, False).otherwise(acc["open"])
        return F.struct((acc["n"] + counts.cast("int")).alias("n"), still.alias("open"))

    blocks = F.aggregate(lines, start, step, lambda acc: acc["n"])
    dashes = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("--")))
    return F.when(ext.isin(*HASH_COMMENTS), hashes).when(ext.isin(*SLASH_COMMENTS), blocks).when(ext.isin(*DASH_COMMENTS), dashes).otherwise(0)


def line_metrics(files: DataFrame, *keep: str) -> DataFrame:
    """total, blank (non-overlapping empty lines), comment and code lines."""
    total = F.size(F.split("content", "\n", -1))
    blank = ((F.length("content") - F.length(F.replace("content", F.lit("\n\n"), F.lit("")))) / 2).cast("int")
    rows = files.select("repo_id", "path", *keep, total.alias("total"), blank.alias("blank"), comment_lines(F.col("content"), extension(F.col("path"))).alias("comment"))
    return rows.withColumn("code", F.col("total") - F.col("blank") - F.col("comment"))


def complexity(text: Column) -> Column:
    """1 and the occurrences of branching substrings, at most MOST."""
    total = F.lit(1)
    for word in BRANCHES:
        total = total + ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")
    return F.least(total, F.lit(MOST))


def _complexity(text: str) -> int:
    return min(MOST, 1 + sum(text.count(word) for word in BRANCHES))


def _functions(path: str, text: str) -> list[tuple]:
    """name, line, end_line, n_lines, complexity of a file's functions."""
    ext, out, line = suffix(path), [], Lines(text)
    for extensions, pattern, named, none in FUNCTIONS:
        if ext not in extensions:
            continue
        for m in re.finditer(pattern, text, re.ASCII):
            name = first(named, m[0])
            if name in none:
                continue
            if ext == "java":
                inside = m[0][m[0].index("(") + 1 : m[0].rindex(")")]
                if name.startswith("get") and not inside.strip() or name.startswith("set") and "," not in inside:
                    continue
            start = line(m.start())
            if ext == "rb":
                near = text[m.start() : m.start() + RUBY_WINDOW]
                n = max(1, sum(near.count(word) for word in RUBY_BRANCHES))
                out.append((name, start, start + 2 * n, 2 * n, n))
                continue
            n = _complexity(text[m.start() : m.start() + WINDOW])
            if ext == "py":
                stop = indented_body(text, m.end())
                end = line(len(text[:stop].rstrip()))
            elif ext == "java":
                end = line(brace_body(text, m.end() - 1)[1] - 1)
            else:
                out.append((name, start, start + max(1, 2 * n), max(1, 2 * n), n))
                continue
            out.append((name, start, end, end - start + 1, n))
    return out


def functions(files: DataFrame) -> DataFrame:
    """repo_id, path, name, line, end_line, n_lines, complexity: one row per function head; complexity of the WINDOW characters from
    there (Ruby: of RUBY_WINDOW). A Python function ends with its indentation, a Java method with its brace, others are taken
    to have twice as many lines as their complexity. Java's plain accessors and the usual overrides don't count."""
    return rows_of_files(files, _functions, "name string, line long, end_line long, n_lines long, complexity int")


def file_quality(files: DataFrame) -> DataFrame:
    """Line metrics with functions, their mean length, total, highest and mean complexity: one pass over the files."""
    lines = line_metrics(files, "content")

    def read(path: str, text: str) -> list[tuple]:
        found = _functions(path, text)
        n, grades = len(found), [f[4] for f in found]
        return [(n, round(sum(f[3] for f in found) / n, 1) if n else 0.0, sum(grades), max(grades, default=0), sum(g > COMPLEX for g in grades))]

    rows = rows_of_files(lines, read, "n_functions long, mean_lines double, total_complexity long, max_complexity int, n_complex long", ("total", "blank", "comment", "code"))
    ratio = lambda c: F.round(F.col(c) / F.greatest("total", F.lit(1)), 3)
    return rows.select(
        "repo_id", "path", "total", "blank", "comment", "code", ratio("comment").alias("comment_ratio"), ratio("blank").alias("blank_ratio"), ratio("code").alias("code_ratio"),
        "n_functions", "mean_lines", "total_complexity", "max_complexity", "n_complex",
    )


def complex_functions(files: DataFrame, least: int = COMPLEX, n: int = 20) -> DataFrame:
    return per_repo_top(functions(files).where(F.col("complexity") >= least), n, F.col("complexity").desc(), F.col("path"), F.col("line"))


def quality_summary(files: DataFrame) -> DataFrame:
    """Totals and a grade: by comment ratio, one step lower where mean complexity exceeds 15 (from A to D)."""
    sums = file_quality(files).groupBy("repo_id").agg(*(F.sum(c).alias(c) for c in ("total", "comment", "n_functions", "total_complexity")))
    ratio = F.col("comment") / F.col("total")
    mean = F.when(F.col("n_functions") > 0, F.col("total_complexity") / F.col("n_functions")).otherwise(0.0)
    grade = F.when(ratio < 0.03, "C").when(ratio < 0.08, "B").otherwise("A")
    lowered = F.when(mean > 15, F.when(grade == "B", "C").otherwise("D")).otherwise(grade)
    return sums.select("repo_id", "total", "comment", "n_functions", "total_complexity", lowered.alias("grade"))
