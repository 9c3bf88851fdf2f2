"""REST endpoints over files(repo_id, path, content), in one pass over the files."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.catalog import ENDPOINT_RULES, REACH, ROUTE_METHODS
from corpusloom.operators.corpus import per_repo_top
from corpusloom.operators.hits import Lines, first, holds, rows_of_files, suffix
from corpusloom.operators.literals import literals


def join_path(base: Column, sub: Column) -> Column:
    """base and sub with one slash between them and, without a base, one in front; ``/`` when both are empty."""
    trimmed, led = F.rtrim(base, F.lit("/")), F.when(sub.startswith("/"), sub).otherwise(F.concat(F.lit("/"), sub))
    return F.when((sub == "") & (base == ""), "/").when(sub == "", base).when(base == "", led).otherwise(F.concat(trimmed, led))


def endpoints(files: DataFrame, rules=ENDPOINT_RULES) -> DataFrame:
    """repo_id, path, framework, method, route, handler, line: one row per declared route and method. A site that two frameworks write
    alike is reported for both. Routes of classes are joined to the class's base path, others are as written; handler: the
    function that serves the route, or empty."""

    def read(path: str, text: str) -> Iterator[tuple]:
        ext, line, bases = suffix(path), None, {}
        own = tuple(rule for rule in rules if ext in rule[1])
        for i in literals(tuple(rule[2] for rule in own)).wanted(text):
            framework, _, pattern, method, route, base, handler, conditions = own[i]
            for m in re.finditer(pattern, text, re.ASCII):
                if not holds(text, m.start(), m.end(), conditions):
                    continue
                line = line or Lines(text)
                if base is not None and base not in bases:
                    bases[base] = first(base, text).rstrip("/")
                if method.startswith("list:"):
                    names = re.findall(r"['\"](\w+)['\"]", first(method[5:], m[0]), re.ASCII) or ["GET"]
                else:
                    names = [first(method, m[0]) if "(" in method else method]
                if route is None:
                    sub = ""
                else:
                    sub = first(route[6:], text[m.start() : m.start() + 200]) if route.startswith("after:") else first(route, m[0])
                served = handler[1:] if handler[0] == "=" else first(handler, text[m.start() : m.start() + REACH])
                for name in names:
                    name = name.upper()
                    yield framework, ROUTE_METHODS.get(name, name), None if base is None else bases[base], sub, served, line(m.start())

    found = rows_of_files(files, read, "framework string, method string, base string, sub string, handler string, line long")
    route = F.when(F.col("base").isNull(), F.col("sub")).otherwise(join_path(F.col("base"), F.col("sub")))
    return found.select("repo_id", "path", "framework", "method", route.alias("route"), "handler", "line")


def endpoint_summary(found: DataFrame, dedupe: bool = False) -> DataFrame:
    """Endpoints by method; dedupe: a site that two frameworks report counts once."""
    if dedupe:
        found = found.dropDuplicates(["repo_id", "path", "line", "method", "route"])
    return found.groupBy("repo_id", "method").agg(F.count("*").alias("n_endpoints"))


def busiest_files(found: DataFrame, n: int = 5) -> DataFrame:
    return per_repo_top(found.groupBy("repo_id", "path").agg(F.count("*").alias("n_endpoints")), n, F.col("n_endpoints").desc(), F.col("path"))
