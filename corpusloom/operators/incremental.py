"""Refreshing the facts and imports of a corpus: only changed files are parsed, only imports that may have changed are resolved again.

The state holds three tables: ``facts`` (extract.facts with the content's hash), ``asks`` (repo_id, name, path: every path that an import of a
file may mean, and every class name, so the reverse of the candidates) and ``edges`` (the resolved imports).

A refresh compares hashes: unchanged files keep their facts. The imports of a file are resolved again if the file is new or changed, or if it
asks for a path or class name that came or went; all others keep their edges. The result is that of a full run.

Keys of changed files are broadcast if they are at most ``FEW``; beyond that a join shuffles the texts of the corpus once.
Defined cases: a null content is empty; a file without imports has no edges; an empty corpus empties the state; of rows with
equal repository and path one must be chosen before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage
from corpusloom.operators import extract
from corpusloom.operators.corpus import basename
from corpusloom.sources.state import State

FEW = 1_000_000
KEY = ["repo_id", "path"]


def statuses(files: DataFrame, prior: DataFrame | None) -> DataFrame:
    """repo_id, path, sha256, status (new, changed, cached or gone) by hashes alone."""
    own = files.select(*KEY, F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"))
    if prior is None:
        return own.withColumn("status", F.lit("new"))
    both = own.join(prior.select(*KEY, F.col("sha256").alias("prior")), KEY, "full")
    status = F.when(F.col("sha256").isNull(), "gone").when(F.col("prior").isNull(), "new").when(F.col("prior") == F.col("sha256"), "cached").otherwise("changed")
    return both.select(*KEY, F.coalesce("sha256", "prior").alias("sha256"), status.alias("status"))


def asked(known: DataFrame) -> DataFrame:
    """repo_id, name, path: what the imports of each file ask for."""
    each = known.select(*KEY, "language", F.explode("imports").alias("i"))
    paths = each.select("repo_id", F.explode("i.candidates").alias("name"), "path")
    classes = each.where("language in ('java', 'php')").select("repo_id", F.concat(F.regexp_extract("i.spec", r"(\w+)$", 1), F.lit("."), "language").alias("name"), "path")
    return paths.unionByName(classes).distinct()


def names_of(paths: DataFrame) -> DataFrame:
    """repo_id, name: by what files may be asked for: their path, and for Java and PHP the name of their class."""
    base = basename(F.col("path"))
    return paths.select("repo_id", F.col("path").alias("name")).unionByName(paths.where(base.rlike(r"\.(java|php)$")).select("repo_id", base.alias("name"))).distinct()


def _only(files: DataFrame, keys: DataFrame) -> DataFrame:
    """The files with these keys."""
    few = keys.count() <= FEW
    return files.join(F.broadcast(keys) if few else keys, KEY, "left_semi")


def refresh(files: DataFrame, state: State) -> DataFrame:
    """Bring the state up to date with files(repo_id, path, content); repo_id, path, sha256, status and resolved (whether the file's imports
    were resolved again) of every file, and of those that are gone."""
    base = state.present()
    prior = None if base is None else state.read("facts", base)
    status = stage(statuses(files, prior))
    parse = stage(status.where("status in ('new', 'changed')").select(*KEY))
    hashes = status.where("status <> 'gone'").select(*KEY, "sha256")
    fresh = stage(extract.facts(_only(files, parse)).join(hashes, KEY))
    if base is None:
        known, asks = fresh, stage(asked(fresh))
        again = parse
        edges = extract.resolve_imports(known)
    else:
        cached = status.where("status = 'cached'").select(*KEY)
        known = stage(prior.join(cached, KEY, "left_semi").unionByName(fresh))
        asks = stage(state.read("asks", base).join(cached, KEY, "left_semi").unionByName(asked(fresh)))
        moved = names_of(status.where("status in ('new', 'gone')").select(*KEY))
        again = stage(asks.join(moved, ["repo_id", "name"], "left_semi").select(*KEY).union(parse).distinct())
        left = state.read("edges", base).withColumnRenamed("src", "path").join(cached.join(again, KEY, "left_anti"), KEY, "left_semi").withColumnRenamed("path", "src")
        paths = known.select(*KEY, "language")
        edges = left.unionByName(extract.resolve_imports(known.join(again, KEY, "left_semi"), paths=paths))
    state.write(base, {"facts": known, "asks": asks, "edges": edges.select("repo_id", "src", "dst")})
    return status.join(again.withColumn("again", F.lit(True)), KEY, "left").select(*KEY, "sha256", "status", F.coalesce("again", F.lit(False)).alias("resolved"))


def open_state(spark: SparkSession, root: str) -> State:
    return State(spark, root)
