"""Architecture rules over edges(repo_id, src, dst) and nodes(repo_id, path), given as dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage
from corpusloom.operators.graph import long_cycles

VIOLATION = ("repo_id", "rule_name", "severity", "file_path", "related_file")

#: A rule of each type.
EXAMPLE_RULES = (
    {"name": "util-is-low", "type": "no_dependency", "severity": "error", "from": "/util/", "to": "/(api|web)/"},
    {"name": "layers", "type": "layer_rule", "layers": {"ui": "/(web|api)/", "logic": "/(service|domain)/", "base": "/(util|core|model)/"}, "allow": ["ui->logic", "logic->base", "ui->base"]},
    {"name": "names", "type": "naming_pattern", "severity": "info", "target": "/core/", "pattern": "m[0-9]{1,3}$"},
    {"name": "no-php", "type": "disallowed_import", "disallowed": [r"\.php$", "/model/"]},
    {"name": "few-imports", "type": "max_dependencies", "target": r"\.py$", "max": 1},
    {"name": "short-cycles", "type": "max_cycle_size", "severity": "error", "max": 2},
)


def _shaped(rows: DataFrame, rule: dict, file_path: Column, related: Column) -> DataFrame:
    return rows.select(
        "repo_id", F.lit(rule.get("name", rule["type"])).alias("rule_name"), F.lit(rule.get("severity", "warning")).alias("severity"),
        file_path.alias("file_path"), related.alias("related_file"),
    )


def _forbidden(rule: dict) -> Column:
    return (F.col("src").rlike(rule["from"]) & F.col("dst").rlike(rule["to"])).cast("int")


def _crossing(rule: dict) -> Column:
    def layer(path: Column) -> Column:
        found = F.lit("unknown")
        for name, pattern in reversed(rule["layers"].items()):
            found = F.when(path.rlike(pattern), name).otherwise(found)
        return found

    a, b = layer(F.col("src")), layer(F.col("dst"))
    return ((a != b) & ~F.concat(a, F.lit("->"), b).isin(*rule["allow"])).cast("int")


def _disallowed(rule: dict) -> Column:
    hits = F.lit(0)
    for pattern in rule["disallowed"]:
        hits = hits + F.col("dst").rlike(pattern).cast("int")
    return hits


#: Rules that look at each edge by itself, and how often an edge violates them.
PER_EDGE = {"no_dependency": _forbidden, "layer_rule": _crossing, "disallowed_import": _disallowed}


def _edge_hits(edges: DataFrame, rules: Sequence[tuple[int, dict]]) -> DataFrame:
    """All violations of rules on single edges, in one pass over the edges."""
    counted = [
        F.struct(F.lit(i).alias("rule"), F.lit(r.get("name", r["type"])).alias("rule_name"), F.lit(r.get("severity", "warning")).alias("severity"), F.coalesce(PER_EDGE[r["type"]](r), F.lit(0)).alias("n"))
        for i, r in rules
    ]
    hits = edges.select("repo_id", "src", "dst", F.explode(F.filter(F.array(*counted), lambda x: x["n"] > 0)).alias("x"))
    hits = hits.select("repo_id", "src", "dst", "x", F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("turn"))
    return hits.select("x.rule", "repo_id", "x.rule_name", "x.severity", F.col("src").alias("file_path"), F.col("dst").alias("related_file"))


def no_dependency(nodes: DataFrame, edges: DataFrame, rule: dict) -> DataFrame:
    return _edge_hits(edges, [(0, rule)]).select(*VIOLATION)


def layer_rule(nodes: DataFrame, edges: DataFrame, rule: dict) -> DataFrame:
    """Edges between different layers that the allow list lacks; the first matching layer counts."""
    return _edge_hits(edges, [(0, rule)]).select(*VIOLATION)


def naming_pattern(nodes: DataFrame, edges: DataFrame, rule: dict) -> DataFrame:
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    bad = F.col("path").rlike(rule["target"]) & ~stem.rlike(f"^(?:{rule['pattern']})")
    return _shaped(nodes.where(bad), rule, F.col("path"), F.lit(None).cast("string"))


def disallowed_import(nodes: DataFrame, edges: DataFrame, rule: dict) -> DataFrame:
    """One row for each edge and pattern."""
    return _edge_hits(edges, [(0, rule)]).select(*VIOLATION)


def max_dependencies(nodes: DataFrame, edges: DataFrame, rule: dict) -> DataFrame:
    many = edges.where(F.col("src").rlike(rule.get("target", ""))).groupBy("repo_id", "src").agg(F.count("*").alias("n")).where(F.col("n") > rule.get("max", 20))
    return _shaped(many, rule, F.col("src"), F.lit(None).cast("string"))


def max_cycle_size(nodes: DataFrame, edges: DataFrame, rule: dict) -> DataFrame:
    """Cycles longer than the rule's max, of any length (see graph.long_cycles): every component that has one has a row."""
    return _shaped(long_cycles(edges, rule.get("max", 2)), rule, F.split("cycle", " > ")[0], F.col("cycle"))


TYPES = {f.__name__: f for f in (no_dependency, layer_rule, naming_pattern, disallowed_import, max_dependencies, max_cycle_size)}


def check_rules(nodes: DataFrame, edges: DataFrame, rules: Sequence[dict] = EXAMPLE_RULES) -> DataFrame:
    """All violations, with the place of their rule in the list; a rule of unknown type has none. Where several rules read the edges, these
    are written once; rules on single edges share one pass."""
    shape = "rule int, repo_id string, rule_name string, severity string, file_path string, related_file string"
    known = [(i, r) for i, r in enumerate(rules) if r["type"] in TYPES]
    single, rest = [x for x in known if x[1]["type"] in PER_EDGE], [x for x in known if x[1]["type"] not in PER_EDGE]
    if bool(single) + sum(r["type"] != "naming_pattern" for _, r in rest) > 1:
        edges = stage(edges.select("repo_id", "src", "dst"))
    parts = [_edge_hits(edges, single).select("rule", *VIOLATION)] if single else []
    parts += [TYPES[r["type"]](nodes, edges, r).select(F.lit(i).alias("rule"), *VIOLATION) for i, r in rest]
    out = parts[0] if parts else nodes.sparkSession.createDataFrame([], shape)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def rule_summary(nodes: DataFrame, edges: DataFrame, rules: Sequence[dict] = EXAMPLE_RULES) -> DataFrame:
    """One row per repository: rules checked and passed, violations by severity. Rules count by their place in the list, so two
    without a name are two."""
    per = check_rules(nodes, edges, rules).groupBy("repo_id").agg(
        F.count_distinct("rule").alias("failed"), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warning", "info"))
    )
    zero = F.lit(0)
    return nodes.select("repo_id").distinct().join(per, "repo_id", "left").select(
        "repo_id", F.lit(len(rules)).alias("checked"), (F.lit(len(rules)) - F.coalesce("failed", zero)).alias("passed"),
        *(F.coalesce(f"n_{s}", zero).alias(f"n_{s}") for s in ("error", "warning", "info")),
    )
