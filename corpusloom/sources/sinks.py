"""Writing results: nested node records and graph tables (states: see sources.state)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.corpus import basename
from corpusloom.operators.graph import degrees

#: Colours of layers in a drawing.
COLOURS = {"foundation": "#6b7280", "common": "#2563eb", "domain": "#059669", "application": "#d97706", "interface": "#dc2626"}
OTHER_COLOUR = "#9ca3af"


def _listed(rows: DataFrame, by: str, what, name: str) -> DataFrame:
    return rows.groupBy("repo_id", F.col(by).alias("path")).agg(F.array_sort(F.collect_set(what)).alias(name))


def node_records(
    files: DataFrame, edges: DataFrame, layers: DataFrame, known: DataFrame | None = None, refs: DataFrame | None = None, calls: DataFrame | None = None, unused: DataFrame | None = None,
) -> DataFrame:
    """One record per file with its imports and importers nested (sorted) and its layer; contents aren't shuffled. known (facts) adds
    language, purpose, lines and exports, refs cross_refs (a map from file to symbols), calls call_targets, unused unused_imports."""
    none = F.array().cast("array<string>")
    rows = files.select("repo_id", "path").join(layers, ["repo_id", "path"], "left").join(_listed(edges, "src", "dst", "imports"), ["repo_id", "path"], "left")
    rows = rows.join(_listed(edges, "dst", "src", "imported_by"), ["repo_id", "path"], "left").select("repo_id", "path", "layer", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))
    if known is not None:
        exported = F.transform("exports", lambda x: F.concat(x["kind"], F.lit(":"), x["name"])).alias("exports")
        rows = rows.join(known.select("repo_id", "path", "language", "purpose", F.col("n_lines").alias("lines"), exported), ["repo_id", "path"], "left")
    if refs is not None:
        to = refs.groupBy("repo_id", "path", "dst").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
        to = to.groupBy("repo_id", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dst", "symbols")))).alias("cross_refs"))
        rows = rows.join(to, ["repo_id", "path"], "left")
    if calls is not None:
        context = F.concat("symbol", F.lit("."), "member").alias("context")
        rows = rows.join(_listed(calls, "src", F.struct(F.col("dst").alias("file"), F.col("member").alias("symbol"), "kind", context), "call_targets"), ["repo_id", "path"], "left")
    if unused is not None:
        rows = rows.join(_listed(unused, "src", "dst", "unused_imports"), ["repo_id", "path"], "left").withColumn("unused_imports", F.coalesce("unused_imports", none))
    return rows


def report_json(records: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """JSON lines in order of repository and path, range-partitioned; with stats in folders nodes and stats."""
    nodes = path if stats is None else f"{path}/nodes"
    records.repartitionByRange("repo_id", "path").sortWithinPartitions("repo_id", "path").write.mode("overwrite").json(nodes)
    if stats is not None:
        stats.repartitionByRange("repo_id").sortWithinPartitions("repo_id").write.mode("overwrite").json(f"{path}/stats")


def graph_export(nodes: DataFrame, edges: DataFrame, layers: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Nodes as a drawing needs them: label, degree counts, the number of symbols they use of other files (with refs), layer and its
    colour (with layers). The edges are the links."""
    rows = degrees(nodes, edges).select("repo_id", "path", basename(F.col("path")).alias("label"), "imports", "imported_by")
    if refs is not None:
        counted = refs.select("repo_id", "path", "symbol").distinct().groupBy("repo_id", "path").agg(F.count("*").alias("n_symbols"))
        rows = rows.join(counted, ["repo_id", "path"], "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))
    if layers is not None:
        colour = F.lit(OTHER_COLOUR)
        for name, value in COLOURS.items():
            colour = F.when(F.col("layer") == name, value).otherwise(colour)
        rows = rows.join(layers.select("repo_id", "path", "layer"), ["repo_id", "path"], "left").withColumn("colour", colour)
    return rows
