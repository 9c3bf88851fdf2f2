"""The library's queries over the given tables, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.jobs import synth
from corpusloom.operators import corpus, graph, history, rules
from corpusloom.operators.catalog import LANGUAGES, LAYER_WORDS, LAYERS

QUERIES = {}
ORACLES = {}

GRAPH, FILES, HISTORY = synth.GRAPH_SQL, synth.FILES_SQL, synth.HISTORY_SQL


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def nodes(spark, d):
    return synth.part_files(spark, d).select("repo_id", "path")


def state(files):
    """A former state: some files had other contents, some were missing, one of each repository is gone."""
    n = F.regexp_extract("path", r"m(\d+)\.", 1).cast("long")
    old = F.sha2(F.when(n % 17 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256)
    kept = files.where(n % 23 != 0).select("repo_id", "path", old.alias("sha256"))
    gone = files.select("repo_id").distinct().select("repo_id", F.lit("src/gone.py").alias("path"), F.lit("0").alias("sha256"))
    return kept.unionByName(gone)


STATE = """
state AS (
  SELECT repo_id, path, sha256(CASE WHEN key % 17 = 0 THEN content || 'x' ELSE content END) AS sha256 FROM files WHERE key % 23 <> 0
  UNION ALL SELECT DISTINCT repo_id, 'src/gone.py', '0' FROM files)
"""
LANG = "CASE regexp_extract(path, '\\.([^./]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items() if k in synth.EXTS) + " END"
LAYER = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{'|'.join(w)}') THEN '{n}'" for n, w in LAYER_WORDS) + " ELSE 'foundation' END"
DEPTHS = """
own AS (SELECT DISTINCT repo_id, src, dst FROM edges WHERE src <> dst),
up(start, place) AS (SELECT src, dst FROM own UNION SELECT u.start, o.dst FROM up u JOIN own o ON u.place = o.src),
looped AS (SELECT DISTINCT start FROM up WHERE start = place),
above AS (SELECT start AS path FROM looped UNION SELECT u.start FROM up u JOIN looped l ON u.place = l.start),
free AS (SELECT p.repo_id, p.path FROM part_files p LEFT JOIN above a USING (path) WHERE a.path IS NULL),
walk(path, depth) AS (
  SELECT path, 0 FROM free UNION
  SELECT o.src, w.depth + 1 FROM walk w JOIN own o ON o.dst = w.path JOIN free f ON f.path = o.src),
depths AS (SELECT p.repo_id, p.path, d.depth FROM part_files p LEFT JOIN (SELECT path, max(depth)::INT AS depth FROM walk GROUP BY path) d USING (path))
"""
DEGREES = """
degrees AS (
  SELECT p.repo_id, p.path, (SELECT count(*) FROM edges e WHERE e.src = p.path) AS imports, (SELECT count(*) FROM edges e WHERE e.dst = p.path) AS imported_by
  FROM part_files p)
"""
NAMED = "CASE " + " ".join(f"WHEN depth = {i} THEN '{n}'" for i, n in enumerate(LAYERS)) + " ELSE 'layer_' || depth END"
LAYERED = DEPTHS + ", " + DEGREES + f"""
, layers AS (
  SELECT d.repo_id, d.path, CASE WHEN depth IS NULL OR (imports = 0 AND imported_by = 0) THEN {LAYER.replace('path', 'd.path')} ELSE {NAMED} END AS layer
  FROM depths d JOIN degrees g ON d.path = g.path)
"""
SHORT_CYCLES = """
short_cycles AS (
  SELECT a.repo_id, a.src || ' > ' || a.dst AS cycle, 2 AS size FROM edges a JOIN edges b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
  UNION ALL
  SELECT a.repo_id, a.src || ' > ' || a.dst || ' > ' || b.dst, 3 FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src AND c.dst = a.src
  WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst
  UNION ALL
  SELECT a.repo_id, a.src || ' > ' || a.dst || ' > ' || b.dst || ' > ' || c.dst, 4
  FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src JOIN edges d ON c.dst = d.src AND d.dst = a.src
  WHERE a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND a.dst <> b.dst AND a.dst <> c.dst AND b.dst <> c.dst)
"""
#: Needs WITH RECURSIVE. A table of least ways between all pairs, one step a round, each pair once: no bound.
CYCLES = """
own_edges AS MATERIALIZED (SELECT DISTINCT repo_id, src, dst FROM edges WHERE src <> dst),
ways(x, y, way) USING KEY (x, y) AS (
  SELECT src, dst, [src, dst] FROM own_edges UNION
  SELECT w.x, e.dst, min(list_append(w.way, e.dst)) FROM ways w JOIN own_edges e ON w.y = e.src
  WHERE w.x <> w.y AND NOT EXISTS (SELECT 1 FROM recurring.ways r WHERE r.x = w.x AND r.y = e.dst) GROUP BY w.x, e.dst),
closed AS (
  SELECT e.repo_id, e.src, e.dst, [e.src] || w.way[:-2] AS cycle FROM own_edges e JOIN ways w ON w.x = e.dst AND w.y = e.src),
turned AS (SELECT DISTINCT repo_id, cycle[list_position(cycle, list_min(cycle)):] || cycle[:list_position(cycle, list_min(cycle)) - 1] AS cycle FROM closed),
cycles AS (SELECT repo_id, array_to_string(cycle, ' > ') AS cycle, len(cycle)::INT AS size FROM turned),
component_of AS (SELECT a.x AS path, least(a.x, min(a.y)) AS component FROM ways a JOIN ways b ON a.x = b.y AND a.y = b.x GROUP BY a.x),
unlisted AS (SELECT component FROM component_of GROUP BY component HAVING count(*) > 2
  AND component NOT IN (SELECT component FROM turned t JOIN component_of c ON c.path = t.cycle[1] WHERE len(t.cycle) > 2)),
more(component, way) AS (
  SELECT a.component, [src, dst] FROM own_edges e JOIN component_of a ON a.path = e.src JOIN component_of b ON b.path = e.dst AND b.component = a.component JOIN unlisted u ON u.component = a.component WHERE dst > src
  UNION ALL SELECT m.component, list_append(way, dst) FROM more m JOIN own_edges e ON e.src = m.way[-1] JOIN component_of b ON b.path = e.dst AND b.component = m.component
  WHERE dst > m.way[1] AND NOT list_contains(m.way, dst)),
more_closed AS (SELECT component, way FROM more m JOIN own_edges e ON e.src = m.way[-1] AND e.dst = m.way[1] WHERE len(way) > 2 QUALIFY row_number() OVER (PARTITION BY component ORDER BY len(way), way) = 1),
long_cycles AS (
  SELECT repo_id, cycle, size FROM cycles WHERE size > 2
  UNION ALL SELECT (SELECT any_value(repo_id) FROM own_edges e WHERE e.src = m.way[1]), array_to_string(way, ' > '), len(way) FROM more_closed m)
"""

# ---- corpus


@query("scan_files", f"WITH {GRAPH}, {FILES} SELECT repo_id, path FROM files WHERE NOT regexp_matches(path, '(^|/)(core|web)/') AND NOT regexp_matches(path, '(^|/)m1[^/]*\\.js$')")
def _(spark, d):
    return corpus.scan_files(synth.files(spark, d), ("core", "web"), ("m1*.js",)).select("repo_id", "path")


@query("language_counts", f"WITH {GRAPH} SELECT repo_id, {LANG} AS language, count(*) AS n_files FROM part_files GROUP BY 1, 2")
def _(spark, d):
    return corpus.language_counts(nodes(spark, d))


@query(
    "dominant_language",
    f"WITH {GRAPH}, counts AS (SELECT repo_id, {LANG} AS language, count(*) AS n FROM part_files GROUP BY 1, 2) "
    "SELECT repo_id, language FROM counts QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) = 1",
)
def _(spark, d):
    return corpus.dominant_language(nodes(spark, d))


@query("content_hash", "SELECT source AS repo_id, doc_id::VARCHAR AS path, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    return corpus.content_hash(_documents(spark, d))


def _documents(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))


@query(
    "changed_files",
    f"WITH {GRAPH}, {FILES}, {STATE} SELECT f.repo_id, f.path, sha256(f.content) AS sha256 FROM files f LEFT JOIN state s ON f.repo_id = s.repo_id AND f.path = s.path "
    "WHERE sha256(f.content) IS DISTINCT FROM s.sha256",
)
def _(spark, d):
    files = synth.files(spark, d)
    return corpus.changed_files(files, state(files))


@query("stale_entries", f"WITH {GRAPH}, {FILES}, {STATE} SELECT s.* FROM state s ANTI JOIN files f ON f.repo_id = s.repo_id AND f.path = s.path")
def _(spark, d):
    files = synth.files(spark, d)
    return corpus.stale_entries(files, state(files))


@query(
    "incremental_refresh",
    f"WITH {GRAPH}, {FILES}, {STATE} SELECT f.repo_id, f.path, sha256(f.content) AS sha256, CASE WHEN s.sha256 IS NULL THEN 'new' WHEN s.sha256 = sha256(f.content) THEN 'cached' "
    "ELSE 'changed' END AS status FROM files f LEFT JOIN state s ON f.repo_id = s.repo_id AND f.path = s.path",
)
def _(spark, d):
    files = synth.files(spark, d)
    return corpus.incremental_refresh(files, state(files))


@query(
    "line_count",
    "SELECT source AS repo_id, doc_id::VARCHAR AS path, (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END)::BIGINT AS n_lines FROM documents",
)
def _(spark, d):
    return corpus.line_count(_documents(spark, d))


@query("search_files", "SELECT page_id AS repo_id, url AS path FROM pages WHERE contains(lower(url), 'utm_source')")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("repo_id"), F.col("url").alias("path"))
    return corpus.search_files(pages, "UTM_source")


@query(
    "prompt_table",
    "SELECT source AS repo_id, doc_id::VARCHAR AS path, 'File: ' || doc_id || chr(10) || 'Lines: ' || len(string_split(text, chr(10))) || chr(10) || chr(10) || "
    "CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || chr(10) || '... (truncated)' ELSE text END AS prompt FROM documents",
)
def _(spark, d):
    return corpus.prompt_table(_documents(spark, d))


# ---- history

NEWEST = "newest AS (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, hash) <= 500)"


@query(
    "top_changed_files",
    f"WITH {HISTORY}, {NEWEST}, counted AS (SELECT repo_id, file, count(*) AS changes FROM newest JOIN commit_files USING (hash) GROUP BY 1, 2) "
    "SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY changes DESC, file)::INT AS rank FROM counted QUALIFY rank <= 20",
)
def _(spark, d):
    return history.top_changed_files(synth.commits(spark, d), synth.commit_files(spark, d))


@query(
    "contributors",
    f"WITH {HISTORY}, counted AS (SELECT repo_id, author, count(*) AS commits FROM commits GROUP BY 1, 2) "
    "SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, author)::INT AS rank, count(*) OVER (PARTITION BY repo_id) AS contributors FROM counted QUALIFY rank <= 10",
)
def _(spark, d):
    return history.contributors(synth.commits(spark, d))


@query(
    "monthly_activity",
    f"WITH {HISTORY}, {NEWEST}, counted AS (SELECT repo_id, strftime(ts, '%Y-%m') AS month, count(*) AS commits FROM newest GROUP BY 1, 2) "
    "SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY month DESC) <= 12",
)
def _(spark, d):
    return history.monthly_activity(synth.commits(spark, d))


@query(
    "weekday_activity",
    f"WITH {HISTORY}, {NEWEST}, days AS (SELECT unnest(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']) AS weekday) "
    "SELECT r.repo_id, weekday, (SELECT count(*) FROM newest n WHERE n.repo_id = r.repo_id AND strftime(n.ts, '%a') = weekday) AS commits FROM (SELECT DISTINCT repo_id FROM commits) r, days",
)
def _(spark, d):
    return history.weekday_activity(synth.commits(spark, d))


@query(
    "recent_commits",
    f"WITH {HISTORY} SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, hash)::INT AS rank, hash, author, strftime(ts, '%Y-%m-%d') AS date, substr(message, 1, 80) AS message FROM commits QUALIFY rank <= 10",
)
def _(spark, d):
    return history.recent_commits(synth.commits(spark, d))


@query(
    "repo_basics",
    f"WITH {HISTORY}, refs AS (SELECT c_custkey % 10 AS repo_id, CASE c_custkey % 3 WHEN 0 THEN 'branch' ELSE 'tag' END AS kind, 'v' || c_nationkey AS name FROM customer), "
    "b AS (SELECT repo_id, count(DISTINCT name) AS branches FROM refs WHERE kind = 'branch' GROUP BY 1), t AS (SELECT repo_id, array_to_string(list_sort(list(DISTINCT name))[1:10], ',') AS tags FROM refs WHERE kind = 'tag' GROUP BY 1) "
    "SELECT c.*, coalesce(branches, 0) AS branches, coalesce(tags, '') AS tags FROM (SELECT repo_id, count(*) AS commits, count(DISTINCT author) AS authors, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM commits GROUP BY 1) c "
    "LEFT JOIN b USING (repo_id) LEFT JOIN t USING (repo_id)",
)
def _(spark, d):
    kind = F.when(F.col("c_custkey") % 3 == 0, "branch").otherwise("tag")
    refs = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 10).alias("repo_id"), kind.alias("kind"), F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("name"))
    rows = history.repo_basics(synth.commits(spark, d), refs)
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")}).withColumn("tags", F.array_join("tags", ","))


# ---- graph


@query("reverse_dependencies", f"WITH {GRAPH} SELECT DISTINCT repo_id, dst AS path, src AS importer FROM edges")
def _(spark, d):
    return graph.reverse_dependencies(nodes(spark, d), synth.edges(spark, d))


@query("degrees", f"WITH {GRAPH}, {DEGREES} SELECT * FROM degrees")
def _(spark, d):
    return graph.degrees(nodes(spark, d), synth.edges(spark, d))


@query("detect_cycles", f"WITH RECURSIVE {GRAPH}, {CYCLES} SELECT * FROM cycles")
def _(spark, d):
    return graph.detect_cycles(synth.edges(spark, d))


@query("short_cycles", f"WITH {GRAPH}, {SHORT_CYCLES} SELECT *, 4 AS bound FROM short_cycles")
def _(spark, d):
    return graph.short_cycles(synth.edges(spark, d))


@query(
    "cycle_edges",
    f"WITH RECURSIVE {GRAPH}, up(start, place) AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT u.start, e.dst FROM up u JOIN edges e ON u.place = e.src) "
    "SELECT DISTINCT e.* FROM edges e JOIN up u ON u.start = e.dst AND u.place = e.src WHERE e.src <> e.dst",
)
def _(spark, d):
    return graph.cycle_edges(synth.edges(spark, d))


@query(
    "cycle_members",
    f"WITH RECURSIVE {GRAPH}, up(start, place) AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT u.start, e.dst FROM up u JOIN edges e ON u.place = e.src), "
    "mutual AS (SELECT a.start AS path, a.place AS other FROM up a JOIN up b ON a.start = b.place AND a.place = b.start), "
    "comp AS (SELECT path, min(other) AS component, count(DISTINCT other) AS size FROM mutual GROUP BY path) "
    "SELECT p.repo_id, c.* FROM comp c JOIN part_files p USING (path) WHERE c.size > 1",
)
def _(spark, d):
    return graph.cycle_members(synth.edges(spark, d))


@query("topological_layers", f"WITH RECURSIVE {GRAPH}, {DEPTHS} SELECT * FROM depths")
def _(spark, d):
    return graph.topological_layers(nodes(spark, d), synth.edges(spark, d))


@query("heuristic_layer", f"WITH {GRAPH} SELECT repo_id, path, {LAYER} AS layer FROM part_files")
def _(spark, d):
    return nodes(spark, d).withColumn("layer", graph.heuristic_layer(F.col("path")))


@query("assign_layers", f"WITH RECURSIVE {GRAPH}, {LAYERED} SELECT * FROM layers")
def _(spark, d):
    return graph.assign_layers(nodes(spark, d), synth.edges(spark, d))


@query("layer_histogram", f"WITH RECURSIVE {GRAPH}, {LAYERED} SELECT repo_id, layer, count(*) AS n_files FROM layers GROUP BY 1, 2")
def _(spark, d):
    return graph.layer_histogram(graph.assign_layers(nodes(spark, d), synth.edges(spark, d)))


@query("search_links", f"WITH {GRAPH} SELECT * FROM edges WHERE contains(src, '/core/') OR contains(dst, '/core/')")
def _(spark, d):
    return graph.search_links(nodes(spark, d), synth.edges(spark, d), "/CORE/")


# ---- rules

RULE_SQL = {
    "no_dependency": "SELECT repo_id, 'util-is-low' AS rule_name, 'error' AS severity, src AS file_path, dst AS related_file FROM edges WHERE regexp_matches(src, '/util/') AND regexp_matches(dst, '/(api|web)/')",
    "layer_rule": "SELECT repo_id, 'layers', 'warning', src, dst FROM (SELECT *, CASE WHEN regexp_matches(src, '/(web|api)/') THEN 'ui' WHEN regexp_matches(src, '/(service|domain)/') THEN 'logic' ELSE 'base' END AS a, "
    "CASE WHEN regexp_matches(dst, '/(web|api)/') THEN 'ui' WHEN regexp_matches(dst, '/(service|domain)/') THEN 'logic' ELSE 'base' END AS b FROM edges) WHERE a <> b AND a || '->' || b NOT IN ('ui->logic', 'logic->base', 'ui->base')",
    "naming_pattern": "SELECT repo_id, 'names', 'info', path, NULL FROM part_files WHERE contains(path, '/core/') AND NOT regexp_matches('m' || key, '^m[0-9]{1,3}$')",
    "disallowed_import": "SELECT repo_id, 'no-php', 'warning', src, dst FROM edges, (VALUES ('\\.php$'), ('/model/')) p(p) WHERE regexp_matches(dst, p)",
    "max_dependencies": "SELECT repo_id, 'few-imports', 'warning', src, NULL FROM edges WHERE ends_with(src, '.py') GROUP BY repo_id, src HAVING count(*) > 1",
    "max_cycle_size": "SELECT repo_id, 'short-cycles', 'error', string_split(cycle, ' > ')[1], cycle FROM long_cycles",
}
VIOLATIONS = "violations(repo_id, rule_name, severity, file_path, related_file) AS (" + " UNION ALL ".join(RULE_SQL.values()) + ")"
for _rule in rules.EXAMPLE_RULES:

    def _one(spark, d, rule=_rule):
        return rules.TYPES[rule["type"]](nodes(spark, d), synth.edges(spark, d), rule)

    query(f"rule_{_rule['type']}", f"WITH RECURSIVE {GRAPH}, {CYCLES}, v(repo_id, rule_name, severity, file_path, related_file) AS ({RULE_SQL[_rule['type']]}) SELECT * FROM v")(_one)


@query(
    "rule_summary",
    f"WITH RECURSIVE {GRAPH}, {CYCLES}, {VIOLATIONS} SELECT r.repo_id, 6 AS checked, 6 - count(DISTINCT rule_name) AS passed, count(*) FILTER (severity = 'error') AS n_error, "
    "count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info FROM (SELECT DISTINCT repo_id FROM part_files) r LEFT JOIN violations USING (repo_id) GROUP BY 1",
)
def _(spark, d):
    return rules.rule_summary(nodes(spark, d), synth.edges(spark, d))
