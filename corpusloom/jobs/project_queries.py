"""Queries over build files and exports of the graph, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.jobs import synth
from corpusloom.functions.staging import stage
from corpusloom.jobs.content_queries import BINDINGS, CALLS, EXPORTS, UNUSED, facts
from corpusloom.jobs.queries import FILES as SOURCES
from corpusloom.jobs.queries import GRAPH, LANG, LAYERED, nodes, query
from corpusloom.operators import extract, graph, project
from corpusloom.sources import sinks

#: Contents of the synthetic build files by number; suppliers are their repositories.
BUILDS = (
    ("package.json", '{"name": "shop", "version": "1.2.0", "dependencies": {"react": "18", "express": "4", "mysql2": "3"}}'),
    ("requirements.txt", "Django==4.2\npsycopg2\nredis\n"),
    ("pom.xml", "<project><artifactId>orders</artifactId><version>2.1</version><x>spring-boot-starter</x></project>"),
    ("go.mod", "module example.test/tool\nrequire github.com/gin-gonic/gin v1\n"),
    ("sub/pyproject.toml", 'name = "inner"\nversion = "0.3"\n'),
    ("pyproject.toml", 'name = "outer"\nversion = "0.4"\ndependencies = ["sqlite-utils"]\n'),
    ("src/main.py", "print(1)\n"), ("main.go", "package main\n"), ("app/controllers/a.rb", "x\n"), ("app/models/b.rb", "y\n"), ("src/service/c.py", "z\n"), ("src/core/d.py", "w\n"),
    ("settings.py", "ENGINE = 'mysql'\n"), ("src/main/java/App.java", "@SpringBootApplication\npublic class App {}\n"), ("web/src/App.tsx", "x\n"), ("lib/tool.csproj", "<Project/>\n"), ("k8s/app.yml", "a: 1\n"),
    ("composer.json", '{"name": "x/y", "description": "a shop", "require": {"laravel/framework": "10"}}'), ("setup.py", "setup(name='pack', version='1.0', description=\"packs\")\n"), ("x/usecases/a.go", "x\n"), ("x/entities/b.go", "x\n"),
    ("Cargo.toml", '[package]\nname = "crab"\nversion = "0.1"\ndescription = "a crab"\naxum = "1"\n'), ("Gemfile", "gem 'rails'\n"), (".github/workflows/ci.yml", "on: push\n"),
)


def builds(spark, d):
    """files: each supplier's repository holds the build files whose number divides evenly into its key by a small rule."""
    rows = [(i, p, c) for i, (p, c) in enumerate(BUILDS)]
    table = spark.createDataFrame(rows, "i int, path string, content string")
    keys = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("repo_id"))
    return keys.join(F.broadcast(table), (F.col("repo_id") + F.col("i") * 7) % 11 < 2).select("repo_id", "path", "content")  # a table of fixed size


_Q = lambda text: "'" + text.replace("'", "''") + "'"
FILES = (
    "files AS (SELECT s_suppkey AS repo_id, path, content FROM supplier, (VALUES "
    + ", ".join(f"({i}, {_Q(p)}, {_Q(c)})" for i, (p, c) in enumerate(BUILDS)) + ") b(i, path, content) WHERE (s_suppkey + i * 7) % 11 < 2), repos AS (SELECT DISTINCT repo_id FROM files)"
)
NAMES = "names(name, kind, tool, lang) AS (VALUES " + ", ".join(f"({_Q(a)}, {_Q(k)}, {_Q(b)}, {_Q(c)})" for a, k, b, c in project.BUILD_FILES) + ")"
BUILD = (
    NAMES + ", places AS (SELECT repo_id, path FROM files UNION SELECT repo_id, string_split(path, '/')[1] FROM files UNION SELECT repo_id, array_to_string(string_split(path, '/')[1:2], '/') FROM files "
    "UNION SELECT repo_id, array_to_string(string_split(path, '/')[1:3], '/') FROM files), "
    "known AS (SELECT f.*, kind, tool, lang, len(string_split(path, '/')) - len(string_split(name, '/')) AS depth FROM places f JOIN names n ON n.name = path OR ends_with(path, '/' || n.name)), "
    "build AS (SELECT repo_id, path AS build_file, kind AS project_type, tool AS build_tool, lang AS language, count(*) OVER (PARTITION BY repo_id) AS n_build_files FROM known WHERE depth <= 1 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY depth, path) = 1)"
)
FRAMEWORK = (
    "frameworks AS (SELECT DISTINCT repo_id, framework FROM files JOIN (VALUES " + ", ".join(f"({_Q(a)}, {_Q(b)}, {_Q(c)})" for a, b, c in project.FRAMEWORKS) + ") k(file, word, framework) ON path = file AND contains(lower(content), word) "
    "UNION SELECT repo_id, 'Django' FROM files WHERE path IN ('manage.py', 'settings.py', 'urls.py') UNION SELECT repo_id, '.NET' FROM files WHERE ends_with(path, '.csproj') UNION SELECT repo_id, 'Vue.js' FROM files WHERE ends_with(path, '.vue') "
    "UNION SELECT repo_id, 'React' FROM files WHERE ends_with(lower(path), 'src/app.tsx') UNION SELECT repo_id, 'Spring Boot' FROM files WHERE starts_with(path, 'src/') AND ends_with(path, '.java') AND contains(content, '@SpringBootApplication'))"
)
DATABASE = (
    NAMES + ", databases AS (SELECT DISTINCT repo_id, database FROM files JOIN (SELECT name FROM names UNION SELECT unnest([" + ", ".join(map(_Q, project.CONFIG_FILES)) + "])) n(name) ON path = name JOIN (VALUES "
    + ", ".join(f"({_Q(a)}, {_Q(b)})" for a, b in project.DATABASES) + ") k(word, database) ON contains(lower(content), word))"
)


@query("build_files", f"WITH {FILES}, {BUILD} SELECT * FROM build")
def _(spark, d):
    return project.build_files(builds(spark, d))


_META = lambda key, tag: (
    f"CASE WHEN path IN ('package.json', 'composer.json') THEN json_extract_string(content, '$.{key}') WHEN path IN ('pyproject.toml', 'Cargo.toml') THEN regexp_extract(content, '(?m)^{key}\\s*=\\s*\"([^\"]*)\"', 1) "
    f"WHEN path = 'setup.py' THEN regexp_extract(content, '\\b{key}\\s*=\\s*[''\"]([^''\"]*)[''\"]', 1) WHEN path = 'pom.xml' THEN regexp_extract(content, '<{tag}>([^<]*)<', 1)"
)


@query(
    "project_metadata",
    f"WITH {FILES}, named AS (SELECT repo_id, path, {_META('name', 'artifactId')} WHEN path = 'go.mod' THEN regexp_extract(content, '(?m)^module\\s+(\\S+)', 1) END AS name, {_META('version', 'version')} END AS version, "
    f"{_META('description', 'description')} END AS description FROM files WHERE path IN ('package.json', 'composer.json', 'pyproject.toml', 'Cargo.toml', 'setup.py', 'pom.xml', 'go.mod')) "
    "SELECT repo_id, name, version, nullif(description, '') AS description FROM named WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) = 1",
)
def _(spark, d):
    return project.project_metadata(builds(spark, d))


@query("detect_frameworks", f"WITH {FILES}, {FRAMEWORK} SELECT * FROM frameworks")
def _(spark, d):
    return project.detect_frameworks(builds(spark, d))


@query("detect_databases", f"WITH {FILES}, {DATABASE} SELECT * FROM databases")
def _(spark, d):
    return project.detect_databases(builds(spark, d))


@query(
    "detect_architecture",
    f"WITH {FILES}, {FRAMEWORK}, dirs AS (SELECT DISTINCT repo_id, unnest(string_split(lower(path), '/')[:-2]) AS dir FROM files), k(architecture, place, dir) AS (VALUES "
    + ", ".join(f"('{n}', {i}, '{x}')" for i, (n, xs) in enumerate(project.ARCHITECTURES) for x in xs)
    + "), s AS (SELECT repo_id, architecture, place, count(*) AS score FROM dirs JOIN k USING (dir) GROUP BY ALL HAVING count(*) >= 2), "
    "b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, place) = 1), "
    "u AS (SELECT repo_id, list(framework) AS used FROM frameworks GROUP BY 1) "
    f"SELECT r.repo_id, coalesce(architecture, CASE WHEN used IS NULL THEN '{project.PLAIN}' " + " ".join(f"WHEN list_has_any(used, [{', '.join(map(_Q, of))}]) THEN '{n}'" for n, of in project.BY_FRAMEWORK)
    + " ELSE 'unknown' END) AS architecture, coalesce(score, 0) AS score FROM repos r LEFT JOIN b ON r.repo_id = b.repo_id LEFT JOIN u ON r.repo_id = u.repo_id",
)
def _(spark, d):
    return project.detect_architecture(builds(spark, d))


@query(
    "entry_points",
    f"WITH {FILES}, p AS (SELECT unnest([{', '.join(map(_Q, project.ENTRY_POINTS))}]) AS path, generate_subscripts([{', '.join(map(_Q, project.ENTRY_POINTS))}], 1) AS place) "
    "SELECT repo_id, p.path, row_number() OVER (PARTITION BY repo_id ORDER BY place)::INT AS rank FROM p JOIN (SELECT DISTINCT repo_id, p.path FROM files f JOIN p ON f.path = p.path OR starts_with(f.path, p.path || '/')) h ON h.path = p.path QUALIFY rank <= 10",
)
def _(spark, d):
    return project.entry_points(builds(spark, d))


@query(
    "tech_stack",
    f"WITH {FILES}, {BUILD}, {FRAMEWORK}, {DATABASE[len(NAMES) + 2 :]}, f AS (SELECT repo_id, string_agg(framework, ',' ORDER BY framework) AS frameworks FROM frameworks GROUP BY 1), "
    "d AS (SELECT repo_id, string_agg(database, ',' ORDER BY database) AS databases FROM databases GROUP BY 1) "
    "SELECT r.repo_id, coalesce(language, '') AS language, coalesce(build_tool, '') AS build_tool, coalesce(frameworks, '') AS frameworks, coalesce(databases, '') AS databases, "
    "CASE " + " ".join(f"WHEN list_has_any(string_split(coalesce(frameworks, ''), ','), [{', '.join(map(_Q, of))}]) THEN '{n}'" for n, of in project.PROJECT_TYPES)
    + f" WHEN language IN ({', '.join(map(_Q, project.LANGUAGE_TYPES))}) THEN language ELSE coalesce(project_type, 'generic') END AS project_type "
    "FROM repos r LEFT JOIN build b ON r.repo_id = b.repo_id LEFT JOIN f ON r.repo_id = f.repo_id LEFT JOIN d ON r.repo_id = d.repo_id",
)
def _(spark, d):
    return project.tech_stack(builds(spark, d))


_COLOUR = "CASE layer " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sinks.COLOURS.items()) + f" ELSE '{sinks.OTHER_COLOUR}' END"


@query(
    "graph_export",
    f"WITH RECURSIVE {GRAPH}, {SOURCES}, {LAYERED}, {BINDINGS} SELECT g.repo_id, g.path, string_split(g.path, '/')[-1] AS label, imports, imported_by, layer, {_COLOUR} AS colour, "
    "(SELECT count(DISTINCT symbol) FROM refs r WHERE r.path = g.path) AS n_symbols FROM degrees g JOIN layers l ON g.path = l.path",
)
def _(spark, d):
    keys = synth.keys(spark, d)
    n, e, known = nodes(spark, d), stage(synth.edges(spark, d, keys)), facts(spark, d, synth.files(spark, d, keys))
    return sinks.graph_export(n, e, graph.assign_layers(n, e), extract.cross_refs(extract.symbol_bindings(known), known))


@query(
    "node_records",
    f"WITH RECURSIVE {GRAPH}, {SOURCES}, {LAYERED}, {CALLS}, {UNUSED[len(BINDINGS) + 2 :]}, {EXPORTS} SELECT l.repo_id, l.path, layer, "
    "coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edges e WHERE e.src = l.path), '') AS imports, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM edges e WHERE e.dst = l.path), '') AS imported_by, "
    f"{LANG.replace('path', 'l.path')} AS language, (len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines, "
    "(SELECT count(*) FROM exported x WHERE x.path = l.path) AS n_exports, coalesce((SELECT string_agg(DISTINCT symbol || '@' || dst, ',' ORDER BY symbol || '@' || dst) FROM refs r WHERE r.path = l.path), '') AS cross_refs, "
    "coalesce((SELECT string_agg(DISTINCT kind || ':' || member || '@' || dst, ',' ORDER BY kind || ':' || member || '@' || dst) FROM calls c WHERE c.src = l.path), '') AS call_targets, "
    "coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM unused u WHERE u.src = l.path), '') AS unused_imports FROM layers l JOIN files f ON f.path = l.path",
)
def _(spark, d):
    keys = synth.keys(spark, d)
    n, e, known = nodes(spark, d), stage(synth.edges(spark, d, keys)), facts(spark, d, synth.files(spark, d, keys))
    found = extract.targets(known)
    bound = extract.symbol_bindings(known, found)
    refs = extract.cross_refs(bound, known)
    rows = sinks.node_records(n, e, graph.assign_layers(n, e), known, refs, extract.call_targets(bound, known), extract.unused_imports(known, extract.resolve_imports(known, found=found), bound, refs))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    named = F.flatten(F.transform(F.map_entries("cross_refs"), lambda x: F.transform(x["value"], lambda v: F.concat(v, F.lit("@"), x["key"]))))
    called = F.transform("call_targets", lambda c: F.concat(c["kind"], F.lit(":"), c["symbol"], F.lit("@"), c["file"]))
    return rows.select(
        "repo_id", "path", "layer", joined("imports").alias("imports"), joined("imported_by").alias("imported_by"), "language", "lines", F.size("exports").cast("long").alias("n_exports"),
        joined(named).alias("cross_refs"), joined(called).alias("call_targets"), joined("unused_imports").alias("unused_imports"),
    )
