"""Queries over file contents: quality, security, endpoints, models, imports; each with equal SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions.staging import shared_dir, stage, stage_by
from corpusloom.jobs import synth
from corpusloom.jobs.queries import CYCLES, FILES, GRAPH, STATE, query
from corpusloom.operators import endpoints, extract, graph, incremental, models, quality, security
from corpusloom.operators.catalog import BRANCHES, ENDPOINT_RULES, EXPORT_RULES, HASH_COMMENTS, REACH, ROUTE_METHODS, SECURITY_RULES, SLASH_COMMENTS, UNCHECKED_DIRS
from corpusloom.operators.corpus import per_repo_top

Q = lambda text: "'" + text.replace("'", "''") + "'"
WITH = f"WITH {GRAPH}, {FILES}"


def _in(extensions) -> str:
    return "TRUE" if extensions is None else "ext IN (" + ", ".join(map(Q, extensions)) + ")"


def _holds(where: str, chars: int, pattern: str, wanted: bool) -> str:
    part = {
        "before": f"substr(content, greatest(1, start - {chars} + 1), least({chars}, start))", "from": f"substr(content, start + 1, {chars})",
        "line": "whole || regexp_extract(substr(content, start + length(whole) + 1), '^[^\n]*')",
    }[where]
    return f"{'' if wanted else 'NOT '}regexp_matches({part}, {Q(pattern)})"


def hits(pattern: str, extensions, conditions=()) -> str:
    """SQL: one row per match with repo_id, path, ext, content, whole, start and line."""
    held = " AND ".join(_holds(*c) for c in conditions)
    rows = (
        f"SELECT repo_id, path, ext, content, all_[i] AS whole, length(before) AS start, 1 + length(before) - length(replace(before, chr(10), '')) AS line FROM ("
        f"SELECT *, array_to_string(pieces[1:i], '') || array_to_string(all_[1:i-1], '') AS before FROM (SELECT *, unnest(range(1, len(all_) + 1)) AS i FROM ("
        f"SELECT repo_id, path, ext, content, regexp_extract_all(content, {Q(pattern)}) AS all_, string_split_regex(content, {Q(pattern)}) AS pieces FROM files WHERE {_in(extensions)})))"
    )
    return f"(SELECT * FROM ({rows}){f' WHERE {held}' if held else ''})"


# ---- quality

_BARE = "trim(x, ' ')"
COMMENTS = f"""
numbered AS (SELECT repo_id, path, ext, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files),
marked AS (
  SELECT *, starts_with({_BARE}, '/*') AS opens, contains({_BARE}, '*/') AS closes, starts_with({_BARE}, '//') AS slash,
    CASE WHEN starts_with({_BARE}, '//') THEN NULL WHEN contains({_BARE}, '*/') AND NOT starts_with({_BARE}, '/*') THEN 'c' WHEN starts_with({_BARE}, '/*') THEN 'o' END AS event
  FROM numbered),
stated AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM marked),
comments AS (
  SELECT path, count(*) FILTER (CASE WHEN ext IN ({', '.join(map(Q, HASH_COMMENTS))}) THEN starts_with(ltrim(x, ' '), '#') WHEN ext IN ({', '.join(map(Q, SLASH_COMMENTS))}) THEN coalesce(prior = 'o', FALSE) OR opens OR slash OR closes ELSE FALSE END) AS comment
  FROM stated GROUP BY path),
metrics AS (
  SELECT f.repo_id, f.path, len(string_split(content, chr(10)))::INT AS total, ((length(content) - length(replace(content, chr(10) || chr(10), ''))) // 2)::INT AS blank, c.comment::INT AS comment
  FROM files f JOIN comments c ON f.path = c.path)
"""


@query("line_metrics", f"{WITH}, {COMMENTS} SELECT *, total - blank - comment AS code FROM metrics")
def _(spark, d):
    return quality.line_metrics(synth.files(spark, d))


_SUM = " + ".join(["1", *(f"((length(t) - length(replace(t, {Q(w)}, ''))) // {len(w)})" for w in BRANCHES)])
_RUBY = " + ".join(f"((length(t) - length(replace(t, {Q(w)}, ''))) // {len(w)})" for w in quality.RUBY_BRANCHES)
_NAME = lambda named: f"regexp_extract(whole, {Q(named)}, 1)"
_PLAIN = "NOT (ext = 'java' AND ((starts_with(name, 'get') AND trim(inside) = '') OR (starts_with(name, 'set') AND NOT contains(inside, ','))))"
FUNCTIONS = (
    f"functions AS (SELECT repo_id, path, name, line, CASE WHEN ext = 'rb' THEN greatest(1, {_RUBY}) ELSE least({_SUM}, {quality.MOST}) END::INT AS complexity FROM ("
    + " UNION ALL ".join(
        f"SELECT repo_id, path, ext, {_NAME(named)} AS name, line, regexp_extract(whole, '\\(([^)]*)\\)', 1) AS inside, "
        f"substr(content, start + 1, {quality.RUBY_WINDOW if e == ('rb',) else quality.WINDOW}) AS t FROM {hits(p, e)}"
        + (f" WHERE {_NAME(named)} NOT IN ({', '.join(map(Q, none))})" if none else "")
        for e, p, named, none in quality.FUNCTIONS
    )
    + f") WHERE {_PLAIN})"
)


@query("functions", f"{WITH}, {FUNCTIONS} SELECT * FROM functions")
def _(spark, d):
    return quality.functions(synth.files(spark, d)).select("repo_id", "path", "name", "line", "complexity")


QUALITY = f"""
per AS (SELECT path, count(*) AS n_functions, sum(complexity)::BIGINT AS total_complexity, max(complexity) AS max_complexity, count(*) FILTER (complexity > {quality.COMPLEX}) AS n_complex FROM functions GROUP BY path),
file_quality AS (
  SELECT m.*, total - blank - comment AS code, round(comment::DOUBLE / total::DOUBLE, 3) AS comment_ratio, round(blank::DOUBLE / total::DOUBLE, 3) AS blank_ratio,
    round((total - blank - comment)::DOUBLE / total::DOUBLE, 3) AS code_ratio, coalesce(n_functions, 0) AS n_functions, coalesce(total_complexity, 0) AS total_complexity,
    coalesce(max_complexity, 0) AS max_complexity, coalesce(n_complex, 0) AS n_complex FROM metrics m LEFT JOIN per ON m.path = per.path)
"""


@query("file_quality", f"{WITH}, {COMMENTS}, {FUNCTIONS}, {QUALITY} SELECT * FROM file_quality")
def _(spark, d):
    return quality.file_quality(synth.files(spark, d)).drop("mean_lines")


@query(
    "complex_functions",
    f"{WITH}, {FUNCTIONS} SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC, path, line)::INT AS rank FROM functions WHERE complexity >= 3 QUALIFY rank <= 20",
)
def _(spark, d):
    return quality.complex_functions(synth.files(spark, d), least=3).select("repo_id", "path", "name", "line", "complexity", "rank")


GRADES = (
    "sums AS (SELECT repo_id, sum(total)::BIGINT AS total, sum(comment)::BIGINT AS comment, sum(n_functions)::BIGINT AS n_functions, sum(total_complexity)::BIGINT AS total_complexity FROM file_quality GROUP BY 1), "
    "graded AS (SELECT *, CASE WHEN comment / total < 0.03 THEN 'C' WHEN comment / total < 0.08 THEN 'B' ELSE 'A' END AS g, CASE WHEN n_functions > 0 THEN total_complexity / n_functions ELSE 0 END AS mean FROM sums), "
    "graded2 AS (SELECT repo_id, total, comment, n_functions, total_complexity, CASE WHEN mean > 15 THEN CASE WHEN g = 'B' THEN 'C' ELSE 'D' END ELSE g END AS grade FROM graded)"
)


@query("quality_summary", f"{WITH}, {COMMENTS}, {FUNCTIONS}, {QUALITY}, {GRADES} SELECT * FROM graded2")
def _(spark, d):
    return quality.quality_summary(synth.files(spark, d))


# ---- security

_MASK = "CASE WHEN length(whole) > 30 THEN left(whole, 20) || '***' || right(whole, 5) ELSE left(whole, 10) || '***' END"
_CHECKED = f"len(list_intersect(string_split(path, '/'), [{', '.join(map(Q, UNCHECKED_DIRS))}])) = 0"
ISSUES = "issues AS (" + " UNION ALL ".join(
    f"SELECT repo_id, path, {Q(r)} AS rule_id, {Q(t)} AS title, {Q(s)} AS severity, line, {_MASK if r == 'SEC-002' else 'left(whole, 80)'} AS snippet FROM {hits(p, e, c)} WHERE {_CHECKED}"
    for r, t, s, e, p, c in SECURITY_RULES
) + ")"


#: The files of the corpus and, for every seventh, one beside it that shouldn't be in a repository.
_RISKY = "files2 AS (SELECT repo_id, path FROM files UNION ALL SELECT repo_id, 'conf/' || CASE key % 3 WHEN 0 THEN 'k' || key || '.pem' WHEN 1 THEN 'd' || key || '/Dockerfile' ELSE 'vendor/' || key || '.env' END FROM part_files WHERE key % 7 = 0)"
_ALL_ISSUES = _RISKY + (
    ", all_issues AS (SELECT * FROM issues UNION ALL SELECT repo_id, path, 'SEC-001', CASE WHEN ends_with(path, '.pem') THEN 'sensitive file by extension' ELSE 'sensitive file by name' END, "
    "CASE WHEN ends_with(path, '.pem') THEN 'high' ELSE 'medium' END, 0, left(path, 80) FROM files2 WHERE starts_with(path, 'conf/') AND NOT contains(path, 'vendor/'))"
)


def risky_files(spark, d):
    key = F.col("key").cast("string")
    name = F.when(F.col("key") % 3 == 0, F.concat(F.lit("k"), key, F.lit(".pem"))).when(F.col("key") % 3 == 1, F.concat(F.lit("d"), key, F.lit("/Dockerfile"))).otherwise(F.concat(F.lit("vendor/"), key, F.lit(".env")))
    more = synth.part_files(spark, d).where("key % 7 = 0").select("repo_id", F.concat(F.lit("conf/"), name).alias("path"), F.lit("password = 'correct-horse'").alias("content"))
    return synth.files(spark, d).unionByName(more.withColumn("content", F.when(F.col("path").like("%.pem"), F.col("content")).otherwise("")))


@query("security_scan", f"{WITH}, {ISSUES} SELECT * FROM issues")
def _(spark, d):
    return security.security_scan(synth.files(spark, d))


@query(
    "security_summary",
    f"{WITH}, {ISSUES}, {_ALL_ISSUES} SELECT repo_id, count(*) AS n_issues, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low FROM all_issues GROUP BY 1",
)
def _(spark, d):
    return security.security_summary(security.all_issues(risky_files(spark, d)))


@query("first_issues", f"{WITH}, {ISSUES}, {_ALL_ISSUES} SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, line, rule_id, title, snippet)::INT AS rank FROM all_issues QUALIFY rank <= 50")
def _(spark, d):
    return security.first_issues(security.all_issues(risky_files(spark, d)))


@query(
    "sensitive_files",
    f"WITH {GRAPH}, p AS (SELECT repo_id, 'src/' || CASE key % 3 WHEN 0 THEN 'vendor/m' || key || '.pem' WHEN 1 THEN 'k' || key || '.PEM' ELSE 'd' || key || CASE key % 2 WHEN 0 THEN '/.Env' ELSE '/Dockerfile' END END AS path FROM part_files) "
    "SELECT repo_id, path, 'SEC-001' AS rule_id, CASE WHEN ends_with(path, '.PEM') OR ends_with(path, '.Env') THEN 'high' ELSE 'medium' END AS severity FROM p WHERE NOT contains(path, 'vendor/')",
)
def _(spark, d):
    key = F.col("key").cast("string")
    odd = F.when(F.col("key") % 3 == 0, F.concat(F.lit("vendor/m"), key, F.lit(".pem"))).when(F.col("key") % 3 == 1, F.concat(F.lit("k"), key, F.lit(".PEM"))).otherwise(F.concat(F.lit("d"), key, F.when(F.col("key") % 2 == 0, "/.Env").otherwise("/Dockerfile")))
    return security.sensitive_files(synth.part_files(spark, d).select("repo_id", F.concat(F.lit("src/"), odd).alias("path")))


# ---- endpoints

_ROUTE = (
    "CASE WHEN base IS NULL THEN sub WHEN sub = '' AND base = '' THEN '/' WHEN sub = '' THEN base WHEN base = '' THEN CASE WHEN starts_with(sub, '/') THEN sub ELSE '/' || sub END "
    "ELSE rtrim(base, '/') || CASE WHEN starts_with(sub, '/') THEN sub ELSE '/' || sub END END"
)
_METHOD = "CASE upper(m) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROUTE_METHODS.items()) + " ELSE upper(m) END"


def _endpoint(framework, extensions, pattern, method, route, base, handler, conditions) -> str:
    first = lambda p, text: f"regexp_extract({text}, {Q(p)}, 1)"
    if method.startswith("list:"):
        names = f"regexp_extract_all({first(method[5:], 'whole')}, '[''\"](\\w+)[''\"]', 1)"
        names = f"unnest(CASE WHEN len({names}) > 0 THEN {names} ELSE ['GET'] END)"
    else:
        names = first(method, "whole") if "(" in method else Q(method)
    sub = "''" if route is None else first(route[6:], "substr(content, start + 1, 200)") if route.startswith("after:") else first(route, "whole")
    based = "NULL" if base is None else f"rtrim({first(base, 'content')}, '/')"
    served = Q(handler[1:]) if handler[0] == "=" else first(handler, f"substr(content, start + 1, {REACH})")
    return f"SELECT repo_id, path, '{framework}' AS framework, {names} AS m, {based} AS base, {sub} AS sub, {served} AS handler, line FROM {hits(pattern, extensions, conditions)}"


ENDPOINTS = f"endpoints AS (SELECT repo_id, path, framework, {_METHOD} AS method, {_ROUTE} AS route, handler, line FROM (" + " UNION ALL ".join(_endpoint(*r) for r in ENDPOINT_RULES) + "))"


@query("endpoints", f"{WITH}, {ENDPOINTS} SELECT * FROM endpoints")
def _(spark, d):
    return endpoints.endpoints(synth.files(spark, d))


@query("endpoint_summary", f"{WITH}, {ENDPOINTS} SELECT repo_id, method, count(*) AS n_endpoints FROM endpoints GROUP BY 1, 2")
def _(spark, d):
    return endpoints.endpoint_summary(endpoints.endpoints(synth.files(spark, d)))


@query(
    "busiest_files",
    f"{WITH}, {ENDPOINTS}, c AS (SELECT repo_id, path, count(*) AS n_endpoints FROM endpoints GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n_endpoints DESC, path)::INT AS rank FROM c QUALIFY rank <= 5",
)
def _(spark, d):
    return endpoints.busiest_files(endpoints.endpoints(synth.files(spark, d)))


# ---- models

_SNAKE = "lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
# orm: the extension, a pattern of a class (its name is group 1), its explicit table, else its table, names of fields, relations; of this corpus,
# where a class reaches to the next class or the end of the file
MODEL_SQL = {
    "jpa": ("java", r"@Entity\s+(?:@Table\([^)]*\)\s+)?public class (\w+)", r"@Table\(name = \"(\w+)\"", "name", r"private\s+\w+\s+(\w+)\s*;", "@ManyToOne"),
    "django": ("py", r"class (\w+)\(models\.Model\)", r"db_table = '(\w+)'", _SNAKE, r"(\w+) = models\.\w+\(", r"models\.ForeignKey\("),
    "sqlalchemy": ("py", r"class (\w+)\(Base\)", r"__tablename__ = '(\w+)'", _SNAKE, r"(\w+) = (?:Column|relationship)\(", r"relationship\(|ForeignKey\("),
    "typeorm": ("ts", r"@Entity\('\w+'\)\s+export class (\w+)", r"@Entity\('(\w+)'", "lower(name)", r"Column\(\)\s+(\w+):", "@ManyToOne"),
    "sequelize": ("js", r"\.define\('(\w+)'", "tableName: '(\\w+)'", "name", r"(\w+): \{ type: \w+\.", "references"),
    "mongoose": ("js", r"(\w+) = new Schema\(", "collection: '(\\w+)'", "lower(name)", r"(\w+): \{ type: ", "ref: "),
    "gorm": ("go", r"type (\w+) struct \{\s+gorm", "tablename:(\\w+)", _SNAKE, r"(?m)^\t(\w+) \w+ `", "foreignKey"),
    "eloquent": ("php", r"class (\w+) extends Model", r"\$table = '(\w+)'", f"replace({_SNAKE}, '_', '')", r"'(\w+)'[,\]]", "belongsTo"),
    "activerecord": ("rb", r"class (\w+) < ApplicationRecord", "table_name = '(\\w+)'", f"replace({_SNAKE}, '_', '')", "never(x)", "never"),
}


def _models(orm, ext, head, explicit, table, field, relation) -> str:
    body = f"string_split_regex(content, {Q(head.replace('(', '(?:', 1) if head.startswith('(') else head.replace('(' + chr(92) + 'w+)', chr(92) + 'w+'))})"
    line = "1 + length(before) - length(replace(before, chr(10), ''))"
    n = f"len(regexp_extract_all(body, {Q(field)}, 1))"
    gorm = " + 1" if orm == "gorm" else ""
    return (
        f"SELECT repo_id, path, '{orm}' AS orm, name, coalesce(nullif(regexp_extract(whole || body, {Q(explicit)}, 1), ''), {table}) AS table_name, {line} AS line, "
        f"array_to_string(regexp_extract_all(body, {Q(field)}, 1), ',') AS fields, {n} AS n_fields, len(regexp_extract_all(body, {Q(relation)})) AS n_relations FROM ("
        f"SELECT repo_id, path, names[i] AS name, wholes[i] AS whole, parts[i + 1] AS body, array_to_string(parts[1:i], '') || array_to_string(wholes[1:i-1], '') AS before FROM ("
        f"SELECT *, unnest(range(1, len(names) + 1)) AS i FROM (SELECT repo_id, path, regexp_extract_all(content, {Q(head)}, 1) AS names, regexp_extract_all(content, {Q(head)}) AS wholes, {body} AS parts FROM files WHERE ext = '{ext}')))"
    )


MODELS = "models AS (SELECT repo_id, path, orm, name AS class_name, table_name, line, fields, n_fields, n_relations FROM (" + " UNION ALL ".join(_models(o, *x) for o, x in MODEL_SQL.items()) + "))"


def _orm_models(spark, d):
    found = models.orm_models(synth.files(spark, d))
    relations = F.size(F.filter("fields", lambda f: f["is_relation"])).cast("long")
    return found.withColumns({"n_relations": relations, "fields": F.array_join(F.transform("fields", lambda f: f["name"]), ",")})


@query("orm_models", f"{WITH}, {MODELS} SELECT * FROM models")
def _(spark, d):
    return _orm_models(spark, d)


@query("model_summary", f"{WITH}, {MODELS} SELECT repo_id, count(*) AS n_models, sum(n_fields)::BIGINT AS n_fields, string_agg(DISTINCT orm, ',' ORDER BY orm) AS orms FROM models GROUP BY 1")
def _(spark, d):
    return models.model_summary(models.orm_models(synth.files(spark, d)))


# ---- imports: the import lines of this corpus follow from its edges, so the SQL reads the edges and, of contents, only the bodies

SAME = (
    "same AS (SELECT a.repo_id, a.path AS src, b.path AS dst, a.ext, b.dir, e.dst AS n, e.src AS k, (e.src + e.dst) % 4 AS way, (e.src + e.dst) % 3 = 0 AS used "
    "FROM key_edges e JOIN part_files a ON e.src = a.key JOIN part_files b ON e.dst = b.key WHERE a.ext = b.ext)"
)
# extension: (kind, pattern of an import of the bodies)
BODY_IMPORTS = (
    ("py", "import", r"(?m)^import ([\w.]+)"), ("py", "import", r"(?m)^import \w+, (\w+) as"), ("py", "from", r"(?m)^from ([\w.]+) import"),
    ("js", "side-effect", r"import '([^']+)'"), ("js", "require", r"= require\('([^']+)'\)"), ("js", "dynamic", r"import\('([^']+)'\)"), ("js", "import", r"import [^']* from '([^']+)'"),
    ("js", "export", r"export \* from '([^']+)'"), ("java", "static", r"import static ([\w.]+);"), ("java", "import", r"import ([\w.]+(?:\.\*)?);"),
    ("go", "import", r"(?m)^\t(?:\w+ )?\"([^\"]+)\"$"), ("php", "use", r"(?m)^use (\w+\\\w+);"), ("rb", "require", r"require '(\w+)'"),
    ("cs", "using", r"using (?:static )?([\w.]+);"), ("rs", "use", r"use ((?:crate|super)(?:::\w+)*)(?:::\{[^}]*\})?;"), ("rs", "mod", r"mod (\w+);"),
)
IMPORTS = SAME + (
    ", imports AS (SELECT repo_id, src AS path, CASE WHEN ext = 'py' THEN 'src.' || dir || '.m' || n WHEN ext IN ('js', 'ts', 'rb') THEN '../' || dir || '/m' || n WHEN ext IN ('java', 'cs') THEN 'src.' || dir || '.m' || n "
    "WHEN ext = 'go' THEN 'src/' || dir || '/m' || n WHEN ext = 'rs' THEN 'crate::' || dir || '::m' || n WHEN way % 2 = 0 THEN '../' || dir || '/m' || n || '.php' ELSE 'src\\' || dir || '\\m' || n END AS spec, "
    "CASE ext WHEN 'py' THEN CASE way WHEN 2 THEN 'import' ELSE 'from' END WHEN 'rb' THEN 'require' WHEN 'cs' THEN 'using' WHEN 'rs' THEN 'use' WHEN 'php' THEN CASE way % 2 WHEN 0 THEN 'include' ELSE 'use' END "
    "WHEN 'js' THEN CASE way WHEN 2 THEN 'require' ELSE 'import' END WHEN 'ts' THEN CASE way WHEN 2 THEN 'require' ELSE 'import' END ELSE 'import' END AS kind FROM same UNION "
    + " UNION ".join(f"SELECT repo_id, path, {'$$self::$$ || ' if k == 'mod' else ''}unnest(regexp_extract_all(body, {Q(p)}, 1)), '{k}' FROM files WHERE ext = '{e}'" for e, k, p in BODY_IMPORTS)
    + " UNION SELECT repo_id, path, unnest(['Lib\\One', 'Lib\\Two']), 'use' FROM files WHERE contains(body, 'use Lib\\{'))"
)
RESOLVED = IMPORTS + ", resolved AS (SELECT DISTINCT repo_id, src, dst FROM same)"


def facts(spark, d, files=None):
    """Facts of the files, read once and written in buckets of (repo_id, path): the operators after it are joins, which leave them there."""
    return stage_by(extract.facts(synth.files(spark, d) if files is None else files), "repo_id", "path")


@query("raw_imports", f"{WITH}, {IMPORTS} SELECT * FROM imports")
def _(spark, d):
    return extract.raw_imports(extract.facts(synth.files(spark, d)))


@query("resolve_imports", f"{WITH}, {RESOLVED} SELECT * FROM resolved")
def _(spark, d):
    return extract.resolve_imports(facts(spark, d))


@query(
    "refresh_nodes",
    f"{WITH}, {RESOLVED}, {STATE}, listed AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS imports FROM resolved GROUP BY 1) "
    "SELECT f.repo_id, f.path, sha256(f.content) AS sha256, CASE WHEN s.sha256 IS NULL THEN 'new' WHEN s.sha256 = sha256(f.content) THEN 'cached' ELSE 'changed' END AS status, coalesce(imports, '') AS imports "
    "FROM files f LEFT JOIN state s ON f.repo_id = s.repo_id AND f.path = s.path LEFT JOIN listed l ON l.src = f.path "
    "UNION ALL SELECT repo_id, path, sha256, 'gone', '' FROM state WHERE path = 'src/gone.py'",
)
def _(spark, d):
    """A state of former files (some with other contents, some missing, some gone by now), brought up to date."""
    now = stage(synth.files(spark, d))
    n = F.regexp_extract("path", r"m(\d+)\.", 1).try_cast("long")
    gone = now.select("repo_id").distinct().select("repo_id", F.lit("src/gone.py").alias("path"), F.lit("import os\n").alias("content"))
    former = now.where(n % 23 != 0).select("repo_id", "path", F.when(n % 17 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content")).unionByName(gone)
    state = incremental.open_state(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    incremental.refresh(former, state)
    rows = incremental.refresh(now, state)
    listed = state.read("edges").groupBy("repo_id", F.col("src").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("imports"))
    hashes = F.when(F.col("status") == "gone", "0").otherwise(F.col("sha256")).alias("sha256")
    return rows.join(listed, ["repo_id", "path"], "left").select("repo_id", "path", hashes, "status", F.coalesce("imports", F.lit("")).alias("imports"))


@query("external_imports", f"{WITH}, {IMPORTS} SELECT repo_id, spec, count(DISTINCT path) AS n_files FROM imports WHERE NOT regexp_matches(spec, '[^a-z]m\\d+(\\.php)?$') GROUP BY 1, 2")
def _(spark, d):
    return extract.external_imports(facts(spark, d))


@query(
    "most_imported",
    f"{WITH}, {RESOLVED}, c AS (SELECT repo_id, dst AS path, count(*) AS imported_by FROM resolved GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY imported_by DESC, path)::INT AS rank FROM c QUALIFY rank <= 10",
)
def _(spark, d):
    known = facts(spark, d)
    rows = graph.reverse_dependencies(known, extract.resolve_imports(known)).groupBy("repo_id", "path").agg(F.count("*").alias("imported_by"))
    return per_repo_top(rows, 10, F.col("imported_by").desc(), F.col("path"))


_CLEAN = (
    r"CASE WHEN ext IN ('py', 'rb') THEN regexp_replace(content, '(?m)^\s*#[^\n]*$', '', 'g') "
    r"ELSE regexp_replace(regexp_replace(content, '/\*[\s\S]*?\*/', '', 'g'), '(?m)^\s*//[^\n]*$', '', 'g') END"
)
CLEAN = f"clean AS (SELECT repo_id, path, ext, head, turn, content, {_CLEAN} AS text FROM files)"
_OF = {"javascript": ("js", "ts"), "java": ("java",), "php": ("php",), "go": ("go",), "rust": ("rs",), "csharp": ("cs",), "ruby": ("rb",)}
_PY = (("fn", r"(?m)^(?:async )?def (\w+)"), ("class", r"(?m)^class (\w+)"), ("var", r"(?m)^(\w+) = "))
EXPORTS = CLEAN + ", x AS (" + " UNION ".join(
    [f"SELECT repo_id, path, '{k}' AS kind, unnest(regexp_extract_all(text, {Q(p)}, 1)) AS name FROM clean WHERE ext IN ({', '.join(map(Q, _OF[lang]))})" for lang, k, p in EXPORT_RULES if lang in _OF]
    + [f"SELECT repo_id, path, '{k}', unnest(regexp_extract_all(text, {Q(p)}, 1)) FROM clean WHERE ext = 'py'" for k, p in _PY]
) + "), exported AS (SELECT DISTINCT x.* FROM x WHERE NOT starts_with(name, '_') OR ends_with(path, '.java'))"


@query("exports", f"{WITH}, {EXPORTS} SELECT * FROM exported")
def _(spark, d):
    return extract.exports(extract.facts(synth.files(spark, d)))


BINDINGS = IMPORTS + (
    ", bindings AS (SELECT repo_id, src AS path, CASE WHEN ext IN ('py', 'js', 'ts') THEN 'f' ELSE 'm' END || n AS symbol, dst FROM same WHERE ext <> 'php' OR way % 2 = 1 "
    "UNION SELECT repo_id, src, 'a' || n, dst FROM same WHERE ext IN ('py', 'js', 'ts') AND way = 1), "
    "refs AS (SELECT repo_id, src AS path, CASE WHEN ext IN ('py', 'js', 'ts') THEN 'f' ELSE 'm' END || n AS symbol, dst FROM same WHERE used AND (ext <> 'php' OR way % 2 = 1))"
)


@query("symbol_bindings", f"{WITH}, {BINDINGS} SELECT * FROM bindings")
def _(spark, d):
    return extract.symbol_bindings(facts(spark, d))


@query("cross_refs", f"{WITH}, {BINDINGS} SELECT * FROM refs")
def _(spark, d):
    known = facts(spark, d)
    return extract.cross_refs(extract.symbol_bindings(known), known)


CALLS = BINDINGS + (
    ", calls AS (SELECT repo_id, path AS src, dst, symbol, CASE WHEN starts_with(symbol, 'f') THEN symbol ELSE 'run' END AS member, "
    "CASE WHEN ends_with(path, '.php') OR ends_with(path, '.rs') THEN 'static_call' ELSE 'call' END AS kind, 1::BIGINT AS n_sites FROM refs)"
)


@query("call_targets", f"{WITH}, {CALLS} SELECT * FROM calls")
def _(spark, d):
    known = facts(spark, d)
    return extract.call_targets(extract.symbol_bindings(known), known)


# ---- comments, strings and scopes: files made of uses that count and of such that don't

_STRIPPED = "CASE ext " + " ".join(f"WHEN '{e}' THEN regexp_replace(content, {Q(p)}, ' ', 'g')" for e, p in synth.USE_COMMENTS.items()) + " END"


@query("strip_comments", f"{WITH}, {synth.USES_SQL} SELECT repo_id, path, length(content)::INT AS n_chars, regexp_replace({_STRIPPED}, '\\s+', ' ', 'g') AS code FROM use_files")
def _(spark, d):
    rows = extract.strip_comments(synth.use_files(spark, d))
    return rows.select("repo_id", "path", F.length("stripped").alias("n_chars"), F.regexp_replace("stripped", r"\s+", " ").alias("code"))


_SITES = ", ".join(f"('{e}', '{m}', '{k}')" for e, sites in synth.USE_SITES.items() for m, k in sites)


@query(
    "call_sites",
    f"{WITH}, {SAME}, sites(ext, member, kind) AS (VALUES {_SITES}) SELECT repo_id, src, dst, CASE WHEN ext IN ('py', 'js', 'ts') THEN 'f' ELSE 'm' END || n AS symbol, replace(member, '{{n}}', n::VARCHAR) AS member, kind, 1::BIGINT AS n_sites "
    "FROM same JOIN sites USING (ext) WHERE used AND (ext <> 'php' OR way % 2 = 1)",
)
def _(spark, d):
    known = stage(extract.facts(synth.use_files(spark, d)))
    return extract.call_targets(extract.symbol_bindings(known), known)


@query(
    "call_rollup",
    f"{WITH}, {CALLS} SELECT repo_id, dst, count(*) AS n_calls, count(DISTINCT src) AS n_callers, array_to_string(list_sort(list(DISTINCT src))[1:5], ',') AS first_callers FROM calls GROUP BY 1, 2",
)
def _(spark, d):
    known = facts(spark, d)
    return graph.call_rollup(extract.call_targets(extract.symbol_bindings(known), known))


UNUSED = BINDINGS + (
    ", unused AS (SELECT DISTINCT s.repo_id, s.src, s.dst FROM same s ANTI JOIN refs r ON s.src = r.path AND s.dst = r.dst WHERE s.ext <> 'java' AND s.src IN (SELECT path FROM bindings))"
)


@query("unused_imports", f"{WITH}, {UNUSED} SELECT * FROM unused")
def _(spark, d):
    known = facts(spark, d)
    found = extract.targets(known)
    bound = extract.symbol_bindings(known, found)
    return extract.unused_imports(known, extract.resolve_imports(known, found=found), bound, extract.cross_refs(bound, known))


#: What the bodies are for, by extension, as their authors would say.
PURPOSES = {
    "py": ("functions: load", "functions: items, one", "classes: Account", "module", "classes: Runner", "classes: Order, Line", "functions: files", "functions: query"),
    "js": ("functions: start", "components: View", "module", "module", "components: Panel", "module"),
    "java": ("rest controller", "entity", "classes: Feed", "classes: Store"),
    "go": ("classes: Server", "classes: Reader", "module", "classes: User"),
    "php": ("classes: Page", "module", "classes: Shape, Marks", "classes: Book"),
    "ts": ("components: CatsController", "components: Photo", "functions: pick"),
    "rb": ("classes: Cart", "functions: helper"),
    "cs": ("classes: ItemsController", "classes: IShape, Kind"),
    "rs": ("classes: App, Run", "classes: Mode"),
}


@query(
    "purpose",
    f"{WITH}, p(ext, turn, purpose) AS (VALUES {', '.join(f'({Q(e)}, {i}, {Q(t)})' for e, ts in PURPOSES.items() for i, t in enumerate(ts))}) SELECT repo_id, path, p.purpose FROM files JOIN p USING (ext, turn)",
)
def _(spark, d):
    return extract.purpose(extract.facts(synth.files(spark, d)))


@query(
    "resolve_by_class_name",
    f"{WITH}, "
    "w AS (SELECT DISTINCT repo_id, path AS src, 'm' || regexp_extract(path, 'm(\\d+)', 1) AS name FROM files WHERE ext = 'php') "
    "SELECT w.repo_id, w.src, w.name, min(f.path) AS dst FROM w JOIN files f ON w.repo_id = f.repo_id AND w.name = regexp_extract(f.path, '([^/]+)\\.[^.]*$', 1) AND f.ext = 'php' GROUP BY ALL",
)
def _(spark, d):
    files = synth.files(spark, d)
    wanted = files.where("path like '%.php'").select("repo_id", F.col("path").alias("src"), F.concat(F.lit("m"), F.regexp_extract("path", r"m(\d+)", 1)).alias("name"))
    return extract.resolve_by_class_name(wanted, files, "php")


# ---- all figures of a repository

_COUNT = lambda table, where="": f"(SELECT count(*) FROM {table} t WHERE t.repo_id = r.repo_id{where})"


@query(
    "graph_stats",
    f"WITH RECURSIVE {GRAPH}, {FILES}, {CYCLES}, {UNUSED}, {CALLS[len(BINDINGS) + 2 :]}, {ISSUES}, {ENDPOINTS}, {MODELS}, {COMMENTS.strip()}, {FUNCTIONS}, {QUALITY.strip()}, {GRADES} "
    f"SELECT r.repo_id, {_COUNT('files')} AS n_files, {_COUNT('edges')} AS n_imports, (SELECT count(DISTINCT src) FROM edges t WHERE t.repo_id = r.repo_id) AS n_importing, "
    f"(SELECT count(DISTINCT dst) FROM edges t WHERE t.repo_id = r.repo_id) AS n_imported, {_COUNT('cycles')} AS n_cycles, (SELECT count(DISTINCT (path, dst)) FROM refs t WHERE t.repo_id = r.repo_id) AS n_refs, "
    f"{_COUNT('calls')} AS n_calls, {_COUNT('unused')} AS n_unused, {_COUNT('endpoints')} AS n_endpoints, {_COUNT('models')} AS n_models, {_COUNT('issues')} AS n_issues, "
    "(SELECT sum(len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END)::BIGINT FROM files t WHERE t.repo_id = r.repo_id) AS n_lines, "
    "(SELECT grade FROM graded2 t WHERE t.repo_id = r.repo_id) AS grade FROM (SELECT DISTINCT repo_id FROM part_files) r",
)
def _(spark, d):
    keys = synth.keys(spark, d)
    files, edges = stage(synth.files(spark, d, keys)), stage(synth.edges(spark, d, keys))
    known = facts(spark, d, files)
    found = extract.targets(known)
    bound = extract.symbol_bindings(known, found)
    refs = extract.cross_refs(bound, known)
    counted = {
        "cycles": graph.detect_cycles(edges), "refs": refs.select("repo_id", "path", "dst").distinct(), "calls": extract.call_targets(bound, known),
        "unused": extract.unused_imports(known, extract.resolve_imports(known, found=found), bound, refs), "endpoints": endpoints.endpoints(files),
        "models": models.orm_models(files), "issues": security.all_issues(files),
    }
    columns = {"lines": known.groupBy("repo_id").agg(F.sum("n_lines").alias("n_lines")), "grade": quality.quality_summary(files).select("repo_id", "grade")}
    return graph.graph_stats(known, edges, counted, columns)
