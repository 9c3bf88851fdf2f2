"""Imports, exports, uses and purpose of files, and the resolution of names by joins.

``facts`` reads every file once, in one narrow pass, and leaves its content behind; all other operators are joins and
aggregations over these facts, keyed by (repo_id, path)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.sketch import may_match
from corpusloom.functions.staging import stage
from corpusloom.operators.catalog import EXPORT_RULES, JAVA_EXTERNAL, LANGUAGES, NAME_ROLES, RESOLUTION, ROLES
from corpusloom.operators.corpus import extension
from corpusloom.operators.hits import first, rows_of_files, suffix
from corpusloom.operators.imports import statements
from corpusloom.operators.lexing import bare, bare_and_code, code_only
from corpusloom.operators.uses import java_injections, java_uses, parse, python_uses

#: Lines that are imports: of scripts (what is declared beside an import of none still counts), and of other languages.
IMPORT_LINE = re.compile(r"\s*(?:import\b|export\b[^\n]*\bfrom\b|(?:const|let|var)\b[^\n]*\brequire\s*\()", re.ASCII)
PLAIN_IMPORT_LINE = re.compile(r"\s*(?:import|from|using|require|require_once|require_relative|include|include_once|use|package|namespace|#\s*include|#\s*import)\b", re.ASCII)

FACTS = (
    "language string, n_lines long, purpose string, imports array<struct<spec:string,kind:string,names:array<string>,candidates:array<string>>>, "
    "exports array<struct<kind:string,name:string>>, words array<string>, sites array<struct<symbol:string,member:string,kind:string>>"
)


def language(path: str) -> str:
    return LANGUAGES.get(suffix(path), "")


# ---- imports


def _folders(path: str, where: tuple[str, ...], package: str) -> Iterator[str]:
    own = path.rpartition("/")[0]
    for w in where:
        if w == "own":
            yield own
        elif w == "root":
            yield ""
        elif w == "up":
            parts = own.split("/")
            yield from ("/".join(parts[:i]) for i in range(len(parts) - 1, 0, -1))
        elif w == "package":
            if package and (own == package or own.endswith("/" + package)):
                yield own[: len(own) - len(package)].rstrip("/")
        else:
            yield w


def normal(path: str) -> str | None:
    """Without ``.`` and with each ``..`` taking back the part before it; None above the root."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def candidates(path: str, lang: str, spec: str, package: str = "") -> list[str]:
    """Where a spec's file may lie, best first."""
    if lang == "python":
        level = len(spec) - len(spec.lstrip("."))
        tail = spec[level:].replace(".", "/")
        own = path.rpartition("/")[0]
        bases = [own + "/.." * (level - 1)] if level else list(_folders(path, ("own", "root", "up"), ""))
        ways = [f"{b}/{tail}{e}" for b in bases for e in (".py", "/__init__.py") if tail or e[0] == "/"]
    else:
        family = "javascript" if lang == "typescript" else lang
        between, where, endings, inner = RESOLUTION[family]
        if family == "javascript" and not spec.startswith("."):
            return []
        if family == "dart" and spec.startswith("dart:") or spec.startswith(("http:", "https:")):
            return []
        spec = spec.removeprefix("package:")
        parts = [p for p in (spec.split(between) if between != "/" else [spec]) if p and p != "*"]
        if family == "rust" and parts and parts[0] in ("crate", "self", "super"):
            ups = 0
            while parts and parts[0] == "super":
                ups, parts = ups + 1, parts[1:]
            if ups:
                # a module's children lie beside it if it is mod.rs, lib.rs or main.rs, and in a folder of its name otherwise
                own, _, name = path.rpartition("/")
                ups -= 0 if name in ("mod.rs", "lib.rs", "main.rs") else 1
                where, parts = (own + "/.." * ups,), parts
            elif parts[0] == "self":
                where, parts = ("own",), parts[1:]
            else:
                where, parts = ("src", "root"), parts[1:]
        if family == "elixir":
            parts = [re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", p).lower() for p in parts]
        if family == "clojure":
            parts = [p.replace("-", "_") for p in parts]
        depths = range(len(parts), 0, -1) if inner else [len(parts)]
        ways = [f"{f}/{'/'.join(parts[:d])}{e}" for f in _folders(path, where, package) for d in depths for e in endings if parts]
    found = (normal(w) for w in ways)
    return list(dict.fromkeys(w for w in found if w))


def _python(tree: ast.Module) -> Iterator[tuple[str, str, list[str]]]:
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield a.name, "import", [a.asname or a.name.split(".")[0]]
        elif isinstance(node, ast.ImportFrom):
            dots = "." * (node.level or 0)
            if node.module is None:
                for a in node.names:
                    yield dots + a.name, "from", [a.asname or a.name]
            else:
                yield dots + node.module, "from", [a.asname or a.name for a in node.names]


def _listed(names: str) -> list[str]:
    """Local names of a list such as ``a, b as c, d: e``."""
    out = []
    for part in names.split(","):
        words = re.findall(r"[\w$*]+", re.split(r"\bas\b|:", part)[-1])
        if words and words[0] != "type" or len(words) > 1:
            out.append(words[-1])
    return out


def _script(text: str) -> Iterator[tuple[str, str, list[str]]]:
    for m in re.finditer(r"\b(import|export)\s+(?:type\s+)?([\w$*{},\s]*?)\s*\bfrom\s+['\"]([^'\"]+)['\"]", text):
        names: list[str] = []
        if m[1] == "import":
            braces = first(r"\{([^}]*)\}", m[2])
            star = first(r"\*\s+as\s+([\w$]+)", m[2])
            default = first(r"^\s*([\w$]+)", m[2])
            names = ([default] if default else []) + ([star] if star else []) + _listed(braces)
        yield m[3], "import" if m[1] == "import" else "export", names
    for m in re.finditer(r"\bimport\s+['\"]([^'\"]+)['\"]", text):
        yield m[1], "side-effect", []
    for m in re.finditer(r"\b(?:const|let|var)\s+(?:\{([^}]*)\}|([\w$]+))\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]", text):
        yield m[3], "require", [m[2]] if m[2] else _listed(m[1])
    for m in re.finditer(r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]", text):
        yield m[1], "dynamic", []


def _java(text: str) -> Iterator[tuple[str, str, list[str]]]:
    for m in re.finditer(r"\bimport\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", text):
        last = m[2].rpartition(".")[2]
        yield m[2], "static" if m[1] else "import", [last]


def _php(text: str) -> Iterator[tuple[str, str, list[str]]]:
    for m in re.finditer(r"(?m)^\s*use\s+(?:function\s+|const\s+)?\\?([\w\\]+?)(?:\s+as\s+(\w+)|\\\{([^}]*)\})?\s*;", text):
        if m[3] is None:
            yield m[1], "use", [m[2] or m[1].rpartition("\\")[2]]
            continue
        for part in m[3].split(","):
            name, _, alias = part.strip().partition(" as ")
            if name:
                yield f"{m[1]}\\{name.strip()}", "use", [alias.strip() or name.strip().rpartition("\\")[2]]
    for m in re.finditer(r"\b(?:include|require)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]", text):
        yield m[1], "include", []


def _go(text: str) -> Iterator[tuple[str, str, list[str]]]:
    def one(m: re.Match) -> tuple[str, str, list[str]]:
        return m[2], "import", [m[1] or m[2].rpartition("/")[2]]

    for m in re.finditer(r"(?m)^\s*import\s+(?:([\w.]+)\s+)?\"([^\"]+)\"", text):
        yield one(m)
    for block in re.finditer(r"\bimport\s*\(([^)]*)\)", text):
        for m in re.finditer(r"(?:([\w.]+)[ \t]+)?\"([^\"]+)\"", block[1]):
            yield one(m)


READERS = {"javascript": _script, "typescript": _script, "vue": _script, "svelte": _script, "java": _java, "php": _php, "go": _go}


def _imports(path: str, text: str, lang: str, tree: ast.Module | None = None) -> list[tuple[str, str, list[str], list[str]]]:
    read = READERS.get(lang)
    package = first(r"\bpackage\s+([\w.]+)\s*;", text).replace(".", "/") if lang == "java" else ""
    out: dict[tuple[str, str], list] = {}
    for spec, kind, names in _python(tree) if tree is not None else read(text) if read else statements(text, lang):
        family = "include" if lang == "php" and kind == "include" else "javascript" if lang in ("vue", "svelte") else lang
        ways = [] if lang == "java" and spec.startswith(JAVA_EXTERNAL) else candidates(path, family, spec, package)
        old = out.setdefault((spec, kind), [[], ways])
        old[0] += [n for n in names if n not in old[0]]
    return [(spec, kind, names, ways) for (spec, kind), (names, ways) in out.items()]


# ---- exports, uses, purpose


def _exports(text: str, lang: str, tree: ast.Module | None = None) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    if tree is not None:
        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                found.append(("fn", node.name))
            elif isinstance(node, ast.ClassDef):
                found.append(("class", node.name))
            elif isinstance(node, ast.Assign):
                found += [("var", t.id) for t in node.targets if isinstance(t, ast.Name)]
            elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                found.append(("var", node.target.id))
    else:
        family = "javascript" if lang in ("typescript", "vue", "svelte") else lang
        for of, kind, pattern in EXPORT_RULES:
            if of == family:
                found += [(kind, name) for name in re.findall(pattern, text, re.ASCII)]
    return [x for x in dict.fromkeys(found) if not x[1].startswith("_") or lang == "java"]


def _purpose(text: str, lang: str, exported: list[tuple[str, str]], tree: ast.Module | None = None, show: int = 3) -> str:
    """The docstring's first line; a role; the first classes, else functions; else ``module``."""
    if tree is not None:
        doc = (ast.get_docstring(tree) or "").strip()
        if doc:
            return doc.split("\n")[0].strip()
    if lang == "java":
        roles = [role for mark, role in ROLES if re.search(rf"@{mark}\b", text)]
        if roles:
            return " | ".join(roles)
        m = re.search(r"\b(class|interface|enum|record)\s+(\w+)", text)
        if m and m[1] != "class":
            return f"{m[1]}: {m[2]}"
        for ends, role in NAME_ROLES if m else ():
            if m[2].endswith(ends):
                return role
    names = [[n for k, n in exported if k in kinds] for kinds in (("class", "trait"), ("fn",))]
    if lang in ("javascript", "typescript", "vue", "svelte"):
        parts = re.findall(r"export\s+(?:default\s+)?(?:function|const|class)\s+([A-Z]\w*)", text)
        names = [parts, *names]
        titles = ("components", "classes", "functions")
    else:
        titles = ("classes", "functions")
    for title, some in zip(titles, names, strict=True):
        if some:
            return f"{title}: {', '.join(some[:show])}{' ...' if len(some) > show else ''}"
    return "module"


NO_CALLS = frozenset("if for while switch catch return function def class new and or not in elif else print".split())


def _sites(text: str, lang: str) -> list[tuple[str, str, str]]:
    """symbol, member, kind of every use in code without comments and strings: calls one row each, reads of members once."""
    out: list[tuple[str, str, str]] = []
    lines = PLAIN_IMPORT_LINE if lang not in ("javascript", "typescript", "vue", "svelte") else IMPORT_LINE
    body = "\n".join(x for x in text.split("\n") if not lines.match(x))
    members = set()
    if lang == "java":
        out = java_uses(body)
        members = {(owner, member) for owner, member, _ in out}
    else:
        # a file's variables and what they are instances of
        types = dict((name, kind) for kind, name in re.findall(r"\b([A-Z]\w*)(?:<[^>\n]*>)?\s+(\w+)\s*[;=,)]", body)) if lang in ("kotlin", "csharp", "php", "typescript") else {}
        types |= {name: kind for name, kind in re.findall(r"\$?(\w+)\s*=\s*new\s+(\w+)", body)}
        for m in re.finditer(r"\b(\w+)(?:\.|->)(\w+)\s*\(", text):
            owner = types.get(m[1], m[1])
            out.append((owner, m[2], "call"))
            members.add((owner, m[2]))
        for m in re.finditer(r"\b(\w+)\.(\w+)\b(?!\s*\()", body):
            owner = types.get(m[1], m[1])
            if (owner, m[2]) not in members and not m[1].isdigit():
                members.add((owner, m[2]))
                out.append((owner, m[2], "class_usage" if m[2][0].isupper() else "attribute"))
        out += [(name, name, "instantiate") for name in re.findall(r"\bnew\s+(\w+)\s*\(", body)]
    for m in re.finditer(r"\b(\w+)::(\w+)\s*\(", text):
        out.append((m[1], m[2], "static_call"))
        members.add((m[1], m[2]))
    for m in re.finditer(r"\b(\w+)::\$?(\w+)\b(?!\s*\()", text):
        if (m[1], m[2]) not in members and lang == "php":
            members.add((m[1], m[2]))
            out.append((m[1], m[2], "static_prop"))
    for m in re.finditer(r"(?<![\w.>:$@])(\w+)\s*\(", body):
        before = body[max(0, m.start() - 12) : m.start()]
        if m[1] not in NO_CALLS and not re.search(r"\b(?:new|def|function|fun|func|fn|sub|class)\s+$", before):
            out.append((m[1], m[1], "call"))
    for kind in ("extends", "implements"):
        for listed in re.findall(rf"\b{kind}\s+([\w\s,\\<>]+)", body):
            names = re.split(r"\b(?:extends|implements)\b|[\n{{]", listed)[0]
            out += [(name, name, kind) for name in re.findall(r"(\w+)(?:<[^>]*>)?\s*(?:,|$)", names.strip())]
    if lang == "php":
        for listed in re.findall(r"(?m)^[ \t]+use\s+([\w, ]+);", text):
            out += [(name, name, "trait_use") for name in re.findall(r"\w+", listed)]
    if lang in ("java", "kotlin"):
        out += java_injections(text)
    return out


def _words(text: str, lang: str) -> list[str]:
    """Distinct words of the lines that aren't imports."""
    lines = IMPORT_LINE if lang in ("javascript", "typescript", "vue", "svelte") else PLAIN_IMPORT_LINE
    body = "\n".join(x for x in text.split("\n") if not lines.match(x))
    return sorted(set(re.findall(r"[A-Za-z_$]\w*", body)))


def strip_comments(files: DataFrame, strings: bool = True) -> DataFrame:
    """repo_id, path, stripped: the content with its comments blanked (see lexing), and with ``strings`` false also what stands in strings.
    Length and lines stay. One narrow pass; a null content is empty."""
    strip = bare if strings else code_only
    return rows_of_files(files, lambda path, text: [(strip(text, language(path)),)], "stripped string")


def facts(files: DataFrame) -> DataFrame:
    """One row per file: repo_id, path, language, n_lines, purpose, imports, exports, words and sites (see FACTS). A null content is
    empty; a Python file with a syntax error has none."""

    def read(path: str, text: str) -> list[tuple]:
        lang = language(path)
        tree = parse(text) if lang == "python" else None
        clean, code = (text, "") if tree is not None else bare_and_code(text, lang)
        exported = _exports(clean, lang, tree)
        found = _imports(path, clean, lang, tree) if tree is not None or lang in READERS or lang in RESOLUTION else []
        if tree is not None:
            sites, words = python_uses(tree)
        else:
            sites, words = _sites(code, lang), _words(clean, lang)
        return [(lang, len(text.splitlines()), _purpose(clean, lang, exported, tree), found, exported, words, sites)]

    return rows_of_files(files, read, FACTS)


def raw_imports(known: DataFrame) -> DataFrame:
    """repo_id, path, spec, kind: one row per import, as written."""
    return known.select("repo_id", "path", F.explode("imports").alias("i")).select("repo_id", "path", "i.spec", "i.kind")


def resolved_specs(known: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """repo_id, path, spec, dst: each spec's first candidate that exists among ``paths`` (by default the files that are known). One equi-join
    on (repo_id, candidate), no contents in it; most candidates that no file has are dropped before it, by a sketch of the paths."""
    each = known.select("repo_id", "path", F.explode("imports").alias("i"))
    tried = each.select("repo_id", "path", F.col("i.spec").alias("spec"), F.posexplode("i.candidates").alias("rank", "candidate"))
    there = (known if paths is None else paths).select("repo_id", F.col("path").alias("candidate"))
    likely = may_match(tried, ["repo_id", "candidate"], there, ["repo_id", "candidate"])
    return likely.join(there, ["repo_id", "candidate"]).groupBy("repo_id", "path", "spec").agg(F.min_by("candidate", "rank").alias("dst"))


def targets(known: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """repo_id, path, spec, dst of every import that has a file, by its candidates or else by its class name (see class_name_imports). Written
    once: edges and bindings take it as ``found``."""
    direct = stage(resolved_specs(known, paths))
    named = class_name_imports(known, paths, direct).select("repo_id", F.col("src").alias("path"), "spec", "dst")
    return stage(direct.unionByName(named).distinct())


def resolve_imports(known: DataFrame, fallback: bool = True, paths: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """repo_id, src, dst: the files that a file imports. fallback: what no candidate resolves is looked for by its class name (Java and
    PHP, see resolve_by_class_name). paths: the files that exist, by default those that are known. found: ``targets``, if they are there."""
    if found is None:
        found = targets(known, paths) if fallback else resolved_specs(known, paths)
    return found.select("repo_id", F.col("path").alias("src"), "dst").where("src <> dst").distinct()


def unresolved(known: DataFrame, paths: DataFrame | None = None, direct: DataFrame | None = None) -> DataFrame:
    """repo_id, path, language, spec, kind of imports without a file. direct: ``resolved_specs``, if they are there."""
    each = known.select("repo_id", "path", "language", F.explode("imports").alias("i")).select("repo_id", "path", "language", "i.spec", "i.kind")
    return each.join(resolved_specs(known, paths) if direct is None else direct, ["repo_id", "path", "spec"], "left_anti")


def class_name_imports(known: DataFrame, paths: DataFrame | None = None, direct: DataFrame | None = None) -> DataFrame:
    """repo_id, src, spec, name, dst of Java and PHP imports that only a class name resolves; external prefixes never do."""
    left = unresolved(known.where("language in ('java', 'php')"), known if paths is None else paths, direct).where("kind in ('import', 'static', 'use')")
    name = F.regexp_extract("spec", r"(\w+)$", 1)
    out = None
    for lang, ext in (("java", "java"), ("php", "php")):
        wanted = left.where(F.col("language") == lang).select("repo_id", F.col("path").alias("src"), "spec", name.alias("name"))
        if lang == "java":
            external = F.lit(False)
            for prefix in JAVA_EXTERNAL:
                external = external | F.col("spec").startswith(prefix)
            wanted = wanted.where(F.col("name").rlike("^[A-Z]") & ~external)
        rows = wanted.join(resolve_by_class_name(wanted.select("repo_id", "src", "name"), known if paths is None else paths, ext), ["repo_id", "src", "name"])
        out = rows if out is None else out.unionByName(rows)
    return out


def resolve_by_class_name(wanted: DataFrame, files: DataFrame, ext: str) -> DataFrame:
    """repo_id, src, name, dst for wanted(repo_id, src, name): the least path whose file is called name.ext, anywhere in the
    repository. An equi-join on (repo_id, file name)."""
    named = files.where(extension(F.col("path")) == ext).select("repo_id", F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1).alias("name"), F.col("path").alias("dst"))
    return wanted.distinct().join(named, ["repo_id", "name"]).groupBy("repo_id", "src", "name").agg(F.min("dst").alias("dst"))


def external_imports(known: DataFrame) -> DataFrame:
    """Specs that nothing resolves, with how many files use them."""
    by_name = class_name_imports(known).select("repo_id", F.col("src").alias("path"), "spec")
    return unresolved(known).join(by_name, ["repo_id", "path", "spec"], "left_anti").groupBy("repo_id", "spec").agg(F.count_distinct("path").alias("n_files"))


def exports(known: DataFrame) -> DataFrame:
    """repo_id, path, kind, name of public symbols; names that begin with _ are private (but in Java)."""
    return known.select("repo_id", "path", F.explode("exports").alias("x")).select("repo_id", "path", "x.*")


def purpose(known: DataFrame) -> DataFrame:
    return known.select("repo_id", "path", "purpose")


def symbol_bindings(known: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """repo_id, path, symbol, dst: the local names that imports bind and the file they come from; ``*`` for all names of a file. Of
    several bindings of a name the last counts. found: ``targets``, if they are there."""
    each = known.select("repo_id", "path", F.posexplode("imports").alias("place", "i")).select("repo_id", "path", "place", F.col("i.spec").alias("spec"), F.explode("i.names").alias("symbol"))
    bound = each.join(targets(known) if found is None else found, ["repo_id", "path", "spec"])
    stars = bound.where("symbol = '*'").select("repo_id", "path", "symbol", "dst").distinct()
    last = Window.partitionBy("repo_id", "path", "symbol").orderBy(F.col("place").desc(), "dst")
    named = bound.where("symbol <> '*'").withColumn("turn", F.row_number().over(last)).where("turn = 1").select("repo_id", "path", "symbol", "dst")
    return named.unionByName(stars)


def _bound_files(bindings: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """repo_id, path, bound (the file's bindings) and ``column`` of the facts, for files with bindings. Facts that are bucketed by
    (repo_id, path) stay where they are; bindings, which are narrow, come to them."""
    bound = bindings.groupBy("repo_id", "path").agg(F.collect_set(F.struct("symbol", "dst")).alias("bound"))
    return bound.join(known.select("repo_id", "path", column), ["repo_id", "path"], "left")


def cross_refs(bindings: DataFrame, known: DataFrame) -> DataFrame:
    """repo_id, path, symbol, dst: bindings whose symbol occurs outside imports, each once; ``*`` always counts. Decided within the file's row."""
    used = F.filter("bound", lambda b: (b["symbol"] == "*") | F.array_contains(F.col("words"), b["symbol"]))
    return _bound_files(bindings, known, "words").select("repo_id", "path", F.explode(used).alias("b")).select("repo_id", "path", "b.symbol", "b.dst").distinct()


def call_targets(bindings: DataFrame, known: DataFrame) -> DataFrame:
    """repo_id, src, dst, symbol, member, kind, n_sites: uses of bound symbols. Sites meet bindings within the file's row."""
    of_symbol = lambda b: F.filter("sites", lambda s: s["symbol"] == b["symbol"])
    used = F.flatten(F.transform("bound", lambda b: F.transform(of_symbol(b), lambda s: F.struct(b["dst"].alias("dst"), s["symbol"].alias("symbol"), s["member"].alias("member"), s["kind"].alias("kind")))))
    rows = _bound_files(bindings, known, "sites").select("repo_id", "path", F.explode(used).alias("u")).select("repo_id", "path", "u.*")
    counted = rows.groupBy("repo_id", "path", "dst", "symbol", "member", "kind").agg(F.count("*").alias("n_sites"))
    return counted.select("repo_id", F.col("path").alias("src"), "dst", "symbol", "member", "kind", "n_sites")


def unused_imports(known: DataFrame, edges: DataFrame, bindings: DataFrame, refs: DataFrame) -> DataFrame:
    """repo_id, src, dst: imported files of which no symbol is used, in files that bind a symbol. Java has none."""
    binds = bindings.where("symbol <> '*'").select("repo_id", F.col("path").alias("src")).distinct()
    scripts = known.where("language <> 'java'").select("repo_id", F.col("path").alias("src"))
    left = edges.join(refs.select("repo_id", F.col("path").alias("src"), "dst"), ["repo_id", "src", "dst"], "left_anti")
    return left.join(binds, ["repo_id", "src"], "left_semi").join(scripts, ["repo_id", "src"], "left_semi").select("repo_id", "src", "dst")
