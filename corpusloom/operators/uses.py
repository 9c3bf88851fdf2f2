"""Uses of names by scope: a visitor of Python's syntax trees and a scoped table of Java's declarations.

A use is (symbol, member, kind). Names that a parameter, a local variable, a comprehension or a nested definition hides are no uses of the
import of that name.
"""

from __future__ import annotations

import ast
import re

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def parse(text: str) -> ast.Module:
    """A file that isn't Python's syntax has no facts."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return ast.Module(body=[], type_ignores=[])


def _arguments(node: ast.AST) -> list[ast.arg]:
    a = node.args
    return [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]


def _local_names(node: ast.AST) -> frozenset[str]:
    """What a function's own scope binds, but for imports (their symbols stay what they are) and global or nonlocal names."""
    bound, kept = {a.arg for a in _arguments(node)}, set()
    stack = [node.body] if isinstance(node, ast.Lambda) else list(node.body)
    while stack:
        x = stack.pop()
        if isinstance(x, ast.Name) and not isinstance(x.ctx, ast.Load):
            bound.add(x.id)
        elif isinstance(x, (ast.Global, ast.Nonlocal)):
            kept |= set(x.names)
        elif isinstance(x, (ast.Import, ast.ImportFrom)):
            kept |= {a.asname or a.name.split(".")[0] for a in x.names}
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            bound.add(x.name)
            continue  # its body is a scope of its own
        elif isinstance(x, (ast.Lambda, *COMPREHENSIONS)):
            continue
        elif isinstance(x, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and x.name:
            bound.add(x.name)
        elif isinstance(x, ast.MatchMapping) and x.rest:
            bound.add(x.rest)
        stack += ast.iter_child_nodes(x)
    return frozenset(bound - kept)


def _rebound(tree: ast.Module) -> dict[str, int]:
    """Names that the module imports and later defines or assigns anew (not within if or try), and on which line."""
    imported: dict[str, int] = {}
    for x in ast.walk(tree):
        if isinstance(x, (ast.Import, ast.ImportFrom)):
            for a in x.names:
                name = a.asname or a.name.split(".")[0]
                imported[name] = max(imported.get(name, 0), x.lineno)
    again: dict[str, int] = {}
    for x in tree.body:
        names = []
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names = [x.name]
        elif isinstance(x, ast.Assign):
            names = [t.id for t in x.targets if isinstance(t, ast.Name)]
        elif isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name) and x.value is not None:
            names = [x.target.id]
        for name in names:
            if x.lineno > imported.get(name, x.lineno):
                again.setdefault(name, x.end_lineno or x.lineno)
    return again


def python_uses(tree: ast.Module) -> tuple[list[tuple[str, str, str]], list[str]]:
    """The uses (calls one each, reads of an attribute once), and the sorted names that the code reads."""
    sites: list[tuple[str, str, str]] = []
    reads: dict[tuple[str, str, str], None] = {}
    called: set[tuple[str, str]] = set()
    words: set[str] = set()
    again = _rebound(tree)
    # node, hidden names, whether it is within a function
    stack: list[tuple[ast.AST, frozenset[str], bool]] = [(tree, frozenset(), False)]

    def free(name: ast.Name, hidden: frozenset[str], inside: bool) -> bool:
        if name.id in hidden or not isinstance(name.ctx, ast.Load):
            return False
        return name.id not in again or (not inside and name.lineno <= again[name.id])

    while stack:
        x, hidden, inside = stack.pop()
        if isinstance(x, FUNCTIONS):
            own = hidden | _local_names(x)
            if not isinstance(x, ast.Lambda):
                # names that the function imports or declares global are the module's again
                kept = {a.asname or a.name.split(".")[0] for y in ast.walk(x) if isinstance(y, (ast.Import, ast.ImportFrom)) for a in y.names} | {n for y in x.body if isinstance(y, ast.Global) for n in y.names}
                own -= kept
                stack += [(d, hidden, inside) for d in (*x.decorator_list, *([x.returns] if x.returns else []))]
            stack += [(d, hidden, inside) for d in (*x.args.defaults, *(d for d in x.args.kw_defaults if d), *(a.annotation for a in _arguments(x) if a.annotation))]
            stack += [(y, own, True) for y in ([x.body] if isinstance(x, ast.Lambda) else x.body)]
        elif isinstance(x, ast.ClassDef):
            for base in x.bases:
                if isinstance(base, ast.Name) and free(base, hidden, inside):
                    sites.append((base.id, base.id, "extends"))
                elif isinstance(base, ast.Attribute) and isinstance(base.value, ast.Name) and free(base.value, hidden, inside):
                    sites.append((base.value.id, base.attr, "extends"))
            stack += [(y, hidden, inside) for y in ast.iter_child_nodes(x)]
        elif isinstance(x, COMPREHENSIONS):
            targets = frozenset(n.id for g in x.generators for n in ast.walk(g.target) if isinstance(n, ast.Name))
            stack.append((x.generators[0].iter, hidden, inside))
            parts = [x.key, x.value] if isinstance(x, ast.DictComp) else [x.elt]
            stack += [(y, hidden | targets, inside) for y in (*parts, *(i for g in x.generators for i in g.ifs), *(g.iter for g in x.generators[1:]))]
        else:
            if isinstance(x, ast.Call):
                f = x.func
                if isinstance(f, ast.Name) and free(f, hidden, inside):
                    sites.append((f.id, f.id, "call"))
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and free(f.value, hidden, inside):
                    sites.append((f.value.id, f.attr, "call"))
                    called.add((f.value.id, f.attr))
            elif isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and free(x.value, hidden, inside):
                reads[x.value.id, x.attr, "class_usage" if x.attr[:1].isupper() else "attribute"] = None
            elif isinstance(x, ast.Name) and free(x, hidden, inside):
                words.add(x.id)
            stack += [(y, hidden, inside) for y in ast.iter_child_nodes(x)]
    return sites + [r for r in reads if r[:2] not in called and (r[0], r[1], "extends") not in sites], sorted(words)


# ---- Java

_WORD = r"[A-Za-z_$][\w$]*"
_TYPE_END = r"(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\])*(?:\s*\.\.\.)?"
_NO_TYPE = frozenset("return new throw else package import case instanceof extends implements goto assert yield class interface enum record public private protected static final abstract default do throws".split())
_EVENT = re.compile(
    rf"(?P<open>\{{)|(?P<close>\}})|(?P<left>\()|(?P<right>\))|(?P<semi>;)|(?P<kind>\b(?:class|interface|enum|record)\s+{_WORD})"
    rf"|(?P<make>\bnew\s+(?P<made>{_WORD})(?P<generic>\s*<[^;{{}}()]*>)?\s*(?=\())"
    rf"|(?P<declared>(?<![\w$.@])(?P<type>{_WORD}){_TYPE_END}\s+(?P<name>{_WORD})\s*(?=[=;,):]))"
    rf"|(?P<use>(?<![\w$.])(?P<owner>{_WORD})\s*\.\s*(?P<member>{_WORD})\s*(?P<paren>\()?)"
)


def java_uses(code: str) -> list[tuple[str, str, str]]:
    """Calls and reads of members by the type of what they stand on, and instantiations, of code without comments and strings. Fields are
    known in all of their class, variables and parameters from their place to the end of their block; the innermost one
    counts, and what isn't declared stands for itself (a class)."""
    scopes: list[dict] = [{"class": True, "names": {}}]  # open blocks
    pending: dict[str, str] = {}  # parameters of the block that comes
    of_class, depth = False, 0
    fields: list[dict[str, str]] = []  # per class block, in order of its opening
    found: list[tuple[str, str, str]] = []
    reads: dict[tuple[str, str], None] = {}
    called: set[tuple[str, str]] = set()
    hoisted = _fields(code)
    opened = 0
    for m in _EVENT.finditer(code):
        kind = next(k for k in ("open", "close", "left", "right", "semi", "kind", "make", "declared", "use") if m[k] is not None)
        if kind == "open":
            scopes.append({"class": of_class, "names": dict(hoisted[opened]) if of_class else pending})
            opened += 1
            pending, of_class = {}, False
        elif kind == "close":
            if len(scopes) > 1:
                scopes.pop()
        elif kind == "left":
            depth += 1
        elif kind == "right":
            depth = max(0, depth - 1)
        elif kind == "semi":
            if not depth:
                pending = {}
        elif kind == "kind":
            of_class = True
        elif kind == "make":
            found.append((m["made"], m["made"], "instantiate"))
        elif kind == "declared":
            if m["type"] in _NO_TYPE:
                continue
            if depth:
                pending[m["name"]] = m["type"]
            elif not scopes[-1]["class"]:
                scopes[-1]["names"][m["name"]] = m["type"]
        else:
            owner = m["owner"]
            if owner == "this":
                continue
            names = [pending, *(s["names"] for s in reversed(scopes))]
            owner = next((n[owner] for n in names if owner in n), owner)
            if m["paren"]:
                found.append((owner, m["member"], "call"))
                called.add((owner, m["member"]))
                depth += 1
            else:
                reads[owner, m["member"]] = None
    return found + [(a, b, "class_usage" if b[:1].isupper() else "attribute") for a, b in reads if (a, b) not in called]


def _fields(code: str) -> list[dict[str, str]]:
    """Per block in order of its opening: the variables declared directly in it."""
    blocks: list[dict[str, str]] = []
    stack: list[int] = []
    depth = 0
    for m in _EVENT.finditer(code):
        if m["open"]:
            stack.append(len(blocks))
            blocks.append({})
        elif m["close"]:
            stack and stack.pop()
        elif m["left"] or m["paren"]:
            depth += 1
        elif m["right"]:
            depth = max(0, depth - 1)
        elif m["declared"] and not depth and stack and m["type"] not in _NO_TYPE:
            blocks[stack[-1]].setdefault(m["name"], m["type"])
    return blocks


_PARAMETER = re.compile(rf"(?:@{_WORD}(?:\([^)]*\))?\s+|final\s+)*(?P<type>{_WORD}){_TYPE_END}\s+(?P<name>{_WORD})\s*$")
_INJECTED = re.compile(rf"@(?:Autowired|Resource|Inject|Qualifier)\b\s*(?:\([^)]*\)\s*)?(?:@{_WORD}\s*(?:\([^)]*\)\s*)?)*(?:(?:private|public|protected|static|final)\s+)*(?P<type>{_WORD})(?:<[^;{{}}()]*>)?\s+(?P<name>{_WORD})\s*[;=]")
_CONSTRUCTOR = re.compile(rf"@(?:Autowired|Inject)\b\s*(?:\([^)]*\)\s*)?(?:(?:private|public|protected)\s+)?(?P<class>{_WORD})\s*\((?P<of>[^;{{}}]*?)\)\s*(?:throws\s[^{{;]*)?\{{")


def java_injections(code: str) -> list[tuple[str, str, str]]:
    """(type, name, inject) of annotated fields and of the parameters of annotated constructors."""
    found = [(m["type"], m["name"], "inject") for m in _INJECTED.finditer(code)]
    for m in _CONSTRUCTOR.finditer(code):
        for part in re.split(r",(?![^<]*>)", m["of"]):
            if p := _PARAMETER.match(part.strip()):
                found.append((p["type"], p["name"], "inject"))
    return found
