"""Import statements of languages without a reader of their own, by a table of their grammar.

A statement begins with a word, may have modifiers, and names what it imports: a quoted string (or one in angle brackets) or parts of a
name with a joint between them, perhaps with a list in braces at the end, an alias, or more of the same behind commas.
``statements`` cuts a text without comments into words, strings and marks, and reads the statements that the table knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

TOKEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|<[^<>\s\"']+>|[A-Za-z_$][\w$]*[?!]?|::|=>|\n|[^\s\w]|\d\w*")
NAME = re.compile(r"[A-Za-z_$][\w$]*$")


@dataclass(frozen=True)
class Statement:
    """kind; words that begin it; joint between the parts of a name (none: a string is imported); skip: modifiers; alias: the word before a local
    name; begins: it stands first on its line or behind ; { or }; end: what must follow; heads: what a name must begin with; lists: more
    may follow behind commas; before: the mark before its word."""

    kind: str
    words: tuple[str, ...]
    joint: str = ""
    skip: tuple[str, ...] = ()
    alias: str = "as"
    begins: bool = True
    end: str = ""
    heads: tuple[str, ...] = ()
    lists: bool = False
    before: str = ""


_INCLUDE = Statement("include", ("include",), before="#")
_IMPORT = Statement("import", ("import",), ".", skip=("static",))
GRAMMAR = {
    "rust": (Statement("use", ("use",), "::", begins=False, end=";", heads=("crate", "self", "super")), Statement("mod", ("mod",), "::", begins=False, end=";")),
    "c": (_INCLUDE,), "cpp": (_INCLUDE,), "objc": (_INCLUDE, Statement("include", ("import",), before="#")),
    "csharp": (Statement("using", ("using",), ".", skip=("static", "global"), end=";", begins=False),),
    "ruby": (Statement("require", ("require", "require_relative")), Statement("load", ("load",))),
    "kotlin": (_IMPORT,), "groovy": (_IMPORT,), "scala": (_IMPORT,), "swift": (Statement("import", ("import",), ".", skip=("class", "struct", "enum", "protocol", "func", "var", "typealias")),),
    "lua": (Statement("require", ("require",), begins=False), Statement("dofile", ("dofile",), begins=False)),
    "dart": (Statement("import", ("import",)), Statement("part", ("part",), skip=("of",))),
    "perl": (Statement("use", ("use",), "::"), Statement("require", ("require",), "::")),
    "elixir": (Statement("import", ("import", "alias", "require"), "."),),
    "haskell": (Statement("import", ("import",), ".", skip=("qualified", "safe")),),
    "zig": (Statement("import", ("import",), begins=False, before="@"),),
    "r": (Statement("source", ("source",), begins=False), Statement("library", ("library", "require"), ".", begins=False)),
    "nim": (Statement("import", ("import", "from"), "/", lists=True), Statement("include", ("include",), "/", lists=True)),
    "erlang": (Statement("include", ("include", "include_lib"), begins=False, before="-"),),
    "solidity": (Statement("import", ("import",)),),
}


def _listed(tokens: list[str], at: int, close: str) -> tuple[list[str], int]:
    """Local names of a list from behind its opener (``a, b as c, d => e``), and where it ends."""
    names, last = [], ""
    while at < len(tokens) and tokens[at] != close:
        if tokens[at] == ",":
            names.append(last)
            last = ""
        elif NAME.match(tokens[at]) or tokens[at] == "*":
            last = tokens[at]
        at += 1
    return [n for n in [*names, last] if n], at + 1


def _stem(spec: str, of_path: bool) -> str:
    """The name by which a spec is known if none is given: the last part of its path without an ending, or of its name."""
    last = spec.rpartition("/")[2]
    return (last.rpartition(".")[0] or last) if of_path else re.split(r"::|\.", last)[-1]


def statements(text: str, lang: str) -> Iterator[tuple[str, str, list[str]]]:
    """spec, kind and local names of every import."""
    if lang == "shell":
        yield from _shell(text)
        return
    if lang == "clojure":
        yield from _clojure(text)
        return
    known = GRAMMAR.get(lang, ())
    by_word = {w: s for s in known for w in s.words}
    if not by_word:
        return
    tokens = TOKEN.findall(text)
    for i, word in enumerate(tokens):
        s = by_word.get(word)
        if s is None or (s.before and (not i or tokens[i - 1] != s.before)):
            continue
        if s.begins and not s.before and i and tokens[i - 1] not in ("\n", ";", "{", "}"):
            continue
        yield from _read(tokens, i, s, lang)


def _read(tokens: list[str], i: int, s: Statement, lang: str) -> Iterator[tuple[str, str, list[str]]]:
    at, local, names = i + 1, "", None
    first = i - len(s.before)
    if not s.begins and first >= 2 and tokens[first - 1] == "=" and NAME.match(tokens[first - 2]):
        local = tokens[first - 2]  # local x = require "y"
    get = lambda k: tokens[k] if k < len(tokens) else ""
    while True:
        while get(at) in (*s.skip, "("):
            at += 1
        if not s.joint:
            if get(at) == "{":  # import {a, b} from "x"
                names, at = _listed(tokens, at + 1, "}")
                at += get(at) == "from"
            elif get(at) == "*" and get(at + 1) == s.alias:
                names, at = [get(at + 2)], at + 3 + (get(at + 3) == "from")
            if get(at)[:1] not in ("'", '"', "<") or len(get(at)) < 3:
                return
            spec, at = get(at)[1:-1], at + 1
        else:
            if get(at + 1) == "=" and s.end and NAME.match(get(at)):  # using x = a.b;
                local, at = get(at), at + 2
            if not NAME.match(get(at)) or (s.heads and get(at) not in s.heads):
                return
            spec, at = get(at), at + 1
            while get(at) == s.joint:
                if get(at + 1) == "{":
                    names, at = _listed(tokens, at + 2, "}")
                    break
                if get(at + 1) in ("*", "_"):
                    names, at = ["*"], at + 2
                    spec += "" if s.joint == "::" else s.joint + "*"
                    break
                if not NAME.match(get(at + 1)):
                    break
                spec, at = spec + s.joint + get(at + 1), at + 2
        while get(at) == ")":
            at += 1
        if get(at) == "qualified":
            at += 1
        if get(at) == "," and get(at + 1) == s.alias and get(at + 2) == ":":  # alias A.B, as: C
            local, at = get(at + 3), at + 4
        elif get(at) == s.alias and NAME.match(get(at + 1)):
            local, at = get(at + 1), at + 2
        if s.end and get(at) != s.end:
            return
        yield (f"self::{spec}" if s.kind == "mod" else spec), s.kind, names or [local or _stem(spec, not s.joint and (lang, s.kind) != ("lua", "require"))]
        if not s.lists or get(at) != ",":
            return
        at, local, names = at + 1, "", None
        while get(at) == "\n":
            at += 1


def _shell(text: str) -> Iterator[tuple[str, str, list[str]]]:
    for line in text.split("\n"):
        words = line.split(";")[0].split()
        if len(words) > 1 and words[0] in ("source", ".") and (spec := words[1].strip("'\"")):
            yield spec, "source", [_stem(spec, True)]


def _clojure(text: str) -> Iterator[tuple[str, str, list[str]]]:
    """Libraries in vectors that say how they are called: [a.b :as c], [a.b :refer [d e]]."""
    for part in text.split("[")[1:]:
        words = part.replace("]", " ] ").split()
        if len(words) > 1 and words[1] in (":as", ":refer") and re.match(r"[A-Za-z][\w.*+!?-]*$", words[0]):
            yield words[0], "require", [words[2] if words[1] == ":as" and len(words) > 2 and words[2] != "]" else _stem(words[0], False)]
