"""Comments and strings of source texts, by a lexer that is driven by a table of languages and keeps offsets.

``segments`` reads a text once, from left to right: a pattern of the language's openers finds the next comment, string, template or
heredoc, and each kind knows where it ends. ``bare`` blanks comments, ``code_only`` also what stands in strings, both with spaces (line
ends stay), so offsets and lines are those of the text.

Defined cases: what isn't closed goes to the end of the text (a string that may not span lines: to the end of its line); an empty text
has no segments; a language without an entry is read as the C family.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

#: Strings: opener, closer, whether a backslash escapes, whether lines may end within.
DOUBLE, SINGLE = ('"', '"', True, False), ("'", "'", True, False)
TRIPLE = ('"""', '"""', True, True)
C_BLOCK = ("/*", "*/", False)


@dataclass(frozen=True)
class Language:
    """line: openers of comments to the end of the line; blocks: opener, closer, nested; at_line: the same, but only at the beginning of a
    line (without nesting); strings: see above."""

    line: tuple[str, ...] = ("//",)
    blocks: tuple[tuple[str, str, bool], ...] = (C_BLOCK,)
    at_line: tuple[tuple[str, str], ...] = ()
    strings: tuple[tuple[str, str, bool, bool], ...] = (DOUBLE, SINGLE)
    template: bool = False  # `...${code}...`
    slashes: bool = False  # /regular expressions/
    heredoc: str = ""  # a pattern whose group "id" names the line that ends it
    raw: str = ""  # a pattern of a string whose group "end" (with doubled names of it) tells its closer
    quote_ticks: bool = False  # ' begins a character only if one is closed behind it
    hash_not: str = ""  # what may not follow a # comment


_HASH = Language(line=("#",), blocks=())
_NESTED = ("/*", "*/", True)
LANGUAGES = {
    "python": Language(line=("#",), blocks=(), strings=(TRIPLE, ("'''", "'''", True, True), DOUBLE, SINGLE)),
    "ruby": Language(line=("#",), blocks=(), at_line=(("=begin", "=end"),), strings=(("\"", "\"", True, True), ("'", "'", True, True)), heredoc=r"<<[~-]?(?P<q>['\"]?)(?P<id>[A-Z_]\w*)(?P=q)"),
    "shell": Language(line=("#",), blocks=(), strings=(("\"", "\"", True, True), ("'", "'", False, True)), heredoc=r"<<-?\s*(?P<q>['\"]?)(?P<id>[A-Za-z_]\w*)(?P=q)", hash_not=r"(?<![\w$({#])#"),
    "perl": Language(line=("#",), blocks=(), at_line=(("=pod", "=cut"), ("=head", "=cut")), heredoc=r"<<~?(?P<q>['\"]?)(?P<id>[A-Z_]\w*)(?P=q)", hash_not=r"(?<![$\\])#"),
    "r": _HASH, "elixir": Language(line=("#",), blocks=(), strings=(TRIPLE, DOUBLE, SINGLE)), "nim": Language(line=("#",), blocks=(("#[", "]#", True),), strings=(TRIPLE, DOUBLE, SINGLE)),
    "lua": Language(line=("--",), blocks=(), raw=r"(?P<comment>--)?\[(?P<end>=*)\[", strings=(DOUBLE, SINGLE)), "haskell": Language(line=("--",), blocks=(("{-", "-}", True),), strings=(DOUBLE,)),
    "erlang": Language(line=("%",), blocks=(), strings=(DOUBLE,)), "clojure": Language(line=(";",), blocks=(), strings=(("\"", "\"", True, True),)),
    "php": Language(line=("//", "#"), strings=(("\"", "\"", True, True), ("'", "'", True, True)), heredoc=r"<<<\s*(?P<q>['\"]?)(?P<id>[A-Za-z_]\w*)(?P=q)", hash_not=r"#(?!\[)"),
    "javascript": Language(template=True, slashes=True), "typescript": Language(template=True, slashes=True),
    "java": Language(strings=(TRIPLE, DOUBLE, SINGLE)), "kotlin": Language(blocks=(_NESTED,), strings=(('"""', '"""', False, True), DOUBLE, SINGLE)),
    "scala": Language(blocks=(_NESTED,), strings=(('"""', '"""', False, True), DOUBLE), quote_ticks=True), "swift": Language(blocks=(_NESTED,), strings=(TRIPLE, DOUBLE)),
    "dart": Language(blocks=(_NESTED,), strings=(TRIPLE, ("'''", "'''", True, True), DOUBLE, SINGLE)), "groovy": Language(strings=(TRIPLE, ("'''", "'''", True, True), DOUBLE, SINGLE)),
    "go": Language(strings=(("`", "`", False, True), DOUBLE, SINGLE)), "rust": Language(blocks=(_NESTED,), strings=(("\"", "\"", True, True),), raw=r"\bb?r(?P<end>#*)\"", quote_ticks=True),
    "csharp": Language(strings=(('"""', '"""', False, True), DOUBLE, SINGLE), raw=r"(?:\$@|@\$?)(?P<end>)\""), "cpp": Language(raw=r"\bR\"(?P<end>[^\s()\\]{0,16})\(", quote_ticks=True),
    "zig": Language(blocks=(), strings=(DOUBLE, SINGLE)),
}
LANGUAGES["vue"] = LANGUAGES["svelte"] = LANGUAGES["javascript"]
OTHER = Language()

#: Behind these a slash divides; behind anything else, and behind these words, it begins a regular expression.
_DIVIDES = re.compile(r"[\w$)\]}]")
_WORDS_BEFORE = re.compile(r"\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|yield|await)$")
_SLASHES = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TICK = re.compile(r"'(?:\\(?:u\{[^}\n]*\}|x[0-9A-Fa-f]+|[^\n])|[^'\\\n])'")
_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")


@lru_cache(maxsize=64)
def _openers(of: Language) -> re.Pattern:
    ways = []
    if of.raw:
        ways.append(f"(?P<raw>{of.raw})")
    if of.heredoc:
        ways.append(f"(?P<heredoc>{of.heredoc})")
    ways += [f"(?P<at{i}>^{re.escape(a)}\\b)" for i, (a, _) in enumerate(of.at_line)]
    ways += [f"(?P<block{i}>{re.escape(a)})" for i, (a, _, _) in enumerate(of.blocks)]
    ways += [f"(?P<line{i}>{of.hash_not if a == '#' and of.hash_not else re.escape(a)})" for i, a in enumerate(of.line)]
    ways += [f"(?P<string{i}>{re.escape(a)})" for i, (a, *_) in enumerate(of.strings)]
    if of.template:
        ways.append("(?P<template>`)")
    if of.slashes:
        ways.append("(?P<slash>/)")
    if of.quote_ticks:
        ways.append("(?P<tick>')")
    return re.compile("|".join(ways) + "|(?P<open>\\{)|(?P<close>\\})", re.MULTILINE)


@lru_cache(maxsize=64)
def _string_end(close: str, escapes: bool, lines: bool) -> re.Pattern:
    return re.compile(("\\\\[\\s\\S]|" if escapes else "") + re.escape(close) + ("" if lines else "|(?=\n)"))


def _end_of_string(text: str, at: int, close: str, escapes: bool, lines: bool) -> int:
    pattern = _string_end(close, escapes, lines)
    while m := pattern.search(text, at):
        if m[0].startswith("\\") and m[0] != close:
            at = m.end()
            continue
        return m.end()
    return len(text)


def _end_of_block(text: str, at: int, first: str, close: str, nested: bool) -> int:
    if not nested:
        end = text.find(close, at)
        return end + len(close) if end >= 0 else len(text)
    depth, pattern = 1, re.compile(f"{re.escape(first)}|{re.escape(close)}")
    for m in pattern.finditer(text, at):
        depth += 1 if m[0] == first else -1
        if not depth:
            return m.end()
    return len(text)


@dataclass
class _Scan:
    text: str
    of: Language
    found: list[tuple[str, int, int]] = field(default_factory=list)
    waiting: list[str] = field(default_factory=list)  # heredocs announced on this line
    depths: list[int] = field(default_factory=list)  # of each open template: braces open within its code


def segments(text: str, lang: str) -> list[tuple[str, int, int]]:
    """("comment" or "string", start, end) in order; of a string what stands between its marks."""
    of = LANGUAGES.get(lang, OTHER)
    pattern, s = _openers(of), _Scan(text, of)
    at, n = 0, len(text)
    while at < n:
        m = pattern.search(text, at)
        if s.waiting and (not m or (line := text.find("\n", at, m.start())) >= 0):
            line = text.find("\n", at)
            at = _heredocs(s, line + 1) if line >= 0 else n
            continue
        if not m:
            break
        at = _step(s, m)
    return s.found


def _heredocs(s: _Scan, at: int) -> int:
    for name in s.waiting:
        m = re.compile(rf"^[ \t]*{name}\b", re.MULTILINE).search(s.text, at)
        end = m.start() if m else len(s.text)
        s.found.append(("string", at, end))
        at = m.end() if m else len(s.text)
    s.waiting.clear()
    return at


def _template(s: _Scan, at: int) -> int:
    """From within a template to its end or to code in it."""
    start = at
    while m := _TEMPLATE.search(s.text, at):
        at = m.end()
        if m[0] == "`":
            s.found.append(("string", start, m.start()))
            return at
        if m[0] == "${":
            s.found.append(("string", start, m.start()))
            s.depths.append(0)
            return at
    s.found.append(("string", start, len(s.text)))
    return len(s.text)


def _step(s: _Scan, m: re.Match) -> int:
    """Read what begins at a match; where to go on."""
    text, of, kind, start = s.text, s.of, m.lastgroup or "", m.start()
    groups = m.groupdict()
    if groups.get("raw") is not None:
        comment, mark = groups.get("comment"), groups["end"]
        if groups["raw"].endswith("["):
            close = f"]{mark}]"
        elif groups["raw"].endswith("("):
            close = f'){mark}"'
        else:
            close = f'"{mark}'
        end = text.find(close, m.end())
        while close == '"' and "@" in groups["raw"] and end >= 0 and text.startswith('""', end):  # a doubled mark stands for one
            end = text.find('"', end + 2)
        stop, past = (end, end + len(close)) if end >= 0 else (len(text), len(text))
        s.found.append(("comment", start, past) if comment else ("string", m.end(), stop))
        return past
    if groups.get("heredoc") is not None:
        s.waiting.append(groups["id"])
        return m.end()
    if kind in ("open", "close"):
        if s.depths:
            if kind == "open":
                s.depths[-1] += 1
            elif s.depths[-1]:
                s.depths[-1] -= 1
            else:
                s.depths.pop()
                return _template(s, m.end())
        return m.end()
    if kind == "template":
        return _template(s, m.end())
    if kind == "slash":
        before = text[max(0, start - 12) : start].rstrip()
        if before and _DIVIDES.match(before[-1]) and not _WORDS_BEFORE.search(before):
            return m.end()
        r = _SLASHES.match(text, start)
        if not r:
            return m.end()
        s.found.append(("string", start + 1, text.rindex("/", start, r.end())))
        return r.end()
    if kind == "tick":
        r = _TICK.match(text, start)
        if r:
            s.found.append(("string", start + 1, r.end() - 1))
        return r.end() if r else m.end()
    number = int(re.search(r"\d+$", kind)[0])
    if kind.startswith("line"):
        end = text.find("\n", start)
        end = end if end >= 0 else len(text)
        s.found.append(("comment", start, end))
        return end
    if kind.startswith("block") or kind.startswith("at"):
        first, close, nested = of.blocks[number] if kind.startswith("block") else (*of.at_line[number], False)
        end = _end_of_block(text, m.end(), first, close, nested)
        if kind.startswith("at"):
            line = text.find("\n", end)
            end = line if line >= 0 else len(text)
        s.found.append(("comment", start, end))
        return end
    _, close, escapes, lines = of.strings[number]
    end = _end_of_string(text, m.end(), close, escapes, lines)
    closed = text.startswith(close, end - len(close)) and end - len(close) >= m.end()
    s.found.append(("string", m.end(), end - len(close) if closed else end))
    return end


_INK = re.compile(r"[^\n]")
_TAGS = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<script\b[^>]*>([\s\S]*?)(?:</script>|\Z)", re.IGNORECASE)


def _blank(text: str, found: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in found:
        out += [text[at:start], _INK.sub(" ", text[start:end])]
        at = end
    return "".join([*out, text[at:]])


def _found(text: str, lang: str) -> list[tuple[str, int, int]]:
    if lang not in ("html", "vue", "svelte"):
        return segments(text, lang)
    found = []  # marks of comments, and the scripts within
    for m in _TAGS.finditer(text):
        if m[1] is None:
            found.append(("comment", m.start(), m.end()))
        else:
            found += [(kind, start + m.start(1), end + m.start(1)) for kind, start, end in segments(m[1], "javascript")]
    return found


def bare_and_code(text: str, lang: str) -> tuple[str, str]:
    """``bare`` and ``code_only``, reading the text once."""
    found = _found(text, lang)
    return _blank(text, [(start, end) for kind, start, end in found if kind == "comment"]), _blank(text, [(start, end) for _, start, end in found])


def bare(text: str, lang: str) -> str:
    """The text with its comments blanked."""
    return _blank(text, [(start, end) for kind, start, end in _found(text, lang) if kind == "comment"])


def code_only(text: str, lang: str) -> str:
    """The text with its comments and what stands in its strings blanked; code within templates stays."""
    return _blank(text, [(start, end) for _, start, end in _found(text, lang)])
