"""The literal index tries every pattern that matches, and few others."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import endpoints, literals, security
from corpusloom.operators.catalog import ENDPOINT_RULES, SECURITY_RULES

PATTERNS = tuple(r[4] for r in SECURITY_RULES) + tuple(r[2] for r in ENDPOINT_RULES)

CASES = [
    (r"(?i)(?:password|pwd)\s*=", [{"password", "pwd"}]),
    (r"abc?d+efg", [{"efg"}]),
    (r"\bfoo[_-]?bar\(", [{"foobar(", "foo_bar(", "foo-bar("}]),
    (r"(?:one|t\w)x*", []),
    (r"(?:alpha\d|beta\d)z", [{"alpha", "beta"}]),
    (r"x(?=never)yz1", [{"xyz1"}]),
    (r"(?!never)abc", [{"abc"}]),
    (r"(?:abc)*def", [{"def"}]),
    (r"(?:abc\s)+", [{"abc"}]),
    (r"[a-z]{3}", []),
    (r"é+abc", [{"abc"}]),
    (r"ab", []),
]


@pytest.mark.parametrize("pattern,want", CASES)
def test_clauses(pattern, want):
    assert [set(c) for c in literals.clauses(pattern)] == want


#: Pieces of what the catalogues look for, so that many texts match something.
PIECES = [
    "password", "PASSWORD", "api_key", "ApiKey", " = ", ": ", "'", '"', "abcd1234efgh5678", "sk-", "A" * 24, "ghp_", "jdbc://", "u:p@h", "eyJ", ".", "execute", "(", ")", "f'", "%s", "createStatement",
    "mysql_query", "$x", ".innerHTML", "=", "dangerouslySetInnerHTML", "echo $", "_GET[", "os.system", "yaml.load", "pickle.load", "s", "ObjectInputStream", "unserialize", "DEBUG", "True", "ini_set", "hashlib.", "md5", "\n",
    "MessageDigest", " x ", "DES", "3DES", "@GetMapping", "@RequestMapping", "RequestMethod.GET", "@POST", "@app.route", "@r.get", "path", "url", ", v", "router.post", "app.use", "@Get", "Route::get", "#[Route", ".GET", "get ", "[HttpGet", "]", "/a",
    "K", "İ", "é",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_every_pattern_that_matches_is_tried(text):
    tried = set(literals.literals(PATTERNS).wanted(text))
    assert {i for i, p in enumerate(PATTERNS) if re.search(p, text, re.ASCII)} <= tried


def test_texts_without_literals_try_nothing():
    index = literals.literals(PATTERNS)
    assert index.wanted("") == index.wanted("x = 1\n" * 1000) == index.free == []
    one = index.wanted("password = 'hunter22'")
    assert one and all("pass" in PATTERNS[i] for i in one)
    assert literals.Literals((r"\d+", "abc")).wanted("") == [0] and literals.Literals(()).wanted("abc") == []


def test_patterns_that_run(spark, monkeypatch):
    """Rows are those of trying every pattern, and of the patterns most don't run."""
    rows = [
        ("r", "a.py", "password = 'hunter22'\nDEBUG = True\n"), ("r", "b.py", "x = 1\n" * 50), ("r", "c.php", "system('x'); echo $_GET['a'];"), ("r", "d.py", "@app.route('/x', methods=['POST'])\ndef f(): pass\n"),
        ("r", "e.java", "@GetMapping(\"/y\")\npublic A y() { }\nMessageDigest.getInstance(\"MD5\")"), ("r", "f.py", None), ("r", "g.txt", "ghp_" + "a" * 30),
    ]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    for operator in (security.security_scan, endpoints.endpoints):
        module = security if operator is security.security_scan else endpoints
        got = sorted(map(str, operator(files).collect()))
        with monkeypatch.context() as m:
            m.setattr(module, "literals", lambda patterns: type("All", (), {"wanted": lambda self, text: list(range(len(patterns)))})())
            assert sorted(map(str, operator(files).collect())) == got and got
    index = literals.literals(PATTERNS)
    assert sum(len(index.wanted(content or "")) for _, _, content in rows) < len(PATTERNS)
