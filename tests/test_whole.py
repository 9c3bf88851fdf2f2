"""Graph passes within a task: the same results as the rounds that large repositories take, in few tables."""

from __future__ import annotations

import random

import pytest

from corpusloom.operators import graph, rules, whole
from tests.test_operators import count_tables, graph_of, shortest_cycles


def random_pairs(seed, nodes=16, edges=30):
    r = random.Random(seed)
    return sorted({(f"f{r.randrange(nodes):02d}", f"f{r.randrange(nodes):02d}") for _ in range(edges)})


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.fixture(params=["one task", "many tasks", "rounds"])
def way(request, monkeypatch):
    """How repositories are searched: whole, in parts of their components, or in rounds over tables."""
    if request.param == "many tasks":
        monkeypatch.setattr(whole, "CHUNK", 5)
    if request.param == "rounds":
        monkeypatch.setattr(whole, "MOST_EDGES", 4)
    return request.param


def test_detect_cycles_in_few_tables(spark, monkeypatch):
    pairs = random_pairs(1)
    _, edges = graph_of(spark, *pairs)
    made = count_tables(monkeypatch)
    assert {x["cycle"] for x in graph.detect_cycles(edges).collect()} == shortest_cycles(pairs)
    assert len(made) <= 2


def test_detect_cycles_each_way(spark, way):
    pairs = random_pairs(2)
    _, edges = graph_of(spark, *pairs)
    two = edges.unionByName(edges.selectExpr("'q' AS repo_id", "src", "dst")).unionByName(spark.createDataFrame([("q", "x > y", "z"), ("q", "z", "x > y"), (None, "a", "b"), (None, "b", "a")], edges.schema))
    found = rows(graph.detect_cycles(two))
    want = shortest_cycles(pairs)
    assert len(want) > 5
    assert found == sorted([(c, repo, c.count(" > ") + 1) for c in want for repo in ("q", "r")] + [("x > y > z", "q", 2)], key=str)


@pytest.mark.parametrize("name", ["graph_stats", "graph_export", "node_records"])
def test_edges_are_derived_once_a_query(spark, monkeypatch, name):
    import __spark_entry__
    from corpusloom.jobs import synth

    made, real = [], synth.key_edges
    monkeypatch.setattr(synth, "key_edges", lambda *a: made.append(1) or real(*a))
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_comments_and_strings_are_read_once(monkeypatch):
    from corpusloom.operators import lexing

    texts = [("java", 'a("x // no"); // b("y")\n/* c */ d();'), ("javascript", "f(`a ${g(1)} b`); // c"), ("html", "<!-- a --><script>f('x') // c</script>"), ("go", "")]
    want = [(lexing.bare(text, lang), lexing.code_only(text, lang)) for lang, text in texts]
    read, real = [], lexing._found
    monkeypatch.setattr(lexing, "_found", lambda *a: read.append(1) or real(*a))
    assert [lexing.bare_and_code(text, lang) for lang, text in texts] == want and len(read) == len(texts)


def test_long_cycles_in_few_tables(spark, monkeypatch):
    pairs = random_pairs(3)
    nodes, edges = graph_of(spark, *pairs)
    want = {c for c in shortest_cycles(pairs) if c.count(" > ") > 1}
    made = count_tables(monkeypatch)
    assert {r["related_file"] for r in rules.max_cycle_size(nodes, edges, {"type": "max_cycle_size", "max": 2}).collect()} == want
    assert len(made) <= 5


def test_long_cycles_over_short_ones_each_way(spark, way):
    both = lambda *names: [(a, b) for a in names for b in names if a != b]
    _, edges = graph_of(spark, *both("a > b", "b", "c"), *both("x", "y"), ("p", "q"), ("q", "r"), ("r", "p"))
    assert {r["cycle"] for r in graph.long_cycles(edges, 2).collect()} == {"a > b > b > c", "p > q > r"}


def test_rule_summary_in_few_tables(spark, monkeypatch):
    nodes, edges = graph_of(spark, *random_pairs(3))
    made = count_tables(monkeypatch)
    assert rules.rule_summary(nodes, edges).first()["checked"] == 6 and len(made) <= 6


def test_cycle_members_each_way(spark, way, monkeypatch):
    _, edges = graph_of(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("t", "a"), ("f", "f"), ("a", "b"), ("z", "a"))
    edges = edges.unionByName(spark.createDataFrame([("s", "ü", "a"), ("s", "a", "ü"), (None, "a", "b"), (None, "b", "a"), ("s", None, "a")], edges.schema))
    made = count_tables(monkeypatch)
    got = {tuple(r) for r in graph.cycle_members(edges).select("repo_id", "path", "component", "size").collect()}
    assert got == {("r", "a", "a", 3), ("r", "b", "a", 3), ("r", "c", "a", 3), ("r", "d", "d", 2), ("r", "e", "d", 2), ("s", "a", "a", 2), ("s", "ü", "a", 2)}
    assert way == "rounds" or len(made) == 1


def test_short_cycles_each_way(spark, way, monkeypatch):
    pairs = random_pairs(5, 9, 26)
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    ways, want = [(a,) for a in after], set()
    while ways:
        ways = [(*w, x) for w in ways for x in after.get(w[-1], ()) if x > w[0] and x not in w]
        want |= {" > ".join(w) for w in ways if w[0] in after.get(w[-1], ())}
    _, edges = graph_of(spark, *pairs)
    for most in (2, 5) if way != "rounds" else (4,):
        made = count_tables(monkeypatch)
        got = graph.short_cycles(edges, most).collect()
        assert sorted((r["cycle"], r["size"], r["bound"]) for r in got) == sorted((c, c.count(" > ") + 1, most) for c in want if c.count(" > ") < most)
        assert way == "rounds" or len(made) == 2


def test_layers_in_one_table_each_way(spark, way, monkeypatch):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(6)]
    nodes, edges = graph_of(spark, *chain, ("n00", "n04"), ("on", "l1"), ("l1", "l2"), ("l2", "l1"), ("self", "self"), alone=["alone"])
    edges = edges.unionByName(spark.createDataFrame([("r", "alone", "unknown"), ("r", "nobody", "n00")], edges.schema))
    nodes = nodes.unionByName(spark.createDataFrame([("r", "n06"), ("s", "n00"), (None, "a"), ("r", None)], nodes.schema))
    made = count_tables(monkeypatch)
    want = [("r", f"n{i:02d}", 6 - i) for i in range(7)] + [("r", x, None) for x in ("on", "l1", "l2", "alone", None)] + [("r", "self", 0), ("r", "n06", 0), ("s", "n00", 0), (None, "a", None)]
    got = graph.topological_layers(nodes, edges).select("repo_id", "path", "depth").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert way == "rounds" or len(made) == 1
