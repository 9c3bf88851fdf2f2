"""Facts that stay where they are: the sketch before the join of candidates, and plans over bucketed facts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import sketch
from corpusloom.functions.staging import stage_by
from corpusloom.operators import extract

FILES = "repo_id string, path string, content string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def known(spark):
    rows = [
        ("r", "a.py", "from b import f, g\nimport c\nf()\n"), ("r", "b.py", "def f(): pass\ndef g(): pass\n"), ("r", "c.py", "x = 1\n"), ("r", "d.py", "from b import *\nf()\n"),
        ("r", "p/One.java", "package p;\nimport q.Two;\nclass One { void f() { Two.go(); } }\n"), ("r", "elsewhere/Two.java", "package elsewhere;\npublic class Two { }\n"),
        ("s", "a.py", "from b import f\nf()\n"), ("s", "empty.py", None),
    ]
    return stage_by(extract.facts(spark.createDataFrame(rows, FILES)), "repo_id", "path")


def test_sketch_keeps_all_keys_and_few_others(spark):
    keys = spark.range(0, 4000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("r").alias("r"))
    rows = spark.range(0, 40000).select(F.concat(F.lit("k"), "id").alias("name"), F.lit("r").alias("r"))
    kept = {r["name"] for r in sketch.may_match(rows, ["r", "name"], keys, ["r", "k"]).collect()}
    assert {f"k{i}" for i in range(4000)} <= kept and len(kept) < 4000 + 36000 // 8
    other = rows.withColumn("r", F.lit("q"))
    assert other.count() // 8 > sketch.may_match(other, ["r", "name"], keys, ["r", "k"]).count()
    assert sketch.may_match(rows, ["r", "name"], keys.limit(0), ["r", "k"]).count() == 0


def test_sketch_is_bounded():
    assert sketch.bits_for(0) == sketch.ROW_BITS
    for n in (1, 1000, 10**6, 10**8):
        bits = sketch.bits_for(n)
        assert bits & (bits - 1) == 0 and sketch.LEAST * n <= bits <= sketch.MOST_BITS
    assert sketch.bits_for(sketch.MOST_BITS) == 0


def test_without_a_sketch_rows_stay(spark, monkeypatch):
    monkeypatch.setattr(sketch, "MOST_BITS", 1)
    rows = spark.range(10).select(F.col("id").alias("a"))
    assert sketch.may_match(rows, ["a"], spark.range(3), ["id"]).count() == 10


def test_rows_of_bucketed_facts(known):
    found = extract.targets(known)
    assert {(r["repo_id"], r["path"], r["spec"], r["dst"]) for r in found.collect()} == {
        ("r", "a.py", "b", "b.py"), ("r", "a.py", "c", "c.py"), ("r", "d.py", "b", "b.py"), ("r", "p/One.java", "q.Two", "elsewhere/Two.java"),
    }
    bound = extract.symbol_bindings(known, found)
    refs = {(r["path"], r["symbol"], r["dst"]) for r in extract.cross_refs(bound, known).collect()}
    assert refs == {("a.py", "f", "b.py"), ("d.py", "*", "b.py"), ("p/One.java", "Two", "elsewhere/Two.java")}
    calls = {(r["src"], r["dst"], r["symbol"], r["member"], r["n_sites"]) for r in extract.call_targets(bound, known).collect()}
    assert {("a.py", "b.py", "f", "f", 1), ("p/One.java", "elsewhere/Two.java", "Two", "go", 1)} <= calls
    unused = extract.unused_imports(known, extract.resolve_imports(known, found=found), bound, extract.cross_refs(bound, known))
    assert {(r["src"], r["dst"]) for r in unused.collect()} == {("a.py", "c.py")}


def test_bindings_of_files_without_facts(spark, known):
    bound = spark.createDataFrame([("r", "gone.py", "*", "b.py"), ("r", "gone.py", "f", "b.py"), ("r", "a.py", "f", "b.py"), ("r", "a.py", "f", "b.py")], "repo_id string, path string, symbol string, dst string")
    assert sorted((r["path"], r["symbol"]) for r in extract.cross_refs(bound, known).collect()) == [("a.py", "f"), ("gone.py", "*")]
    assert {(r["src"], r["n_sites"]) for r in extract.call_targets(bound, known).collect()} == {("a.py", 1)}
    assert extract.cross_refs(bound.limit(0), known).count() == extract.call_targets(bound.limit(0), known).count() == 0


def test_no_exchange_of_words_or_sites(spark, known):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bound = extract.symbol_bindings(known)
        for rows, column in ((extract.cross_refs(bound, known), "words"), (extract.call_targets(bound, known), "sites")):
            text = plan_of(rows)
            # the facts are scanned bucketed, and no exchange stands above the scan, up to the root
            lines = [(len(line) - len(line.lstrip(" :+-*(0123456789)")), line) for line in text.splitlines()]
            at = next(i for i, (_, line) in enumerate(lines) if "FileScan" in line and f"{column}#" in line)
            above, depth = [], lines[at][0]
            for indent, line in reversed(lines[:at]):
                if indent < depth:
                    above.append(line)
                    depth = indent
            assert any("Join" in line for line in above) and not any("Exchange" in line for line in above), text
            assert "Bucketed: true" in lines[at][1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_candidates_are_sketched_before_the_exchange(spark, known):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(extract.resolved_specs(known)).splitlines()
        semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
        assert "BroadcastHashJoin" in lines[semi] and any("Exchange hashpartitioning(repo_id" in line for line in lines[:semi])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
