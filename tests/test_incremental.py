from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, extract, incremental
from corpusloom.sources import readers
from corpusloom.sources.state import State

FILES = "repo_id string, path string, content string"
BEFORE = {
    "a.py": "import b\nimport pkg.c\n", "b.py": "import os\n", "pkg/c.py": "from . import d\n", "x.js": "import { y } from './y';\n", "y.js": "export const y = 1;\n",
    "App.java": "package app;\nimport lib.Helper;\nimport lib.Late;\nclass App {}\n", "deep/Helper.java": "package other;\nclass Helper {}\n", "same.go": "package main\n",
}
#: What becomes of the files, and whose imports must be resolved again.
CHANGES = [
    ({}, set()),
    ({"b.py": "import a\n"}, {"b.py"}),
    ({"pkg/d.py": "z = 1\n"}, {"pkg/d.py", "pkg/c.py"}),
    ({"y.js": None, "y/index.js": "export const y = 2;\n"}, {"y/index.js", "x.js"}),
    ({"any/Late.java": "package q;\nclass Late {}\n"}, {"any/Late.java", "App.java"}),
    ({"deep/Helper.java": None}, {"App.java"}),
    ({"pkg/b.py": "", "b.py": None}, {"pkg/b.py", "a.py"}),
    (dict.fromkeys(BEFORE), set()),
]


def frame(spark, files):
    return spark.createDataFrame([(r, p, c) for r in ("r1", "r2") for p, c in files.items()], FILES)


def edges(state):
    return sorted(map(tuple, state.read("edges").select("repo_id", "src", "dst").collect()))


def test_refresh_equals_a_full_run(spark, tmp_path, monkeypatch):
    real, seen = extract.facts, []
    monkeypatch.setattr(extract, "facts", lambda files: seen.append(sorted(r["path"] for r in files.select("repo_id", "path").collect())) or real(files))
    state = State(spark, f"file://{tmp_path}/state")
    assert state.present() is None and state.read("facts") is None
    now = dict(BEFORE)
    incremental.refresh(frame(spark, now), state)
    assert ("r1", "App.java", "deep/Helper.java") in edges(state) and ("r2", "pkg/c.py", "pkg/d.py") not in edges(state)
    for change, again in CHANGES:
        former = set(now)
        for path, content in change.items():
            now.pop(path, None)
            if content is not None:
                now[path] = content
        seen.clear()
        rows = incremental.refresh(frame(spark, now), state).collect()
        # only new and changed files are parsed
        assert seen == [sorted(2 * [p for p, c in change.items() if c is not None])]
        assert {r["path"] for r in rows if r["resolved"] and r["status"] != "gone"} == {p for p in again if p in now}
        assert {r["path"] for r in rows if r["status"] == "gone"} == former - set(now)
        full = real(frame(spark, now))
        assert edges(state) == sorted(map(tuple, extract.resolve_imports(full).collect()))
        assert sorted(map(str, state.read("facts").select(*full.columns).collect())) == sorted(map(str, full.collect()))
    assert len(state.commits()) == 2


@pytest.mark.parametrize("step", ["write", "commit", "clean"])
def test_a_killed_refresh_leaves_a_readable_state(spark, tmp_path, monkeypatch, step):
    state = State(spark, f"file://{tmp_path}/state")
    incremental.refresh(frame(spark, BEFORE), state)
    before, name = edges(state), state.present()
    after = BEFORE | {"b.py": "import a\n"}

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if step == "write":  # between two tables
            m.setattr(State, "present", lambda self, real=State.present: killed() if any((tmp_path / "state/versions").glob("00000002*/edges")) else real(self))
        else:
            m.setattr(State, step, killed)
        with pytest.raises(KeyboardInterrupt):
            incremental.refresh(frame(spark, after), state)
    fresh = State(spark, f"file://{tmp_path}/state")
    assert edges(fresh) == (before if step != "clean" else sorted([*before, ("r1", "b.py", "a.py"), ("r2", "b.py", "a.py")]))
    assert (fresh.present() == name) == (step != "clean")
    incremental.refresh(frame(spark, after), fresh)
    assert ("r1", "b.py", "a.py") in edges(fresh)


def test_two_writers(spark, tmp_path):
    state = State(spark, f"file://{tmp_path}/state")
    one = spark.range(3)
    first = state.write(None, {"t": one})
    state.write(first, {"t": one})
    with pytest.raises(RuntimeError, match="moved on"):
        state.write(first, {"t": one})
    for _ in range(3):
        state.write(state.present(), {"t": one})
    assert len(list((tmp_path / "state/versions").iterdir())) == 2 and state.read("t").count() == 3


def test_refresh_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "FEW", 0)
    state = State(spark, f"file://{tmp_path}/state")
    incremental.refresh(frame(spark, BEFORE), state)
    incremental.refresh(frame(spark, BEFORE | {"b.py": "import a\n"}), state)
    assert ("r1", "b.py", "a.py") in edges(state)
    incremental.refresh(frame(spark, BEFORE).limit(0), state)
    assert edges(state) == [] and state.read("facts").count() == 0


def test_prompts_by_repository_and_merge(spark):
    docs = frame(spark, {"a.py": "x" * 20, "b.py": "y"})
    done = spark.createDataFrame([("r1", "a.py", "what it does"), ("r1", "a.py", "also"), ("r2", "b.py", " ")], "repo_id string, path string, description string")
    assert {(r["repo_id"], r["path"]) for r in corpus.prompt_table(docs, 8, done).collect()} == {("r1", "b.py"), ("r2", "a.py")}
    nodes = docs.select("repo_id", "path", F.lit("module").alias("purpose"))
    got = {(r["repo_id"], r["path"]): (r["purpose"], r["purpose_source"]) for r in corpus.merge_descriptions(nodes, done).collect()}
    assert got == {("r1", "a.py"): ("also", "model"), ("r1", "b.py"): ("module", "parser"), ("r2", "a.py"): ("module", "parser"), ("r2", "b.py"): ("module", "parser")}


def test_paths_below_a_root(spark):
    cases = [
        ("s3a://bucket/data/repos/r1/src/a.py", "s3a://bucket/data/repos/", "r1/src/a.py"), ("s3a://bucket/data/repos/r1/a.py", "/data/repos", "r1/a.py"), ("file:/tmp/x/r1/a.py", "/tmp/x", "r1/a.py"),
        ("file:///tmp/x/r1/a.py", "file:///tmp/x/", "r1/a.py"), ("hdfs://host:9000/x/r/a", "hdfs://host:9000/x", "r/a"), ("abfss://c@account.net/x/r/a", "abfss://c@account.net/x", "r/a"), ("s3a://bucket/r1/a.py", "s3a://bucket", "r1/a.py"),
    ]
    for path, root, want in cases:
        assert spark.createDataFrame([(path,)], "path string").select(readers.below(F.col("path"), root)).first()[0] == want
