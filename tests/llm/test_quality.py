from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.edges import edge_docs, no_docs

from corpusloom.llm import quality

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").repartition(8), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.score_quality(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    y, score, said = (np.array([r[c] for r in rows]) for c in ("quality", "score", "predicted"))
    assert len(y) > 500 and ((score >= quality.LEAST) == said).all()
    good, bad = score[y == 1], score[y == 0]
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    assert auc >= 0.95 and (said == y).mean() >= 0.93 and (said[y == 1] == 1).mean() >= 0.97
    # calibrated: in bands of the score about as many are good as it says
    for low, high in ((0.0, 0.3), (0.3, 0.9), (0.9, 1.01)):
        band = (score >= low) & (score < high)
        assert band.sum() < 30 or abs(score[band].mean() - y[band].mean()) < 0.15


def brute_vectors(texts):
    places, signs = quality.index_vectors()
    table = np.zeros((quality.SLOTS, quality.WIDTH))
    for text in texts:
        tokens = quality.slots(text).tolist()
        for i, w in enumerate(tokens):
            for j in range(max(0, i - quality.WINDOW), min(len(tokens), i + quality.WINDOW + 1)):
                if i != j:
                    for p, s in zip(places[tokens[j]], signs[tokens[j]], strict=True):
                        table[w, p] += s
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.where(length > 0, length, 1)


@pytest.mark.parametrize("parts", [1, 5])
def test_word_vectors_equal_plain_counting(spark, parts):
    texts = ["the cat sat on the mat", "THE CAT!! sat, 12 of 345", None, "", "one", "é ü é ü 中文 --", "the cat sat " * 50]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts))
    assert np.allclose(got, brute_vectors(texts), atol=1e-6)


def test_features_equal_plain_means(monkeypatch):
    rng = np.random.default_rng(0)
    f = quality.Features(rng.standard_normal((quality.SLOTS, quality.WIDTH)).astype(np.float32))
    texts = ["a b c a", "", None, "x", "a b c a", "!! ?? 12"]
    got = f.of(texts)
    for t, row in zip(texts, got, strict=True):
        v = f.vectors[quality.slots(t)].astype(float)
        want = np.concatenate([v.mean(axis=0), v.std(axis=0), [np.log1p(len(v))]]) if len(v) else np.zeros(2 * quality.WIDTH + 1)
        assert np.allclose(row, want, atol=1e-3)  # sums are of 32 bits
    assert (got[0] == got[4]).all()
    monkeypatch.setattr(quality, "PORTION", 2)
    monkeypatch.setattr(quality, "LONG", 3)
    assert (f.of(texts) == got).all()


def test_network_and_temperature():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 5))
    chance = quality.sigmoid(2 * x[:, 0] * x[:, 1])  # no line parts these
    y = (rng.random(2000) < chance).astype(int)
    apart = np.arange(2000) % 5 == 0
    net = quality.fit(x, y, np.ones(2000), apart)
    fresh = rng.standard_normal((1000, 5))
    assert np.corrcoef(net.score(fresh), quality.sigmoid(2 * fresh[:, 0] * fresh[:, 1]))[0, 1] > 0.8
    logits = 3 * np.log(chance / (1 - chance))  # three times too sure
    assert abs(quality.best_temperature(logits, y, np.ones(2000)) - 3) < 0.5
    assert quality.best_temperature(logits[:3], np.ones(3), np.ones(3)) == 1
    cells = np.array([0, 1, -1, 5, -(1 << 40), (1 << 50)])
    assert quality._integers(quality._planes(cells)).tolist() == cells.tolist()


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(15)] + [(1, 0, 1), (2, None, 0), (None, 1, 0), (3, 7, 0), (999, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1  # null, empty and white space alike
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(no_docs(spark), labels).collect() == []
    one = quality.score_quality(docs, labels.where("quality = 1")).collect()
    assert len(one) == len(rows)
