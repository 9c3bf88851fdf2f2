from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from corpusloom.llm import ball_kmeans

SHAPE = "vec_id long, embedding array<float>, label int, cluster int, n long, sums string"


def brute(rows, k, rounds, width, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((apart(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        label = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, l) in zip(kept, label, strict=True) if l == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    label = assign()
    of = [sum(d for d, j in label if j == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, of[j], sum(of), sha[j]) for (i, _), (d, j) in zip(kept, label, strict=True))


def run(spark, rows, **how):
    table = spark.createDataFrame([(i, v, 0, 1, 2, "s") for i, v in rows], SHAPE).repartition(3)
    got = ball_kmeans.cluster(table, **how).collect()
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_full_comparison(spark, spread):
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((8, 6))
    rows = [(i, (middles[i % 8] + spread * rng.standard_normal(6)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a hot vector
    told: list[dict] = []
    assert run(spark, rows, width=6, told=told) == brute(rows, 8, 10, 6)
    assert len(told) == 11 and all(t["vectors"] == 700 for t in told)
    if spread < 1:  # balls that lie apart are hardly compared
        assert told[-1]["compared"] < told[-1]["full"] / 2


def test_ties_copies_and_bad_rows(spark):
    grid = [(i, [float(i % 3), float(i % 2), 0.0]) for i in range(40)]
    odd = [(50, None), (51, [1.0, None, 0.0]), (52, [float("nan"), 0.0, 0.0]), (53, [float("inf"), 0.0, 0.0]), (54, [1.0, 2.0]), (55, []), (7, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5]), (None, [0.25, 0.25, -0.25])]
    assert run(spark, grid + odd, width=3, scale=2) == brute(grid + odd, 8, 10, 3, 2)
    same = [(i, [0.5, -0.5, 0.25]) for i in range(20)]
    assert run(spark, same, width=3) == brute(same, 8, 10, 3)
    assert len({r[1] for r in run(spark, same, width=3)}) == 1
    few = [(i, [float(i), 0.0, -1.5]) for i in range(3)]
    assert run(spark, few, width=3) == brute(few, 8, 10, 3)
    assert run(spark, odd[:6], width=3) == []
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e9, 0.0, 0.0])], width=3)


def test_annuli_only_skip_what_cannot_win():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, centroids = rng.integers(-9, 9, (200, 3)), rng.integers(-9, 9, (8, 3))
        old = rng.integers(0, 8, 200)
        label, best, _ = ball_kmeans.Balls(centroids, None).assign(x, old)
        want, distance = ball_kmeans.full(x, centroids)
        assert (label == want).all() and (best == distance).all()
        radii = [int(ball_kmeans.squared(x[old == i], c).max()) if (old == i).any() else 0 for i, c in enumerate(centroids)]
        label, best, _ = ball_kmeans.Balls(centroids, radii).assign(x, old)
        assert (label == want).all() and (best == distance).all()
