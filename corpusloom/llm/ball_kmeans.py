"""Ball k-means over integer vectors, exact and without a shuffle of vectors.

Every cluster is a ball: its centroid and the largest distance of a member. After the centroids have moved, the old radius and the
centroid's shift bound the new one, and only centroids that are nearer than twice that bound are neighbours of the ball (they alone
can take a member away). A task computes each member's distance d to its own centroid. Members for which even the nearest
neighbour is farther than 2 d are the stable core and stay; the others lie in annuli between the halved distances of the
neighbours, sorted, and a member of the m-th annulus is compared exactly with the m nearest neighbours alone. As ties go to the smaller
number, a neighbour at just 2 d is still compared. All of it is integer arithmetic, so the labels are those of a full comparison.

On Spark a round is one narrow pass: it reads vectors with their clusters from a table in the shared folder, and writes them with
their new ones; beside its rows each task writes one row of sums per cluster. The next centroids come from these rows (the columns
of vectors aren't read for it), a group of k rows a task whatever the data, so neither a hot cluster nor copies of one vector
gather anywhere. Only k centroids and radii come to the driver. The table of the round before is removed.

Defined cases: a vector that is null, has another number of components than ``width``, or holds a null or non-finite component is left
out; rows with equal ids are rows of their own, each with its vector; rows without an id are clustered, but begin a centroid only where
too few have one; with fewer vectors than k each begins a centroid; equal centroids are both kept, and the smaller number wins; an
empty table gives an empty table. Components beyond ±2^26 (after scaling) would leave 64-bit integers and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage_at, unstage

CLUSTERS, WIDTH, SCALE, ROUNDS, SEED = 8, 64, 1024, 10, 3
#: The largest component whose squared distances fit, and rows that a step compares at once.
LARGEST, STEP = 1 << 26, 65_536

STATE = "vec_id {id}, vec array<int>, cluster int, distance long, of int, n long, sums array<long>, radius long, inertia long, compared long"


def integers(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and vec, integers floor(scale * x), of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size(x) == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c: Column) -> Column:
        value = F.floor(F.lit(float(scale)) * c)
        return F.when(F.abs(F.lit(float(scale)) * c) <= LARGEST, value).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).cast("int")

    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", F.transform(x, whole).alias("vec"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the least hashes, in their order; ties by the vectors themselves."""
    text = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    rows = vectors.select(F.sha2(text, 256).alias("hash"), "vec").orderBy(F.col("hash").asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r["vec"] for r in rows], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to c (one centroid, or one for each row), summed as integers."""
    apart = x - c
    return np.einsum("ij,ij->i", apart, apart)


def full(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance by full comparison: the first round has no balls yet."""
    label, best = np.zeros(len(x), dtype=np.int32), squared(x, centroids[0])
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        nearer = d < best
        label[nearer], best[nearer] = j, d[nearer]
    return label, best


class Balls:
    """Centroids, and of each ball its neighbours by distance. radii: bounds of the squared radii, None where all are neighbours."""

    def __init__(self, centroids: np.ndarray, radii: list[int] | None):
        self.centroids = centroids
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        for i, c in enumerate(centroids):
            apart = squared(centroids, c)
            others = np.array([j for j in range(len(centroids)) if j != i and (radii is None or int(apart[j]) <= 4 * radii[i])], dtype=np.int64)
            order = others[np.argsort(apart[others], kind="stable")]
            self.near.append((order, apart[order]))

    def assign(self, x: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroids, squared distances, and how many distances were computed; old: a cluster of each vector, which only
        decides what is compared."""
        label, best = old.astype(np.int32), squared(x, self.centroids[old])
        compared = len(x)
        for i in np.unique(old).tolist():
            order, apart = self.near[i]
            mine = np.flatnonzero(old == i)
            reach = np.searchsorted(apart, 4 * best[mine], side="right")  # how many neighbours each member may be nearer to
            moving = mine[reach > 0]  # the rest is the stable core
            reach = reach[reach > 0]
            for m, j in enumerate(order.tolist()):
                rows = moving[reach > m]
                if not len(rows):
                    break
                d = squared(x[rows], self.centroids[j])
                compared += len(rows)
                better = (d < best[rows]) | ((d == best[rows]) & (j < label[rows]))
                label[rows[better]], best[rows[better]] = j, d[better]
        return label, best, compared


def next_radii(before: np.ndarray, after: np.ndarray, radii: list[int]) -> list[int]:
    """Bounds of the squared radii around moved centroids: members keep within the old radius and the shift."""
    shifts = squared(before, after).tolist()
    return [(isqrt(r) + 1 + isqrt(s) + 1) ** 2 for r, s in zip(radii, shifts, strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _assigned(rows: DataFrame, balls: Balls, schema: str) -> DataFrame:
    """rows with their nearest centroids, and a row of sums per task and cluster."""
    k = len(balls.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {c: np.zeros(k, dtype=np.int64) for c in ("n", "inertia", "compared")}
        radius, sums = np.full(k, -1, dtype=np.int64), np.zeros_like(balls.centroids)
        ids = None
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                ids, x = batch.column("vec_id"), _matrix(batch.column("vec"))
                if batch.column("cluster").null_count:
                    label, best = full(x, balls.centroids)
                    compared = len(x) * k
                else:
                    label, best, compared = balls.assign(x, batch.column("cluster").to_numpy().astype(np.int64))
                for i in np.unique(label).tolist():
                    mine = label == i
                    totals["n"][i] += mine.sum()
                    totals["inertia"][i] += best[mine].sum()
                    sums[i] += x[mine].sum(axis=0)
                    radius[i] = max(radius[i], best[mine].max())
                totals["compared"][0] += compared
                yield _rows(ids, batch.column("vec"), label, best)
        if ids is not None:
            yield _sums(ids.type, sums, radius, totals)

    return rows.select("vec_id", "vec", "cluster").mapInArrow(run, schema)


def _rows(ids: pa.Array, vec: pa.Array, label: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    none = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([ids, vec, pa.array(label, pa.int32()), pa.array(best, pa.int64()), *none], names=NAMES)


def _sums(kind: pa.DataType, sums: np.ndarray, radius: np.ndarray, totals: dict[str, np.ndarray]) -> pa.RecordBatch:
    k = len(sums)
    none = [pa.nulls(k, t) for t in (kind, pa.list_(pa.int32()), pa.int32(), pa.int64())]
    offsets = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
    more = [pa.array(np.arange(k), pa.int32()), pa.array(totals["n"]), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())), *map(pa.array, (radius, totals["inertia"], totals["compared"]))]
    return pa.RecordBatch.from_arrays([*none, *more], names=NAMES)


NAMES = [c.split(" ")[0] for c in STATE.split(", ")]


def _totals(state: DataFrame, k: int, width: int) -> tuple[list[int], list[list[int]], list[int], list[int], int]:
    """Per cluster: members, sums of components, squared radius (0 if empty), distances summed; and distances computed."""
    parts = state.where("of is not null").select("of", "n", "sums", "radius", "inertia", "compared")
    one = parts.groupBy("of").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("inertia").alias("inertia"), F.sum("compared").alias("compared"))
    cells = parts.select("of", F.posexplode("sums")).groupBy("of", "pos").agg(F.sum("col").alias("s"))  # k * width rows
    n, sums, radii, inertia, compared = [0] * k, [[0] * width for _ in range(k)], [0] * k, [0] * k, 0
    for r in one.collect():
        n[r["of"]], radii[r["of"]], inertia[r["of"]] = r["n"], max(0, r["radius"]), r["inertia"]
        compared += r["compared"]
    for r in cells.collect():
        sums[r["of"]][r["pos"]] = r["s"]
    return n, sums, radii, inertia, compared


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, told: list[dict] | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part. told: gets
    for each pass how many vectors there were and how many distances were computed."""
    spark = vectors.sparkSession
    ids = vectors.schema["vec_id"].dataType.simpleString()
    schema = STATE.format(id=ids)
    rows, path = stage_at(integers(vectors.select("vec_id", "embedding"), width, scale).withColumn("cluster", F.lit(None).cast("int")))
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        unstage(spark, path)
        return spark.createDataFrame([], f"vec_id {ids}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k, radii = len(centroids), None
    for turn in range(rounds + 1):
        state, state_path = stage_at(_assigned(rows, Balls(centroids, radii), schema))
        unstage(spark, path)
        n, sums, own, inertia, compared = _totals(state, k, width)
        if told is not None:
            told.append({"vectors": sum(n), "compared": compared, "full": sum(n) * k})
        rows, path = state.where("of is null"), state_path
        if turn < rounds:
            moved = np.array([[s // n[i] for s in sums[i]] if n[i] else c for i, c in enumerate(centroids.tolist())], dtype=np.int64)
            radii = next_radii(centroids, moved, own)
            centroids = moved
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = F.array(*map(F.lit, hashes))[F.col("cluster")]
    total = F.array(*(F.lit(x).cast("long") for x in inertia))[F.col("cluster")]
    return rows.select("vec_id", "cluster", "distance", total.alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of.alias("centroid_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same by full comparisons, one round after the other."""
    parts = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"a{t} AS MATERIALIZED (SELECT r, vec_id, v, arg_min(j, d * {k} + j) AS j, min(d) AS d FROM (SELECT r, vec_id, v, j, "
            f"list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{t}) GROUP BY r, vec_id, v)"
        )
        if t < rounds:
            parts.append(
                f"m{t} AS (SELECT j, list(m ORDER BY i) AS c FROM (SELECT j, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*))::BIGINT AS m FROM "
                f"(SELECT j, unnest(v) AS x, unnest(range({WIDTH})) AS i FROM a{t}) GROUP BY j, i) GROUP BY j)"
            )
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (j))")
    last = f"a{rounds}"
    return (
        "WITH " + ",\n".join(parts) + f" SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} USING (j)"
    )


ORACLE = _sql()
