"""Nearest neighbours over shifted space-filling curves.

Vectors are projected to a few dimensions by seeded orthonormal matrices, shifted, and put in the order of a Hilbert curve, once
for each of several curves. Spark range-partitions and sorts every ordering (narrow rows: curve, key, id), which gives each
vector its rank on each curve; ranks are cut into windows of ``WINDOW`` rows, wherever the borders of partitions lie. A query
meets the vectors of its own window and of both neighbouring ones on every curve; what it finds is merged over the curves and
reranked by the true distance.

Work and shuffles are linear: every vector goes to one window a curve, every query to three. Recall depends on the data: vectors
with structure find their neighbours in small windows; vectors without any (the nearest is hardly nearer than the rest) need
windows that are a good share of the table. See the README for measured recall.

Of equal vectors the least ``k`` + 1 ids stand for all as candidates, which loses no neighbour, as ties go to the smaller id.

Defined cases: vectors that are null, of length zero, or hold null or non-finite components take no part, nor do those whose
number of components differs from the most common one; rows with a null id take no part; repeated rows count once; with fewer
than ``k`` candidates all are returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage

CURVES, DIMENSIONS, BITS = 8, 8, 7
SEED = 20
#: Rows of a window on a curve; narrow rows of a range partition.
WINDOW, SHARD_ROWS = 4096, 500_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (unsigned coordinates of ``bits`` bits) on the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit) & 1
    return key


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of ``q`` and ``x``, summed in the order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (q[:, j] - x[:, j]) ** 2
    return np.sqrt(total)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, vec id and distance of each query's k nearest rows but itself; a matrix product preselects with a margin
    that exceeds its rounding."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    square = (rows**2).sum(axis=1)
    for start in range(0, len(queries), 256):
        q, own = queries[start : start + 256], query_ids[start : start + 256]
        rough = (q**2).sum(axis=1)[:, None] - 2 * (q @ rows.T) + square[None]
        margin = 1e-9 * ((q**2).sum(axis=1) + square.max())
        rough[own[:, None] == ids[None]] = np.inf
        most = min(k, len(rows)) - 1
        edge = np.partition(rough, most, axis=1)[:, most]
        a, b = np.nonzero((rough <= (edge + margin)[:, None]) & np.isfinite(rough))
        if len(a):
            found.append((own[a], ids[b], distances(q[a], rows[b])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (ids[:0], ids[:0], np.zeros(0))


def least(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query by distance, then id."""
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    turn = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    return query[turn < k], ids[turn < k], score[turn < k]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pairs(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})


PAIRS = "query_id long, vec_id long, score double"


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and vec of the rows that take part."""
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    kept = F.col("embedding")
    if vectors.schema["embedding"].dataType.elementType.typeName() != "float":  # a float is exact as a double
        kept = kept.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), kept.alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & good)
    return rows.distinct()


def search(vectors: DataFrame, k: int = 10, every: int = 100, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = stage(clean(vectors))
    sizes = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c"), F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("s"))
    common = sizes.orderBy(F.col("c").desc(), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, count = common["n"], common["c"]
    rows = rows.where(F.size("vec") == width)
    twins = Window.partitionBy("vec").orderBy("vec_id")
    kept = rows.withColumn("turn", F.row_number().over(twins)).where(F.col("turn") <= k + 1).select("vec_id", "vec")
    asks = F.col("vec_id") % every == 0
    both = stage(kept.withColumn("candidate", F.lit(True)).unionByName(rows.where(asks).withColumn("candidate", F.lit(False))))

    random = np.random.default_rng(SEED)
    m = min(DIMENSIONS, width)
    bases = [np.linalg.qr(random.standard_normal((width, m)))[0] for _ in range(curves)]
    shifts = [random.random(m) for _ in range(curves)]
    cell = 8 * max((common["s"] / count / width) ** 0.5, 1e-300) / (1 << BITS)  # four deviations either way

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"))
                cells = [np.clip(np.floor(x @ b / cell + s) + (1 << (BITS - 1)), 0, (1 << BITS) - 1) for b, s in zip(bases, shifts, strict=True)]
                key = np.stack([hilbert_keys(c, BITS) for c in cells], axis=1).ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("candidate"), pa.ListArray.from_arrays(np.arange(0, len(key) + 1, curves, dtype=np.int32), pa.array(key))],
                    names=["vec_id", "candidate", "keys"],
                )

    keyed = both.mapInArrow(keys, "vec_id long, candidate boolean, keys array<long>").select("vec_id", "candidate", F.posexplode("keys").alias("curve", "key"))
    ordered = keyed.repartitionByRange(max(curves, -(-curves * count // SHARD_ROWS)), "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    # the id of a row counts up in its partition, from the partition's number times 2^33
    numbered = stage(ordered.select("vec_id", "candidate", "curve", F.monotonically_increasing_id().alias("place")).withColumn("part", F.shiftright("place", 33)))
    # a row for each partition and curve
    runs = numbered.groupBy("curve", "part").agg(F.min("place").alias("first"), F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("curve", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.floor((F.col("place") - F.col("first") + F.col("before")) / window).cast("int")
    placed = numbered.join(F.broadcast(runs), ["curve", "part"]).groupBy("vec_id", "candidate").agg(F.collect_list(F.struct("curve", at.alias("at"))).alias("places"))

    near = F.when(F.col("candidate"), F.array("p.at")).otherwise(F.sequence(F.col("p.at") - 1, F.col("p.at") + 1))
    dealt = both.join(placed, ["vec_id", "candidate"]).select("vec_id", "vec", "candidate", F.explode("places").alias("p"))
    dealt = dealt.select("vec_id", "vec", "candidate", F.col("p.curve").alias("curve"), F.explode(near).alias("at"))

    def meet(table: pa.Table) -> pa.Table:
        """The k nearest among a window's vectors of each query that asks there."""
        table = table.combine_chunks()
        candidate = table["candidate"].to_numpy(zero_copy_only=False)
        ids, x = table["vec_id"].to_numpy(), _matrix(table["vec"].combine_chunks())
        if not candidate.any() or candidate.all():
            return _pairs(ids[:0], ids[:0], np.zeros(0))
        return _pairs(*least(*nearest(x[~candidate], ids[~candidate], x[candidate], ids[candidate], k), k))

    found = stage(dealt.groupBy("curve", "at").applyInArrow(meet, PAIRS))
    return _ranked(found, k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    unique = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return unique.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH good AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, x: a + x)) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""
