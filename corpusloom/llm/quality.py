"""Quality of documents: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Random indexing: every context has a fixed sparse index vector of a few +1 and -1, and a word's vector is the sum of the index vectors of
the words around it, over all places of the whole corpus. Words (case as written), numbers by their length, and runs of marks are tokens; a
token's number is its hash, so the table of vectors has a fixed size whatever the vocabulary: each task sums up its own, and Spark adds
these tables up in two steps, part by part (integers, so the sums don't depend on how rows are dealt).

A document's features are the means and the deviations of its tokens' vectors (of length 1) and the logarithm of its length. A network with
one hidden layer learns ``labels.quality`` from a sample of the labelled rows that aren't held out: about ``PER_LABEL`` documents of each
label, by hash, weighted so that they stand for all. A fifth of the sample isn't trained on; on it one temperature is fitted, by
which all logits are divided, so that scores are probabilities.

Defined cases: a null text, or one without tokens, has features of 0 and the score that follows; a null id is scored and never held out or
trained on; labels other than 0 and 1 and labels without a document are passed over, a document with both labels trains as both; of several
texts with one id the one with the least hash trains; without any labelled row every score is 0.5; equal texts get equal scores; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.language import held_out
from corpusloom.llm.texts import map_rows, pieces

#: Hashed tokens, components of their vectors, places of an index vector that aren't 0, and neighbours on either side.
SLOTS, WIDTH, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: Labelled documents of each label that train, about; shares of the table that are added up apart, and salts of the first step.
PER_LABEL, PARTS, SALTS = 4000, 32, 8
HIDDEN, EPOCHS, RATE, SHRINK = 32, 400, 0.01, 1e-3
#: A document of this score or more is predicted to be of quality 1.
LEAST = 0.3
#: Tokens that are worked on at once, and bytes of a text that are tokenised at once.
PORTION, LONG = 300_000, 1 << 20

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\s\x80-\xff]+")
DIGITS = bytes.maketrans(b"123456789", b"000000000")


def slots(text: str | None) -> np.ndarray:
    """The hashed tokens of a text, in order."""
    data = (text or "").encode().translate(DIGITS)
    if len(data) <= LONG:
        found = TOKEN.findall(data)
        return np.fromiter(map(zlib.crc32, found), dtype=np.int64, count=len(found)) & (SLOTS - 1)
    return np.fromiter((zlib.crc32(m[0]) for m in TOKEN.finditer(data)), dtype=np.int64) & (SLOTS - 1)


def index_vectors(seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of every context the places of its index vector and their signs; half of the signs are +1. The row beyond the last is none."""
    random = np.random.default_rng(seed)
    places = np.argsort(random.random((SLOTS + 1, WIDTH)), axis=1)[:, :NONZERO]
    signs = np.tile(np.where(np.arange(NONZERO) % 2, -1, 1), (SLOTS + 1, 1))
    signs[SLOTS] = 0
    return places, signs


def add_contexts(table: np.ndarray, tokens: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to the words' rows of ``table`` (flat) the index vectors of their neighbours. Texts are set apart by WINDOW times the number
    SLOTS, which has no index vector and whose own row counts for nothing."""
    for apart in range(1, WINDOW + 1):
        for word, context in ((tokens[:-apart], tokens[apart:]), (tokens[apart:], tokens[:-apart])):
            for z in range(NONZERO):
                table += np.bincount(word * WIDTH + places[context, z], weights=signs[context, z], minlength=len(table)).astype(np.int64)


def _portions(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
    part, n = [], 0
    for text in texts:
        part.append(slots(text))
        n += len(part[-1])
        if n > PORTION:
            yield part
            part, n = [], 0
    if part:
        yield part


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's table of vectors, in PARTS rows."""
    table = np.zeros((SLOTS + 1) * WIDTH, dtype=np.int64)
    places, signs = index_vectors()
    gap = np.full(WINDOW, SLOTS, dtype=np.int64)
    for batch in batches:
        for piece in pieces(batch):
            for part in _portions(piece.column(0).to_pylist()):
                add_contexts(table, np.concatenate([x for tokens in part for x in (tokens, gap)]), places, signs)
    cells = table[: SLOTS * WIDTH].reshape(PARTS, -1)
    here = np.flatnonzero(cells.any(axis=1))
    salt = TaskContext.get().partitionId() % SALTS
    yield _cells(here, cells[here], np.full(len(here), salt))


def _cells(part: np.ndarray, cells: np.ndarray, salt: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(salt, pa.int32()), pa.array([_planes(c) for c in cells], pa.binary())], names=["part", "salt", "cells"])


def _planes(cells: np.ndarray) -> bytes:
    """Integers with their sign in the lowest bit, byte by byte in planes (most are small, so most planes are empty)."""
    flat = ((cells << 1) ^ (cells >> 63)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _integers(data: bytes) -> np.ndarray:
    flat = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return (flat >> np.uint64(1)).astype(np.int64) ^ -(flat & np.uint64(1)).astype(np.int64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables added up by part and salt: rows come in their order, so one sum is held at a time."""
    now, total = None, None
    for batch in batches:
        for part, salt, data in zip(*(batch.column(c).to_pylist() for c in ("part", "salt", "cells")), strict=True):
            if (part, salt) != now:
                if total is not None:
                    yield _cells(np.array([now[0]]), total[None], np.array([now[1]]))
                now, total = (part, salt), np.zeros(SLOTS // PARTS * WIDTH, dtype=np.int64)
            total += _integers(data)
    if total is not None:
        yield _cells(np.array([now[0]]), total[None], np.array([now[1]]))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """[SLOTS, WIDTH], each row of length 1 (0 if its tokens don't occur), from all texts."""
    shape = "part int, salt int, cells binary"
    tables = docs.select("text").mapInArrow(_learn, shape)
    for keys in (("part", "salt"), ("part",)):
        tables = tables.select("part", "salt" if len(keys) > 1 else F.lit(0).alias("salt"), "cells").repartition(*keys).sortWithinPartitions("part", "salt").mapInArrow(_added, shape)
    table = np.zeros((PARTS, SLOTS // PARTS * WIDTH))
    for r in tables.collect():  # PARTS rows
        table[r["part"]] = _integers(r["cells"])
    table = table.reshape(SLOTS, WIDTH)
    length = np.sqrt((table**2).sum(axis=1, keepdims=True))
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


class Features:
    def __init__(self, vectors: np.ndarray):
        self.vectors, self.squares = vectors, vectors**2

    def of(self, texts: list[str | None]) -> np.ndarray:
        """[texts, 2 * WIDTH + 1]: means and deviations of the tokens' vectors, and the logarithm of their number."""
        out = []
        for part in _portions(texts):
            sizes = np.array([len(x) for x in part])
            full = np.flatnonzero(sizes)
            found = np.zeros((len(part), 2 * WIDTH + 1))
            if len(full):
                tokens = np.concatenate(part)
                starts = (np.cumsum(sizes) - sizes)[full]
                n = sizes[full, None]
                mean = np.add.reduceat(self.vectors[tokens], starts, axis=0) / n
                square = np.add.reduceat(self.squares[tokens], starts, axis=0) / n
                found[full] = np.concatenate([mean, np.sqrt(np.maximum(0, square - mean**2)), np.log1p(n)], axis=1)
            out.append(found)
        return np.concatenate(out) if out else np.zeros((0, 2 * WIDTH + 1))


# ---- the network


class Network:
    """One hidden layer; probabilities at a temperature."""

    def __init__(self, middle: np.ndarray, spread: np.ndarray, weights: list[np.ndarray], temperature: float):
        self.middle, self.spread, self.weights, self.temperature = middle, spread, weights, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return (np.tanh((x - self.middle) / self.spread @ a + b) @ c + d).ravel()

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(sigmoid(self.logits(x) / self.temperature), 9)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def loss(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The weighted mean of the negative log likelihood."""
    return float((weight * (np.logaddexp(0, logits) - y * logits)).sum() / weight.sum())


def best_temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where the loss is least between 1/20 and 20 (in 1/T it is convex, so a section search finds it); 1 with one label alone."""
    if len(np.unique(y)) < 2:
        return 1.0
    low, high, golden = 1 / 20, 20.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        if loss(logits * a, y, weight) <= loss(logits * b, y, weight):
            high = b
        else:
            low = a
    return 2 / (low + high)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, apart: np.ndarray, seed: int = 0) -> Network:
    """Train by Adam on the rows that aren't ``apart``, then fit the temperature on those that are."""
    own = ~apart if (~apart).any() else np.ones(len(y), dtype=bool)
    middle, spread = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    random = np.random.default_rng(seed)
    weights = [random.standard_normal((x.shape[1], HIDDEN)) / x.shape[1] ** 0.5, np.zeros(HIDDEN), random.standard_normal((HIDDEN, 1)) / HIDDEN**0.5, np.zeros(1)]
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    z, t, share = (x[own] - middle) / spread, y[own][:, None], (weight[own] / weight[own].sum())[:, None]
    for i in range(1, EPOCHS + 1):
        a, b, c, d = weights
        h = np.tanh(z @ a + b)
        slope = share * (sigmoid(h @ c + d) - t)
        back = slope @ c.T * (1 - h**2)
        slopes = [z.T @ back + SHRINK * a, back.sum(axis=0), h.T @ slope + SHRINK * c, slope.sum(axis=0)]
        for w, g, s in zip(weights, slopes, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            w -= RATE * (s[0] / (1 - 0.9**i)) / (np.sqrt(s[1] / (1 - 0.999**i)) + 1e-8)
    network = Network(middle, spread, weights, 1.0)
    if apart.any():
        network.temperature = best_temperature(network.logits(x[apart]), y[apart], weight[apart])
    return network


# ---- on Spark


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, quality, weight, apart, text: about ``per_label`` labelled documents of each label that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40))
    chosen = None
    for label, n in sorted(counts.items()):
        part = known.where((F.col("quality") == label) & (place < int(min(1.0, per_label / n) * (1 << 40)))).withColumn("weight", F.lit(max(1.0, n / per_label)))
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return docs.select("doc_id", F.lit(0).alias("quality"), F.lit(1.0).alias("weight"), F.lit(False).alias("apart"), "text").limit(0)
    # about 2 * per_label rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(5)) == 0
    return one.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "weight", apart.alias("apart"), F.col("least.text").alias("text"))


def score_quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted of every text of ``docs``."""
    spark = docs.sparkSession
    features = spark.sparkContext.broadcast(Features(word_vectors(docs)))  # of a size fixed by SLOTS and WIDTH
    rows = sample(docs, labels, per_label)
    shape = T.StructType([f for f in rows.schema if f.name != "text"] + [T.StructField("x", T.ArrayType(T.DoubleType()))])

    def described(cols: dict[str, list]) -> dict[str, list]:
        return {c: v for c, v in cols.items() if c != "text"} | {"x": list(features.value.of(cols["text"]))}

    found = sorted(map_rows(rows, described, shape).collect(), key=lambda r: (str(r["doc_id"]), r["quality"]))  # about 2 * per_label rows
    network = None
    if found:
        network = fit(*(np.array([r[c] for r in found]) for c in ("x", "quality", "weight", "apart")))
    sent = spark.sparkContext.broadcast(network)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(cols: dict[str, list]) -> dict[str, list]:
        score = np.full(len(cols["text"]), 0.5) if sent.value is None else sent.value.score(features.value.of(cols["text"]))
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": score, "predicted": (score >= LEAST).astype(np.int32)}

    return map_rows(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
