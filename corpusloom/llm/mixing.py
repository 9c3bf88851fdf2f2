"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 36-bit hash of its id. Per source, tokens are summed by the top 12 bits; the bucket in which the running
sum passes the source's budget is the boundary. Only rows of boundary buckets are summed again, by the next 12 bits, and
once more by the last 12. The result is one threshold per source: a row is taken if its hash is below it. No row is
sorted, and thresholds of smaller budgets lie below those of larger ones, so mixes of growing budgets are nested.

Budgets come from weights by water filling: shares by weight, no source above ``max_repeat`` times its size, the excess
shared again among the others. A source that must repeat takes all its rows ``full`` times and, by the threshold, a
part of them once more.

Defined cases: a null or empty text has size 0 and takes 0 words; null sources form one source of their own, ordered
last; rows with equal ids have equal hashes and are taken or left together; a null id hashes as the empty string; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
BITS = 12
BUCKETS = 1 << BITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """36 bits of MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 9), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """One row a source: source, source_size, target, capped. Sources in code point order take the weights in turn.

    The one unpartitioned window here sees one row per source, after aggregation."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(ordered) - 1) % len(weights)).cast("int")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    cap = F.col("source_size") * F.lit(max_repeat)
    tightest = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    everything = tightest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left.cast("double") / weight_left.cast("double"))
    per = per.withColumn("capped", cap / F.col("weight") < F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight").cast("double") * level)
    return per.withColumn("target", target).select("source", "source_size", "target")


def _boundary(rows: DataFrame, found: DataFrame, shift: int) -> DataFrame:
    """Narrow each source's boundary by the 12 bits at ``shift``; found: source, rest, low (hash where the boundary
    starts), below (sum of sizes under it). Only rows within a boundary are summed."""
    bucket = F.shiftright("h", shift)
    width = shift + BITS
    inside = rows.join(
        found, rows["source"].eqNullSafe(found["source"]) & (F.shiftright(rows["h"], width) == F.shiftright(found["low"], width))
    ).select(rows["source"], "size", bucket.alias("bucket"))
    sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("own"))
    running = F.sum("own").over(Window.partitionBy("source").orderBy("bucket"))
    sums = sums.withColumn("through", running).withColumnRenamed("source", "s")
    crossing = (
        sums.join(found, F.col("s").eqNullSafe(F.col("source")))
        .where(F.col("below") + F.col("through") > F.col("rest"))
        .groupBy("source", "rest")
        .agg(
            F.min(F.struct("bucket", (F.col("below") + F.col("through") - F.col("own")).alias("below"), "own")).alias("at"),
        )
    )
    return crossing.select("source", "rest", F.shiftleft("at.bucket", shift).alias("low"), F.col("at.below").alias("below"), F.col("at.own").alias("own"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, keep: Sequence[str] = ()
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (and row, a struct of the columns ``keep``) for every row of ``docs``."""
    sized = {"size": word_count(F.col("text")), "h": id_hash(F.col("doc_id"))}
    rows = stage(docs.select("doc_id", "source", *(v.alias(k) for k, v in sized.items())))
    thresholds = _thresholds(rows, weights, max_repeat)
    if keep:
        packed = F.struct(*(F.col(c) for c in keep)).alias("row")  # a struct, so that columns of any name can be carried
        rows = docs.select("doc_id", "source", packed, *(v.alias(k) for k, v in sized.items()))
    copies = F.col("full") + F.when(F.col("h") < F.coalesce(F.col("threshold"), F.lit(0)), 1).otherwise(0)
    mixed = rows.join(thresholds.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copies", copies)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies", *(["row"] if keep else []))


def _thresholds(rows: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """source, source_size, target, full, threshold: one row a source, written once."""
    targets = stage(source_targets(rows, weights, max_repeat))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    found = targets.select("source", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"))
    for shift in (2 * BITS, BITS, 0):
        found = stage(_boundary(rows, found.select("source", "rest", "low", "below"), shift))
    nearer = F.col("below") + F.col("own") - F.col("rest") < F.col("rest") - F.col("below")
    edges = found.select(F.col("source").alias("s"), (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("threshold"))
    return stage(
        targets.join(edges, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "full", "threshold")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level,
         (3 * source_size)::DOUBLE / weight::DOUBLE AS ratio
  FROM weighed
  WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN ratio < level THEN (3 * source_size)::DOUBLE
              ELSE weight::DOUBLE * max(CASE WHEN ratio >= level THEN level END) OVER () END AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_copies FROM targets),
rests AS (SELECT *, target - full_copies * source_size AS rest FROM budgets),
groups AS (SELECT source, h, sum(size) AS own FROM sized GROUP BY source, h),
running AS (SELECT *, sum(own) OVER (PARTITION BY source ORDER BY h) AS through FROM groups),
edges AS (
  SELECT r.source, min(h) AS low, arg_min(through, h) AS through, arg_min(own, h) AS own
  FROM running r JOIN rests b ON r.source IS NOT DISTINCT FROM b.source WHERE through > rest GROUP BY r.source),
thresholds AS (
  SELECT b.*, CASE WHEN e.low IS NULL THEN 0
                   WHEN e.through - rest < rest - (e.through - e.own) THEN e.low + 1 ELSE e.low END AS threshold
  FROM rests b LEFT JOIN edges e ON b.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (full_copies + CASE WHEN h < threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN thresholds t ON s.source IS NOT DISTINCT FROM t.source
"""
