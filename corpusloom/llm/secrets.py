"""Secret scans with corpus-wide ownership frequency.

Texts are scanned for credential assignments, access keys and long hex strings. Each candidate's value is hashed, and the
hashes are aggregated over the whole corpus by distinct owners and distinct repositories. A value that many owners or many
repositories hold is a copied example; a value that one owner alone holds and that looks generated is reported as live by a
span of its own, which is added to the pattern's span. A value between the two (of two owners, say) that looks generated has
no span of its own, but is redacted like a live one. Values themselves leave the scan only as hashes.

Aggregation is in two steps, distinct (value, owner, repository) first, so a value copied a billion times costs each task
one row. Lookups go back to documents by an equi-join that may be split where a value is hot.

Defined cases: a null or empty text has no spans; a null owner or repository counts as one owner or repository; equal rows
get equal results; an empty table gives an empty table. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.staging import stage
from corpusloom.llm.sieve import fresh, maybe, others
from corpusloom.llm.texts import map_rows, sha256, spans_text

#: Kinds in the order in which spans with equal starts are listed.
KINDS = {"assign": 0, "access": 1, "hex": 2, "live": 3}

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter run can't hold a longer one, so this equals dropping short matches
NAMES = ("passw", "secret", "token", "api")
MIN_VALUE, MIN_ACCESS = 6, 20

#: Values that stand for a credential.
PLACEHOLDERS = ("changeme", "change_me", "example", "placeholder", "redacted", "your_", "xxxx", "dummy", "sample", "test")

#: A generated value is at least so long and has at least so many bits a character.
LIVE_LENGTH, LIVE_BITS = 12, 2.5


def looks_live(value: str) -> bool:
    low = value.lower()
    if len(value) < LIVE_LENGTH or any(p in low for p in PLACEHOLDERS):
        return False
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= LIVE_BITS and any(c.isdigit() for c in value)


def find(text: str) -> list[tuple[int, int, str, int, int]]:
    """start, end, kind, value start, value end of the base spans."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(name in low for name in NAMES):
            for m in ASSIGN.finditer(text):
                if m.end(2) - m.start(2) >= MIN_VALUE:
                    found.append((m.start(), m.end(), "assign", m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((m.start(), m.end(), "access", m.start(), m.end()))
    for m in HEX.finditer(text):
        found.append((m.start(), m.end(), "hex", m.start(), m.end()))
    return found


CANDIDATE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("from", T.LongType()),
        T.StructField("to", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("looks_live", T.BooleanType()),
    ]
)


def _scan(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: cols[k] for k in ("doc_id", "fp", "owner", "repository")}
    out |= {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "candidates")}
    for text in cols["text"]:
        found = find(text) if text else []
        kinds = [x[2] for x in found]
        base = spans_text([x[:3] for x in found], KINDS)
        out["n_assign"].append(kinds.count("assign"))
        out["n_access"].append(kinds.count("access"))
        out["n_hex"].append(kinds.count("hex"))
        out["base_sha256"].append(sha256(base))
        out["spans"].append(base)
        out["candidates"].append(
            [
                {
                    "start": s, "end": e, "kind": k, "from": a, "to": b,
                    "value": hashlib.sha256(text[a:b].encode()).hexdigest()[:32], "looks_live": looks_live(text[a:b]),
                }
                for s, e, k, a, b in found
            ]
        )
    return out


def _named(value: Column) -> Column:
    """A name for every value, one of its own for null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document: counts, base spans and candidates with hashed values; no aggregation yet."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType()),
            T.StructField("owner", T.StringType()), T.StructField("repository", T.StringType()),
            T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
            T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
            T.StructField("candidates", T.ArrayType(CANDIDATE)),
        ]
    )
    rows = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("fp"),
        _named(owner).alias("owner"), _named(repository).alias("repository"),
    )
    return map_rows(rows, _scan, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """value, owners, repositories: in how many distinct owners and repositories each candidate value occurs."""
    places = candidates.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    owners = places.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences"))


def scan_secrets(
    docs: DataFrame, owner: Column | None = None, repository: Column | None = None, live_owners: int = 1, example_owners: int = 3,
    example_repositories: int = 4,
) -> DataFrame:
    """Per document: doc_id, fp (hash of its text), n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, and the
    value ranges judged live and shared (neither owned nor an example, but generated by its looks).

    live_owners: a value of at most so many owners can be live; example_owners, example_repositories: from so many owners or
    so many repositories on it is an example. A repository is named by its owner and a name of its own."""
    owner = F.col("source") if owner is None else owner
    repository = F.col("lang") if repository is None else repository
    scanned = stage(scan(docs, owner, repository))
    each = scanned.select("doc_id", "fp", "owner", "repository", F.explode("candidates").alias("c")).select("doc_id", "fp", "owner", "repository", "c.*")
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    spread = ownership(each).withColumn(
        "class",
        F.when(example, "example").when(F.col("owners") <= live_owners, "owned").otherwise("shared"),
    )
    judged = each.join(spread.select("value", "class"), "value")
    place = F.struct(F.col("from").alias("start"), F.col("to").alias("end"))
    per_doc = judged.groupBy(F.col("doc_id").alias("d"), F.col("fp").alias("f")).agg(
        *(F.collect_set(F.when((F.col("class") == of) & F.col("looks_live"), place)).alias(name) for of, name in (("owned", "live"), ("shared", "shared"))),
        F.collect_set(F.when(F.col("class") == "example", F.struct("from", "to"))).alias("examples"),
    )
    joined = scanned.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("fp").eqNullSafe(F.col("f")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = joined.withColumns({c: F.array_sort(F.coalesce(c, none)) for c in ("live", "shared")})
    base = F.transform(
        "candidates", lambda c: F.struct(c["start"].alias("start"), F.element_at(F.create_map(*[F.lit(x) for k in KINDS.items() for x in k]), c["kind"]).alias("k"), c["end"].alias("end"), c["kind"].alias("kind"))
    )
    added = F.transform("live", lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS["live"]).alias("k"), c["end"].alias("end"), F.lit("live").alias("kind")))
    every = F.array_sort(F.concat(base, added))
    spans = F.when(F.size("live") == 0, F.col("spans")).otherwise(
        F.array_join(F.transform(every, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")
    )
    return joined.select(
        "doc_id", "fp", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.coalesce(F.size("examples"), F.lit(0)).cast("long").alias("n_example"), "live", "shared",
    )


MARK = "[SECRET]"


def disjoint(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans of different kinds may overlap; those that do become one."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in spans):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _redacted(text: str, live: list[dict] | None) -> str:
    parts, at = [], 0
    for start, end in disjoint(live or []):
        parts += [text[at:start], MARK]
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, **how) -> DataFrame:
    """The documents with live and shared values replaced by a mark; every row stays, with its columns."""
    found = scan_secrets(docs, **how).select("doc_id", "fp", F.concat("live", "shared").alias("live")).where(F.size("live") > 0)
    names = {c: fresh(docs.columns, c) for c in ("fp", "found_id", "found_fp", "live")}
    found = stage(found.distinct().toDF(names["found_id"], names["found_fp"], names["live"]))
    rows = docs.withColumn(names["fp"], F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(names["found_id"])) & F.col(names["fp"]).eqNullSafe(F.col(names["found_fp"]))
    marked = maybe(rows, names["fp"], found, names["found_fp"]).join(found, same, "left")

    def mark(cols: dict[str, list]) -> dict[str, list]:
        return {c: v for c, v in cols.items() if c != names["live"]} | {"text": [_redacted(t, x) for t, x in zip(cols["text"], cols[names["live"]], strict=True)]}

    hit = map_rows(marked.where(F.col(names["live"]).isNotNull()).select(*docs.columns, names["live"]), mark, docs.schema)
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    rest = others(rows, names["fp"], found, names["found_fp"]).select(*docs.columns).unionByName(marked.where(F.col(names["live"]).isNull()).select(*docs.columns))
    return rest.unionByName(hit.select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS owner, coalesce('=' || lang, '') AS repository FROM documents),
patterns(kind, k, pattern, g) AS (
  VALUES ('assign', 0, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1),
         ('access', 1, '(AKIA[A-Z0-9]+)', 1), ('hex', 2, '([0-9a-f]+)', 1)),
lists AS (
  SELECT doc_id, text, owner, repository, kind, k, regexp_extract_all(text, pattern) AS whole, regexp_extract_all(text, pattern, 1) AS val,
         string_split_regex(text, pattern) AS pieces
  FROM docs, patterns),
each AS (
  SELECT doc_id, text, owner, repository, kind, k, whole[i] AS whole, val[i] AS val,
         list_sum(list_transform(pieces[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0)::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM lists)),
base AS (
  SELECT *, start + length(whole) AS stop, start + length(whole) - length(val) AS vstart FROM each
  WHERE (kind = 'assign' AND length(val) >= 6) OR (kind = 'access' AND length(whole) >= 20) OR (kind = 'hex' AND length(whole) >= 24)),
owned AS (
  SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM base GROUP BY val),
letters AS (SELECT val, unnest(string_split(val, '')) AS c FROM owned),
counts AS (SELECT val, c, count(*)::DOUBLE AS n FROM letters GROUP BY val, c),
bits AS (SELECT val, -sum(n / length(val) * log2(n / length(val))) AS bits FROM counts GROUP BY val),
judged AS (
  SELECT b.*, o.owners >= 3 OR o.repositories >= 4 AS example, o.owners = 1 AND o.repositories < 4 AND length(b.val) >= 12 AND bits >= 2.5 AND regexp_matches(b.val, '[0-9]')
    AND NOT regexp_matches(lower(b.val), 'changeme|change_me|example|placeholder|redacted|your_|xxxx|dummy|sample|test') AS live
  FROM base b JOIN owned o USING (val) JOIN bits USING (val)),
spans AS (
  SELECT doc_id, kind, k, start, stop, FALSE AS added FROM judged
  UNION SELECT doc_id, 'live', 3, vstart, stop, TRUE FROM judged WHERE live),
texts AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (added) AS n_live,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) FILTER (NOT added), '') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) AS spans
  FROM spans GROUP BY doc_id),
examples AS (SELECT doc_id, count(DISTINCT (vstart, stop)) AS n_example FROM judged WHERE example GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs d LEFT JOIN texts USING (doc_id) LEFT JOIN examples USING (doc_id)
"""
