"""License scans by diagonal voting over rolling word grams.

Every text becomes a sequence of words, once; the rolling hash of each two neighbouring words is joined with the gram positions of
the templates (a fixed, small table). A gram of a phrase of two or three words counts if its two words are the template's, a
gram of a longer notice if the two words after it agree as well: hashes only find a place, the words themselves decide. Each vote
falls on the diagonal document place minus template place. Votes are summed by document, template and diagonal; neighbouring
diagonals, which differ by an inserted or a dropped word, are merged; and the span is verified by the words that voted for it: a
phrase needs all its grams on one diagonal, so that its very words stand there, a notice needs a share of its grams.

The main path is DataFrame work only. The join needs no shuffle of grams, since the template table has a fixed size and is
sent to all tasks; only votes and one narrow row a document are shuffled.

Defined cases: a null or empty text has no words, no places and score 0; rows with equal id and text count once in the votes
and each is returned; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of text in lower case
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Beside A-Z the only letter whose lower case is a letter of ASCII alone, and a stand-in that no template has.
KELVIN, STAND_IN = "\u212a", "\u00e9"

#: (label, phrase)
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

#: (label, notice): passages by which common licenses are known, lower case, words only.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

#: A notice needs this share of its votes; diagonals so close are one occurrence.
LEAST_SHARE, NEAR = 0.5, 3


def words_of(text: Column) -> Column:
    """The words of a text; letters beyond A-Z come out in lower case as well, which no template's words can be."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(STAND_IN)))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def _templates(spark, phrases, notices) -> DataFrame:
    """One row per gram position: template, label, phrase, place, grams (positions it has), length (words), the words of the
    gram (two of a phrase, four of a notice) and the hash of the first two."""
    rows = []
    for phrase, entries in ((True, phrases), (False, notices)):
        for label, text in entries:
            words = text.split()
            width = 2 if phrase else 4
            grams = len(words) - width + 1
            for i in range(grams):
                rows.append((text, label, phrase, i, grams, len(words), words[i : i + width]))
    table = spark.createDataFrame(rows, "template string, label string, phrase boolean, place int, grams int, length int, gram array<string>")
    return table.withColumn("hash", F.xxhash64(F.get("gram", F.lit(0)), F.get("gram", F.lit(1))))


def votes(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per document (at is null) with doc_id, fp (hash of the text) and n_words, and one for each place and
    template gram that agree, with template, label, phrase, grams, length, place and at (words, from 0)."""
    words = words_of(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("fp"), words.alias("words"))
    # the first entry stands for the document
    each = rows.select("doc_id", "fp", "words", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "words")).alias("turn", "word"))
    each = each.withColumn("key", F.when(F.col("turn") > 0, F.xxhash64("word", F.get("words", F.col("turn")))))
    word = lambda i: F.get("words", F.col("turn") + (i - 1))
    own = lambda i: F.get("gram", F.lit(i))
    same = (F.col("word") == own(0)) & (word(1) == own(1)) & (F.col("phrase") | ((word(2) == own(2)) & (word(3) == own(3))))
    templates = F.broadcast(_templates(docs.sparkSession, phrases, notices))  # of a fixed size: the templates in this file or the call
    return each.join(templates, (F.col("key") == F.col("hash")) & same, "left").where("turn = 0 or template is not null").select(
        "doc_id", "fp", F.when(F.col("turn") == 0, F.size("words")).alias("n_words"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("at"),
        "template", "label", "phrase", "grams", "length", "place",
    )


def spans_of(voted: DataFrame) -> DataFrame:
    """doc_id, fp, label, phrase, start, end (words, end exclusive), share of the template's grams: one row for each verified
    place."""
    diagonals = (
        voted.where("at is not null")
        .withColumn("diagonal", F.col("at") - F.col("place"))
        .groupBy("doc_id", "fp", "template", "label", "phrase", "grams", "length", "diagonal")
        .agg(F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"))
    )
    whole = diagonals.where(F.col("phrase") & (F.size("places") == F.col("grams"))).select(
        "doc_id", "fp", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("length")).alias("end"), F.lit(1.0).alias("share")
    )
    # cells of NEAR diagonals, each diagonal in its own and the next one: two neighbours always meet in one
    cell = F.floor(F.col("diagonal") / NEAR)
    share = F.size("places") / F.col("grams")
    merged = (
        diagonals.where(~F.col("phrase"))
        .withColumn("cell", F.explode(F.array(cell, cell + 1)))
        .groupBy("doc_id", "fp", "template", "label", "phrase", "grams", "cell")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where(share >= LEAST_SHARE)
        .select("doc_id", "fp", "label", "phrase", F.col("low").alias("start"), (F.col("high") + 4).alias("end"), share.alias("share"))
        .distinct()
    )
    return whole.unionByName(merged)


def license_spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    return spans_of(stage(votes(docs, phrases, notices)))


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per document; score: the largest share of
    a template's votes found in one place."""
    phrase = F.col("phrase")
    voted = stage(votes(docs, phrases, notices))
    found = (
        spans_of(voted)
        .groupBy(F.col("doc_id").alias("d"), F.col("fp").alias("f"))
        .agg(
            F.count_if(phrase).alias("n_base"), F.min(F.when(phrase, F.col("start"))).alias("first_word"), F.max(F.when(phrase, F.col("start"))).alias("last_word"),
            F.collect_set(F.when(phrase, F.col("label"))).alias("base"), F.collect_set("label").alias("every"), F.max("share").alias("score"),
        )
    )
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return (
        voted.where("at is null").select("doc_id", "fp", F.col("n_words").cast("long").alias("n_words"))
        .join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("fp").eqNullSafe(F.col("f")), "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
            listed("base").alias("base_labels"), listed("every").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    value = lambda label, text: f"('{label}', string_split('{text}', ' '))"
    return rf"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
phrases(label, p) AS (VALUES {", ".join(value(*x) for x in PHRASES)}),
notices(label, p) AS (VALUES {", ".join(value(*x) for x in NOTICES)}),
starts AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM words),
places AS (SELECT doc_id, label, i FROM starts, phrases WHERE w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
hits AS (
  SELECT DISTINCT doc_id, label, p, i - j AS diagonal, j
  FROM starts, (SELECT label, p, unnest(range(0, len(p) - 3)) AS j FROM notices) n
  WHERE w[i + 1] = p[j + 1] AND w[i + 1 : i + 4] = p[j + 1 : j + 4]),
cells AS (SELECT *, unnest([floor(diagonal / {NEAR}), floor(diagonal / {NEAR}) + 1]) AS cell FROM hits),
noticed AS (
  SELECT doc_id, label, count(DISTINCT j)::DOUBLE / (len(p) - 3)::DOUBLE AS share FROM cells GROUP BY doc_id, label, p, cell
  HAVING count(DISTINCT j)::DOUBLE / (len(p) - 3)::DOUBLE >= {LEAST_SHARE}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id),
every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT doc_id, label, 1.0::DOUBLE AS share FROM places UNION ALL SELECT * FROM noticed) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""


ORACLE = _oracle()
