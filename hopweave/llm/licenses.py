"""Operator 7: license scans by diagonal voting.

Every word k-gram of every document is joined to the positions where the
templates have it.  Matches of one template on one diagonal (document position
minus template position) vote for one alignment; neighbouring diagonals, which
an inserted or dropped word separates, are merged; a merged span is verified by
the share of the template's k-grams that it covers.

Short phrases are templates with k = 2 that must match in full on one diagonal;
license notices are templates with k = 4 that may differ in some words.  Only
built-in functions run; the one shuffle moves matches and a row per document.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Phrases that label a text wherever their words stand in a row.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Openings of widespread license notices, and their labels.
NOTICES = [
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache"),
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain", "public-domain"),
]

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASE_K, NOTICE_K = 2, 4
GAP = 3  # diagonals this near belong to one alignment
COVER = 0.75  # share of a notice's k-grams that a verified span covers
MOST_POSITIONS = 100_000  # bound of what is broadcast


def _upper_to_lower(word: Column) -> Column:
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int, prefix: str) -> DataFrame:
    """hash -> (template, position) of all k-grams of the templates."""
    rows = []
    for n, (text, label) in enumerate(templates):
        words = [w for w in re.split(SEPARATORS, text.lower()) if w]
        grams = [words[i : i + k] for i in range(len(words) - k + 1)]
        if not grams:
            raise ValueError(f"template {text!r} has fewer than {k} words")
        rows += [(n, label, j, len(grams), len(words), g) for j, g in enumerate(grams)]
    if len(rows) > MOST_POSITIONS:
        raise ValueError("too many template positions to broadcast")
    names = ("template", "label", "at", "grams", "words", "gram")
    kinds = ("int", "string", "int", "int", "int", "array<string>")
    made = spark.createDataFrame(rows, ", ".join(f"{prefix}{a} {b}" for a, b in zip(names, kinds)))
    gram = F.col(f"{prefix}gram")
    return F.broadcast(made.withColumn(f"{prefix}hash", F.xxhash64(*[gram[i] for i in range(k)])))


def _rolled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per word with the words that follow; one row for a text without."""
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SEPARATORS, -1), "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("words"))
    zipped = F.arrays_zip(*[F.slice("words", F.lit(i + 1), F.greatest(F.size("words") - i, F.lit(0))).alias(f"w{i}") for i in range(NOTICE_K)])
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), zipped.alias("grams"))
    rows = rows.select("row", "doc_id", "n_words", F.posexplode_outer("grams").alias("pos", "gram"))
    return rows.select(
        "row", "doc_id", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"), *[F.lower(f"gram.w{i}").alias(f"l{i}") for i in range(NOTICE_K)], "gram"
    )


def _matched(rows: DataFrame, grams: DataFrame, k: int, prefix: str) -> DataFrame:
    """``rows`` with the template positions of their k-grams, where there are."""
    full = reduce(lambda a, b: a & b, [F.col(f"l{i}").isNotNull() for i in range(k)])
    key = F.when(full, F.xxhash64(*[F.col(f"l{i}") for i in range(k)]))
    return rows.join(grams, key == F.col(f"{prefix}hash"), "left").drop(f"{prefix}hash")


def _hit(kind: str, k: int) -> Column:
    """The matched template position; equal words confirm what the hash found."""
    p = f"{kind}_"
    same = reduce(lambda a, b: a & b, [_upper_to_lower(F.col(f"gram.w{i}")) == F.col(f"{p}gram")[i] for i in range(k)])
    fields = [F.col(f"{p}{x}").alias(x) for x in ("template", "label", "at", "grams", "words")]
    return F.when(F.col(f"{p}template").isNotNull() & same, F.struct(F.lit(kind).alias("kind"), *fields))


def scan(
    spark: SparkSession, docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans.

    Words are runs of ASCII letters and digits and of all non-ASCII characters;
    A-Z count as a-z.  ``n_base`` counts all places of phrases, ``first_word``
    and ``last_word`` are the least and greatest of their starts (null without),
    ``score`` is the largest verified coverage, ``spans`` are the verified spans
    as (label, first word, last word, coverage), sorted.  A text that is null or
    has no words has zeros, nulls and empty labels.  Repeated rows each have
    their own row.
    """
    rows = _rolled(docs, id_col, text_col)
    rows = _matched(rows, template_grams(spark, phrases, PHRASE_K, "phrase_"), PHRASE_K, "phrase_")
    rows = _matched(rows, template_grams(spark, notices, NOTICE_K, "notice_"), NOTICE_K, "notice_")
    hits = F.array_compact(F.array(_hit("phrase", PHRASE_K), _hit("notice", NOTICE_K)))
    rows = (
        rows.where((F.col("pos") == 0) | F.col("phrase_template").isNotNull() | F.col("notice_template").isNotNull())
        .select("row", "doc_id", "n_words", "pos", F.explode_outer(hits).alias("hit"))
        .repartition("row")  # the rows of a document meet once; all below stays put
        .select("row", "doc_id", "n_words", "pos", "hit.*")
    )
    voted = (
        rows.groupBy("row", "doc_id", "kind", "template", "label", "grams", "words", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.max("n_words").alias("n_words"), F.collect_set("at").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    )
    run = W.partitionBy("row", "kind", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(run) <= GAP) & (F.col("first") <= F.lag("last").over(run) + F.col("words"))
    voted = voted.withColumn("fresh", F.when((F.col("kind") == "notice") & fresh, 0).otherwise(1)).withColumn("span", F.sum("fresh").over(run))
    spans = (
        voted.groupBy("row", "doc_id", "kind", "template", "label", "grams", "words", "span")
        .agg(F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("cover", F.col("votes") / F.col("grams"))
    )
    base = (F.col("kind") == "phrase") & (F.col("cover") == 1)
    found = base | (F.col("kind") == "notice") & (F.col("cover") >= COVER)
    last_word = F.col("last") + F.when(F.col("kind") == "phrase", PHRASE_K).otherwise(NOTICE_K) - 1
    labels = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(found, F.struct("label", F.col("first").cast("long"), last_word.cast("long").alias("last"), "cover")))).alias("spans"),
    ).drop("row")


def labelled(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scan(spark, docs).drop("spans")
