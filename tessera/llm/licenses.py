"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of a text (k = 2) is hashed and joined to the
positions of the same k-gram in the templates.  A hit votes for the diagonal
``place in the text - place in the template``; votes are summed per text,
template and diagonal.  Base phrases must fill a diagonal entirely.  For the
longer notices, neighbouring diagonals with at least two votes merge (words
may be missing or added), and a span counts if enough of the template's
k-grams fall on it and it is not much longer than the template.

The template table is fixed and tiny, hence broadcast.  One pass reads the
texts; hits are grouped by a row number, so that repeated rows and equal or
NULL ids stay apart.  Every text also gives one row that carries its number
of words, so texts without a hit stay in the result.

Edge cases: NULL or empty texts have no words, no labels and score 0; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 2
NEAR = 3            # diagonals this close are neighbours
SHARE = 0.7         # of a notice's k-grams that must be found
STRETCH = 1.5       # span against the template's length, at most

#: Phrases that must stand word by word, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Openings of public license notices, found with small changes.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
     "apache"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"
     " general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the"
     " following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("released under the mit license", "mit"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

_SENTINEL = -1


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, split at all ASCII but 0-9 and a-z."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per template k-gram: h, template, label, base, grams, place; and the row all texts meet."""
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate((*phrases, *notices))]
    df = spark.createDataFrame(rows, "template int, text string, label string, base boolean")
    words = df.withColumn("w", F.split("text", " ")).withColumn("grams", F.size("w") - (K - 1))
    placed = words.select("template", "label", "base", "grams", "w",
                          F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("place"))
    gram = [F.get("w", F.col("place") + i) for i in range(K)]
    found = placed.select(F.xxhash64(*gram).alias("h"), "template", "label", "base", "grams", "place")
    every = spark.range(1).select(
        F.lit(None).cast("long").alias("h"), F.lit(_SENTINEL).alias("template"), F.lit("").alias("label"),
        F.lit(False).alias("base"), F.lit(1).alias("grams"), F.lit(0).alias("place"))
    return found.union(every)


def votes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Votes per text row, template and diagonal (the first word's place), with the template places that voted."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       words_of(F.col(text)).alias("w"))
    nexts = F.slice(F.col("w"), 2, F.size("w"))
    pairs = F.when(F.size("w") >= K, F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), nexts.alias("b")))
    rows = rows.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), pairs.alias("g"))
    # position 0 is the row that every text gives
    every = F.concat(F.expr("array(named_struct('a', CAST(NULL AS STRING), 'b', CAST(NULL AS STRING)))"),
                     F.coalesce("g", F.expr("CAST(array() AS array<struct<a:string,b:string>>)")))
    grams = rows.select("doc_id", "row", "n_words", F.posexplode_outer(every).alias("at", "p"))
    h = F.when(F.col("at") > 0, F.xxhash64("p.a", "p.b"))
    grams = grams.select("doc_id", "row", "n_words", (F.col("at") - 1).cast("long").alias("at"), h.alias("h"))
    hits = grams.alias("g").join(F.broadcast(templates(docs.sparkSession)).alias("t"),
                                 F.col("g.h").eqNullSafe(F.col("t.h")))
    hits = hits.select("doc_id", "row", "n_words", "template", "label", "base", "grams", "place",
                       (F.col("at") - F.col("place")).alias("diagonal"))
    # one exchange, by row; all that follows keeps it
    return hits.repartition("row").groupBy(
        "row", "doc_id", "n_words", "template", "label", "base", "grams", "diagonal").agg(
        F.collect_set("place").alias("places"))


def spans(voted: DataFrame) -> DataFrame:
    """Verified spans: row, label, base, first word, end word and share of the template found.

    One path for all: a base phrase's diagonal is a band of its own, a
    notice's neighbouring diagonals make a band, the row that every text gives stays.
    """
    n = F.size("places")
    base, every = F.col("base"), F.col("template") == _SENTINEL
    strong = voted.where(base | every | (n >= 2) | (F.col("grams") == 1))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    jump = base | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR)
    marked = strong.withColumn("jump", F.coalesce(jump, F.lit(False)).cast("int"))
    marked = marked.withColumn("band", F.sum("jump").over(order))
    low = F.col("diagonal") + F.array_min("places")
    high = F.col("diagonal") + F.array_max("places") + K
    bands = marked.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "band").agg(
        F.min(low).alias("first"), F.max(high).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"))
    share = F.col("found") / F.col("grams")
    fits = F.col("end") - F.col("first") <= STRETCH * (F.col("grams") + K - 1)
    kept = bands.where(every | F.when(base, F.col("found") == F.col("grams")).otherwise((share >= SHARE) & fits))
    only = lambda c: F.when(~every, c)
    return kept.select("row", "doc_id", "n_words", "base", only(F.col("label")).alias("label"),
                       only(F.col("first")).alias("first"), only(F.col("end")).alias("end"),
                       F.when(every, 0.0).otherwise(share).alias("share"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    found = spans(votes(docs, doc_id, text))
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    ).drop("row")
