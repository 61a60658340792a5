"""License scans by diagonal voting. Native expressions only.

Every k words of a text and of each template are hashed; a Spark join of the
text's hashes to the template's positions gives points, points with the same
offset (word position - template position) lie on a diagonal, each diagonal's
votes are counted, neighbouring diagonals are merged (a few words were put in
or left out), and the span they cover is verified against the template's words.
"""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from .text import body, lower_ascii

WORD_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases that are labels on their own, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# The usual wording of licence notices, and their labels.
NOTICES = [
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at", "apache"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Released under the MIT License.", "mit"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met", "bsd"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("All rights reserved.", "all-rights-reserved"),
    ("This is free and unencumbered software released into the public domain", "public-domain"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
]


def template_words(text):
    return [w for w in re.split(WORD_BREAKS, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, exact, words): phrases must stand word by word."""
    rows = [(i, label, exact, template_words(text)) for i, (text, label, exact) in enumerate(
        [(t, l, True) for t, l in phrases] + [(t, l, False) for t, l in notices])]
    if any(len(r[3]) < 2 for r in rows):
        raise ValueError("a template needs two words")
    return spark.createDataFrame(rows, "template int, label string, exact boolean, words array<string>")


def _grams(words, k):
    return F.expr(f"transform(sequence(0, size({words}) - {k}), i -> xxhash64("
                  + ", ".join(f"{words}[i + {j}]" for j in range(k)) + "))")


def spans(docs: DataFrame, k: int = 2, slack: int = 3, min_share: float = 0.75, **lists) -> DataFrame:
    """Verified spans: ``key``, template, label, exact, first_word, last_word (of
    the start of the phrase for exact templates), ``score`` (share of the
    template's words that stand in the span at their place, merged diagonals
    together). ``key`` is shared by equal rows."""
    spark = docs.sparkSession
    listed = templates(spark, **lists)
    # the templates are parameters: their grams are a few hundred rows, so they are broadcast
    points = listed.select("template", "label", "exact", F.size("words").alias("size"),
                           F.posexplode(_grams("words", k)).alias("at", "gram"))
    rows = _keyed(docs).withColumn("words", _words())
    grams = rows.filter(F.size("words") >= k).select("key", F.posexplode(_grams("words", k)).alias("pos", "gram"))
    hits = (grams.join(F.broadcast(points), "gram").withColumn("diagonal", F.col("pos") - F.col("at"))
            # the same row twice, or a hash twice in a template, is one point
            .dropDuplicates(["key", "template", "pos", "at"]))
    votes = hits.groupBy("key", "template", "label", "exact", "size", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
    # phrases: all grams on one diagonal
    exact = votes.filter(F.col("exact") & (F.col("votes") == F.col("size") - k + 1)).select(
        "key", "template", "label", "exact", F.col("diagonal").alias("first_word"),
        F.col("diagonal").alias("last_word"), F.lit(1.0).alias("score"))
    # notices: diagonals near the one before form a band; a band covers the template's positions
    # that any of its diagonals holds. Near is less than a template's length, so that a notice
    # repeated at once is two bands
    near = F.least(F.lit(slack), F.floor(F.col("size") / 4))
    order = W.partitionBy("key", "template").orderBy("diagonal")
    banded = (votes.filter(~F.col("exact"))
              .withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int"))
              .withColumn("band", F.sum(F.coalesce("new", F.lit(0))).over(order)))
    covered = (hits.filter(~F.col("exact")).join(banded.select("key", "template", "diagonal", "band"),
                                                 ["key", "template", "diagonal"])
               .select("key", "template", "label", "size", "band", "pos", F.explode(
                   F.sequence(F.col("at"), F.col("at") + (k - 1))).alias("at"))
               .groupBy("key", "template", "label", "size", "band")
               .agg(F.countDistinct("at").alias("n"), F.min("pos").alias("first_word"),
                    (F.max("pos") + (k - 1)).alias("last_word")))
    # verified: enough of the template, in a span not much longer than it
    good = covered.filter((F.col("n") >= min_share * F.col("size"))
                          & (F.col("last_word") - F.col("first_word") < F.col("size") + near))
    good = good.withColumn("score", F.col("n") / F.col("size"))
    # of notices that overlap only the best fits stay: wordings differ in a word or two
    place = W.partitionBy("key").orderBy("first_word", "last_word", "template")
    reach = F.max("last_word").over(place.rowsBetween(W.unboundedPreceding, -1))
    good = (good.withColumn("apart", F.coalesce(F.col("first_word") > reach, F.lit(True)).cast("int"))
            .withColumn("cluster", F.sum("apart").over(place))
            .withColumn("best", F.max("score").over(W.partitionBy("key", "cluster"))).filter("score = best"))
    return exact.unionByName(good.select("key", "template", "label", F.lit(False).alias("exact"),
                                         "first_word", "last_word", "score"))


def _keyed(docs):
    return docs.select(F.col("doc_id").cast("long"), body("text").alias("body"),
                       F.xxhash64("doc_id", "text").alias("key"))


def _words():
    return F.array_remove(F.split(lower_ascii(F.col("body")), WORD_BREAKS), "")


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are left out): ``n_words``,
    ``n_base`` (places of the exact phrases), ``first_word`` and ``last_word``
    (smallest and largest start of one, else null), ``base_labels``, ``labels``
    (the notices' too; sorted, comma-joined, empty if none) and ``score`` (the
    best span's share, 0 if none). A null or empty text has no words; repeated
    rows get equal rows; an empty table gives none."""
    found = spans(docs, **options)
    base = F.col("exact")
    by_key = found.groupBy("key").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("last_word"))).alias("last_word"),
        # labels are few: the lists that the templates name
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"))
    sized = _keyed(docs).select("doc_id", "key", F.size(_words()).cast("long").alias("n_words"))
    return sized.join(by_key, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
