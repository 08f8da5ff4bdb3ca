"""License scans by diagonal voting, with DataFrame functions only.

All rolling word k-gram hashes of a text are joined to the places where the templates have them.
Two places that a text and a template share lie on the diagonal (place in the text minus place in
the template); a diagonal's votes are the template places it covers, as bits.  A span merges a
diagonal with those up to LOOSE further (words more in the text), and is verified by the share of the
template's words that it covers.  No word of a span is more than LOOSE words from where the template
has it, so a span is no longer than the template and LOOSE words, and in its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
LOOSE = 3  # diagonals up to this far after one merge with it
COVER = 0.75  # of a template's words
MOST = 62  # words of a template, as its places are bits of a long

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that are looked for literally, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Wordings of license notices, and their labels (at most MOST words each).
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    """Words of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), GAPS)
    return F.filter(parts, lambda w: w != "")


def _grams(words: Column) -> Column:
    """(place, hash) of every k-gram, and (number of words, null) once."""
    last = F.struct(F.size(words).alias("pos"), F.lit(None).cast("long").alias("gram"))
    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (GRAM - 1), F.lit(0))), lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w, *(F.get(words, i + k) for k in range(1, GRAM))).alias("gram")))
    return F.concat(grams, F.array(last))


def _template_table(spark, texts: tuple) -> DataFrame:
    """(gram, tid, tpos): where the phrases and templates have each k-gram; as many rows as they have words."""
    rows = [(t, text) for t, (text, _) in enumerate(texts)]
    split = spark.createDataFrame(rows, "tid int, text string").withColumn("words", F.split("text", " "))
    exploded = split.select("tid", F.explode(F.slice(_grams(F.col("words")), 1, F.size("words") - (GRAM - 1))).alias("g"))
    return exploded.select(F.col("g.gram").alias("gram"), "tid", F.col("g.pos").alias("tpos"))


def _lookup(values: list, key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), key + 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """Licenses in every text.

    Returns per row: doc_id, n_words, n_base (places of the literal phrases), first_word and
    last_word (the smallest and largest of these places, or null), base_labels, labels (with those
    of the templates; both distinct, sorted, joined by commas), score (the largest share that a span
    covers of a template or phrase, 0 if no k-gram is shared) and spans (label, first and last word,
    share: of each stretch of overlapping finds the best).

    Null text counts as empty; texts without words have no labels.  Each row is one document, so
    repeated ids give a row each; an empty table gives an empty one; other columns play no part.
    Phrases and templates (pairs of a text and a label) have GRAM to MOST words; others are refused.
    """
    spark = docs.sparkSession
    texts = tuple(phrases) + tuple(templates)
    lengths = [len(t.split()) for t, _ in texts]
    if not all(GRAM <= n <= MOST for n in lengths):
        raise ValueError(f"phrases and templates have to have {GRAM} to {MOST} words")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), license_words(F.col(text_col)).alias("words"))
    grams = rows.select("row", "doc_id", F.explode(_grams(F.col("words"))).alias("g")).select("row", "doc_id", "g.pos", F.coalesce("g.gram", F.lit(0).cast("long")).alias("gram"))
    # The row with the number of words has hash 0 and comes back as template -1.
    known = _template_table(spark, texts).unionByName(spark.createDataFrame([(0, -1, 0)], "gram long, tid int, tpos int"))
    hits = grams.join(F.broadcast(known), "gram")  # as many rows as the templates have words

    # From here on all steps follow rows, which one shuffle of the hits brings together.
    hits = hits.repartition("row")
    diagonal = hits.groupBy("row", "doc_id", "tid", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    votes = diagonal.agg(F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("votes"), F.min("pos").alias("first"), (F.max("pos") + GRAM - 1).alias("last"))

    # Merge; a phrase's diagonals (and the row with the number of words) stand alone.
    loose = F.col("tid") >= len(phrases)
    votes = votes.withColumn("along", F.when(loose, F.col("diagonal")).otherwise(F.col("diagonal") * (LOOSE + 1)))
    near = Window.partitionBy("row", "tid").orderBy("along").rangeBetween(0, LOOSE)
    merged = [F.bit_or("votes").over(near).alias("votes"), F.min("first").over(near).alias("first"), F.max("last").over(near).alias("last")]
    spans = votes.select("row", "doc_id", "tid", "diagonal", "along", *merged)

    # Verify: the share of the template's words under the k-grams.
    covered = F.bit_count(reduce_or([F.shiftleft(F.col("votes"), k) for k in range(GRAM)]))
    share = F.when(F.col("tid") >= 0, covered / _lookup(lengths, F.greatest("tid", F.lit(0)))).otherwise(0.0)
    spans = spans.withColumn("share", share)
    is_base = (F.col("tid") >= 0) & ~loose & (F.col("share") == 1)
    is_found = is_base | (loose & (F.col("share") >= COVER))
    spans = spans.withColumn("is_base", is_base).withColumn("is_found", is_found)
    # Finds that overlap are one stretch, of which the best counts.
    along = Window.partitionBy("row", "tid").orderBy("along")
    before = F.max(F.when(F.col("is_found"), F.col("along"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("begins", F.coalesce(F.col("along") - before > LOOSE, F.lit(True)).cast("int"))
    spans = spans.withColumn("stretch", F.sum(F.when(F.col("is_found"), F.col("begins"))).over(along))
    label = _lookup([x for _, x in texts], F.greatest("tid", F.lit(0)))
    best = F.struct("first", "last", label.alias("label"), "share")
    stretches = spans.groupBy("row", "doc_id", "tid", F.when(F.col("is_found"), F.col("stretch")).alias("stretch")).agg(
        F.max(F.when(F.col("tid") < 0, F.col("diagonal"))).alias("words"),
        F.count_if("is_base").alias("bases"),
        F.min(F.when(F.col("is_base"), F.col("diagonal"))).alias("least"),
        F.max(F.when(F.col("is_base"), F.col("diagonal"))).alias("most"),
        F.max("share").alias("share"),
        F.max_by(F.when(F.col("is_found"), best), F.struct("share", (-F.col("along")).alias("early"))).alias("span"),
    )
    is_base, is_found = F.col("bases") > 0, F.col("span").isNotNull()
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return stretches.groupBy("row", "doc_id").agg(
        F.max("words").cast("long").alias("n_words"),
        F.sum("bases").alias("n_base"),
        F.min("least").cast("long").alias("first_word"),
        F.max("most").cast("long").alias("last_word"),
        joined(F.when(is_base, label)).alias("base_labels"),
        joined(F.when(is_found, label)).alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list("span")).alias("spans"),
    ).drop("row")


def reduce_or(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseOR(c)
    return out
