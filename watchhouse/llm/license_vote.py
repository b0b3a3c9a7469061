"""License scan by diagonal voting, in DataFrame operations only.

A text's lower-cased words give one word pair (k = 2) at every position.  The hash of every pair is joined with the pairs of
the license templates; each hit votes for (template, place in text - place in template), the diagonal on which the template
would lie.  Votes are gathered per diagonal as a set of template places, and a span is a diagonal with its neighbours up to MAX_DRIFT
further (words put in or left out), at its closest.  A span is verified by the different template pairs that voted for it, so a pair that is
repeated in the text counts once; as all its hits lie on MAX_DRIFT + 1 diagonals, they stand in the template's order and within its
length.  The hit also compares the pair itself, so a hash collision cannot vote.  A phrase stands in full exactly where all its pairs
vote for one diagonal.

A null or empty text has no words, labels or places and score 0; a text of any length is split into words at once; ties do
not arise; repeated rows (also of one doc_id) are reported each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: phrases that must stand word for word, with their labels
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# further templates of the method; a span needs MIN_COVER of its word pairs
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("either version 2 of the license or at your option any later version", "gpl"),
    ("gnu general public license", "gpl"),
    ("creative commons attribution", "cc"),
    ("isc license", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
MIN_COVER = 0.8
MAX_DRIFT = 2  # the diagonals of a span differ by no more than this


def _templates(spark, base, templates) -> DataFrame:
    """(template, label, base, pairs, at, pair): one row per word pair of every template; a few hundred rows, whatever the corpus."""
    rows = []
    for number, (phrase, label) in enumerate([*base, *templates]):
        words = phrase.split()
        rows += [(number, label, number < len(base), len(words) - 1, at, f"{a} {b}") for at, (a, b) in enumerate(zip(words, words[1:]))]
    values = ", ".join(f"({n}, '{label}', {str(fixed).lower()}, {pairs}, {at}, '{pair}')" for n, label, fixed, pairs, at, pair in rows)
    return spark.sql(f"SELECT *, xxhash64(t_pair) AS t_hash FROM VALUES {values} AS t(template, label, base, pairs, t_at, t_pair)")


def vote(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """Per document: word count, places of the base phrases, labels of base phrases and of all templates, score.

    score is 1 with a base phrase, else the largest share of a template's pairs found in one span.
    """
    words = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), SEPARATORS)
    read = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.filter(words, lambda w: w != "").alias("_words"))
    pairs = F.transform(F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get("_words", i + 1)))
    # the first element stands for the document itself, so that one without hits stays
    rolling = read.select("_row", "doc_id", F.size("_words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), pairs)).alias("_at", "_pair"))
    known = F.broadcast(_templates(docs.sparkSession, base, templates))
    hits = (
        rolling.withColumn("_hash", F.xxhash64("_pair"))
        .join(known, (F.col("_hash") == F.col("t_hash")) & (F.col("_pair") == F.col("t_pair")), "left").where("_at = 0 OR template IS NOT NULL")
    )
    # template places as bits; templates have at most 62 pairs
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t_at"))
    spans = hits.groupBy("_row", "doc_id", "n_words", "template", "label", "base", "pairs", (F.col("_at") - 1 - F.col("t_at")).alias("start")).agg(
        F.bit_or(place).alias("own"))
    beside = Window.partitionBy("_row", "template").orderBy("start").rangeBetween(0, MAX_DRIFT)
    # a base phrase must stand word for word: its diagonals are not merged
    spans = spans.withColumn("votes", F.bit_count(F.when(F.col("base"), F.col("own")).otherwise(F.bit_or("own").over(beside))))
    cover = F.col("votes") / F.col("pairs")
    whole = F.col("base") & (F.col("votes") == F.col("pairs"))
    good = whole | (~F.col("base") & (F.col("votes") >= F.greatest(F.ceil(F.col("pairs") * MIN_COVER), F.lit(1))))
    named = lambda which: F.coalesce(F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ","), F.lit(""))
    return (
        spans.groupBy("_row", "doc_id", "n_words")
        .agg(
            F.count(F.when(whole, 1)).alias("n_base"), F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"), named(whole).alias("base_labels"), named(good).alias("labels"),
            F.round(F.coalesce(F.max(F.when(whole, F.lit(1.0)).when(~F.col("base"), cover)), F.lit(0.0)), 6).alias("score"),
        ).drop("_row")
    )
