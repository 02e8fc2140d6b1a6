"""License scans by diagonal voting, in DataFrame functions only.

All rolling word bigrams of a text are hashed and joined to the positions of the templates'
bigrams.  A match votes for the diagonal text position - template position.  A short phrase
is there if all its bigrams voted for one diagonal.  For a longer notice, diagonals a few
words apart are merged, so that inserted or dropped words don't hide it, and the span is
verified by its covered share and its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Notices with labels of the method's own: public license texts, lower-cased words.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
]
#: Bigrams of nothing but these words take no part in the votes for notices.
COMMON = {"a", "and", "any", "are", "as", "by", "in", "is", "it", "of", "or", "that", "the", "this", "to", "with", "you", "0", "2", "3", "4"}
GAP = 3
COVERED = 0.6
LONGEST = 1.6
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = "\0"


def words(text: Column) -> Column:
    """Words of a text with A-Z lowered; null gives none.

    lower() also changes letters beyond ASCII, which stay word characters and match no template,
    but for the Kelvin sign, which would become an ASCII k and is exchanged first.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ķ")))
    return F.filter(F.split(plain, NOT_WORD), lambda w: w != "")


def template_rows() -> list[tuple[int, str, bool, int, int, str]]:
    """template, bigram, base, size in bigrams that vote, position, label."""
    out = []
    for k, (phrase, label) in enumerate([*PHRASES, *NOTICES]):
        base = k < len(PHRASES)
        w = phrase.split()
        voting = [(i, a, b) for i, (a, b) in enumerate(zip(w, w[1:], strict=False)) if base or not {a, b} <= COMMON]
        out += [(k, f"{a} {b}", base, len(voting), i, label) for i, a, b in voting]
    return out


def templates(spark: SparkSession) -> DataFrame:
    rows = [*template_rows(), (-1, END, False, 0, 0, "")]  # the last one keeps each text's end row
    return spark.createDataFrame(rows, "template int, bigram string, base boolean, size int, at int, label string").withColumn("hash", F.xxhash64("bigram"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest covered share of a template, 1 where a phrase is found.  Null and empty
    texts have no words, places or labels; texts of one word have no bigrams; repeated rows and
    repeated keys are scanned each; an empty table gives no rows; other columns aren't read.
    The templates are a fixed list, so their broadcast is bounded; only matches are shuffled, by
    row, so no group holds more than one text's matches.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text)).alias("words"))
    less = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), less), F.slice("words", F.lit(2), less), lambda a, b: F.concat(a, F.lit(" "), b))
    rolled = rows.select("row", "key", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(pairs, F.array(F.lit(END)))).alias("pos", "said"))
    hits = rolled.withColumn("hash", F.xxhash64("said")).join(F.broadcast(templates(spark)), "hash").where(F.col("said") == F.col("bigram"))
    votes = hits.groupBy("row", "template", (F.col("pos") - F.when(F.col("template") < 0, F.col("pos")).otherwise(F.col("at"))).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.first("size").alias("size"), F.first("base").alias("base"), F.first("label").alias("label"), F.first("key").alias("key"), F.first("n_words").alias("n_words")
    )
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > GAP, F.lit(True)), 1).otherwise(0)
    merged = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("row", "template", "span").agg(
        F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("size").alias("size"), F.first("base").alias("base"), F.first("label").alias("label"), F.first("key").alias("key"), F.first("n_words").alias("n_words")
    )
    share = F.least(F.col("votes") / F.greatest(F.col("size"), F.lit(1)), F.lit(1.0))
    length = F.col("high") - F.col("low") + 1
    good = F.when(F.col("base"), F.col("votes") == F.col("size")).otherwise((share >= COVERED) & (length <= LONGEST * F.col("size") + GAP)) & (F.col("template") >= 0)
    fits = (F.col("template") >= 0) & (length <= LONGEST * F.col("size") + GAP)
    seen = spans.withColumns({"share": F.when(fits, share).otherwise(0.0), "good": good})
    place = F.col("good") & F.col("base")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return seen.groupBy("row").agg(
        F.first("key").alias(key),
        F.first("n_words").alias("n_words"),
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("low"))).cast("long").alias("last_word"),
        joined(place).alias("base_labels"),
        joined(F.col("good")).alias("labels"),
        F.max("share").cast("double").alias("score"),
    ).drop("row")


def oracle() -> str:
    """The whole scan in SQL over the table documents."""
    values = ", ".join(f"({k}, '{b}', {str(base).lower()}, {size}, {at}, '{label}')" for k, b, base, size, at, label in template_rows())
    return f"""
WITH t(template, bigram, base, size, place, label) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT r, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT r, template, pos - place AS diagonal, count(*) AS votes, min(pos) AS low, max(pos) AS high, any_value(size) AS size, any_value(base) AS base, any_value(label) AS label FROM g JOIN t USING (bigram) GROUP BY ALL),
a AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {GAP}, true) THEN 1 ELSE 0 END AS apart FROM v),
m AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM a),
s AS (SELECT r, template, span, sum(votes) AS votes, min(low) AS low, max(high) AS high, any_value(size) AS size, any_value(base) AS base, any_value(label) AS label FROM m GROUP BY r, template, span),
x AS (SELECT *, least(votes / size, 1.0) AS share, high - low + 1 <= {LONGEST} * size + {GAP} AS fits FROM s),
y AS (SELECT *, CASE WHEN base THEN votes = size ELSE share >= {COVERED} AND fits END AS good FROM x),
z AS (SELECT r, count(*) FILTER (WHERE good AND base) AS n_base, min(low) FILTER (WHERE good AND base) AS first_word, max(low) FILTER (WHERE good AND base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE good AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE good) AS labels, max(share) FILTER (WHERE fits) AS score FROM y GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN z USING (r)
"""
