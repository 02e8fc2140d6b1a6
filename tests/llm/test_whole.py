"""Corpus operators beyond the sizes at which they once did less."""

import random

import pandas as pd
from pyspark.sql import functions as F

from textcohort.llm import bagmin, langid, mixing


def test_a_rare_language_beside_many_ngrams(spark):
    rng = random.Random(11)
    big = [(i, "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(10_000)), "aa") for i in range(45)]
    rare = [(100 + i, "".join(chr(rng.randrange(0x430, 0x450)) for _ in range(40)), "zz") for i in range(20)]
    docs = spark.createDataFrame(big + rare, "doc_id long, text string, lang string")
    model = langid.train(docs)
    grams = langid.ngram_counts(docs).select("gram").distinct().count()
    assert grams > 400_000 and len(model.hashes[langid.ORDER]) == grams and model.langs == ["aa", "zz"]
    got = {r.lang_pred for r in langid.identify(docs.where("lang = 'zz'"), model).collect()}
    assert got == {"zz"}


def test_mixing_plans_every_one_of_many_sources(spark):
    many = spark.range(42_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 5 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'de' ELSE 'en' END AS lang", "concat('host', id % 21000) AS source")
    large = spark.range(30_000).selectExpr("100000 + id AS doc_id", "repeat('w ', cast(1 + id % 7 AS int)) AS text", "'en' AS lang", "'big' AS source")
    docs = many.unionByName(large)
    plan = mixing.Mixture(budget=0.4, max_epochs=2, weights={("all", "en"): 1.0, ("all", "de"): 4.0, ("all", "en", "big"): 5000.0, ("all", "de", "host3"): 0.25})
    rows = docs.withColumn("n", mixing.n_tokens(F.col("text"))).groupBy("lang", "source").agg(F.sum("n").alias("n"), F.max("n").alias("most")).toPandas()
    assert len(rows) > mixing.MAX_LEAVES
    want = mixing.budgets({("all", r.lang, r.source): r.n for r in rows.itertuples()}, plan)
    got = mixing.mix(docs, plan).groupBy("lang", "source").agg(F.sum("__tokens").alias("tokens")).toPandas()
    both = rows.merge(got, "left", ["lang", "source"]).fillna({"tokens": 0})
    budget = pd.Series([want["all", r.lang, r.source] for r in both.itertuples()])
    assert (both.tokens <= budget).all() and (both.tokens > budget - both.most).all()
    by_lang = both.groupby("lang").tokens.sum()
    assert by_lang["de"] > 2 * (both.n[both.lang == "de"].sum() * 0.4)


def test_near_copies_of_repeated_keys_and_rows(spark):
    words = lambda p, n: [f"{p}{i}" for i in range(n)]
    a, b = words("a", 104), words("b", 104)
    near = [*a[:-8], *words("x", 8)]  # 92 of 100 shingles are shared: 92 / 108
    rows = [(5, " ".join(a)), (5, " ".join(words("other", 104))), (6, " ".join(near))]
    rows += [(7, " ".join(b))] + [(100 + i, f"text {i} by itself") for i in range(30)] + [(8, " ".join([*b[:-8], *words("y", 8)])), (7, " ".join(b)), (8, " ".join([*b[:-8], *words("y", 8)]))]
    got = bagmin.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).where("doc_id < 100").collect()
    assert {(r.doc_id, r.class_id) for r in got if r.doc_id > 5} == {(6, 5), (7, 7), (8, 7)} and len(got) == 7
