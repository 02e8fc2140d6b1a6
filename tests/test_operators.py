"""Golden values, degenerate inputs and invariants of the core operators."""

import json
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcohort.functions import constants as C
from textcohort.functions import text as T
from textcohort.functions import udfs
from textcohort.operators import extract as E
from textcohort.operators import hypothesis as H
from textcohort.operators import metrics as M
from textcohort.operators import models as B
from textcohort.operators import ranks as R
from textcohort.operators import recode as Q
from textcohort.operators import split as X
from textcohort.sources import files as S
from textcohort.streaming.resume import follow


def one(df):
    return df.first().asDict()


def test_regression_golden(spark):
    df = spark.createDataFrame([("m", 100.0, 95.0), ("m", 40.0, 45.0), ("m", 90.0, 88.0)], "m string, y double, p double")
    got = one(M.regression(df, ["m"], "y", "p"))
    assert got["mae"] == pytest.approx(4.0) and got["rmse"] == pytest.approx(4.2426, abs=1e-4) and got["spearman_rho"] == pytest.approx(1.0)


def test_correlations_golden(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 5.0), (4.0, 4.0), (5.0, 5.0)], "x double, y double").withColumn("g", F.lit(1))
    got = one(M.regression(df, ["g"], "x", "y"))
    assert got["spearman_rho"] == pytest.approx(0.7379, abs=1e-4) and got["pearson_r"] == pytest.approx(0.7746, abs=1e-4)


def test_short_or_constant_has_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("b", 1.0, 4.0)], "g string, x double, y double")
    assert all(r.pearson_r is None and r.spearman_rho is None for r in M.regression(df, ["g"], "x", "y").collect())


def test_areas_golden_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 0.0), ("a", 1, 0.0), ("b", 1, 0.3), ("b", 1, 0.7)], "g string, y int, s double")
    got = {r.g: r for r in M.auroc_auprc(df, ["g"], "s", "y").collect()}
    assert got["a"].auroc == pytest.approx(0.75) and got["a"].auprc == pytest.approx(0.833333, abs=1e-6)
    assert got["b"].auroc is None and got["b"].auprc is None


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, y int, s double")
    assert M.auroc_auprc(df, ["g"], "s", "y").count() == 0
    assert M.classification(df, ["g"], "y", "s").count() == 0


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.5])], "g string, i int, p double")
    got = {r.i: r.q for r in R.benjamini_hochberg(df, ["g"], "p").collect()}
    assert got[0] == pytest.approx(0.04) and got[2] == pytest.approx(0.16 / 3) and got[1] == pytest.approx(0.16 / 3) and got[3] is None and got[4] == pytest.approx(0.5)


@pytest.mark.parametrize(("text", "a", "b"), [(None, True, True), ("  ", True, True), ("N/A", True, True), ("<NA>", True, False), ("no mri", False, True), ("[missing]", False, True), ("fine", False, False), (" nan ", True, True)])
def test_missing_rules(spark, text, a, b):
    got = one(spark.createDataFrame([(text,)], "t string").select(T.is_missing(F.col("t"), "a").alias("a"), T.is_missing(F.col("t"), "b").alias("b")))
    assert (got["a"], got["b"]) == (a, b)


def test_text_cases(spark):
    df = spark.createDataFrame([("  Patchy   Enhancement  ", "Multi-Focal Residual")], "a string, b string")
    got = one(df.select(T.normalize_text(F.col("a")).alias("n"), T.slug(F.col("b")).alias("s"), T.negated(F.lit("No residual")).alias("neg"), T.negated(F.lit("noted")).alias("not_neg"), T.uncertain(F.lit("likely benign")).alias("unc")))
    assert got == {"n": "patchy enhancement", "s": "multi_focal_residual", "neg": True, "not_neg": False, "unc": True}


def test_fold_and_repair():
    assert udfs.fold("ﬁne “Quote” – x") == 'fine "quote" - x'
    report = "The lesion spans 6 cm in the upper quadrant. No lymph nodes were seen.\nOther text."
    assert udfs.repair(report, "lesion spans 6 cm in the uper quadrant") is not None
    assert udfs.repair(report, "entirely unrelated words about nothing") is None
    assert json.loads(udfs.literal("['a', 1]")) == ["a", 1] and json.loads(udfs.literal("plain")) == ["plain"]
    assert udfs.decode_bytes("é".encode()) == ("utf-8", "é")


def test_recode_equals_brute_force(spark):
    """Every match of every pattern, its context cut out and searched by itself."""
    import random
    import re

    rng = random.Random(2)
    pool = ["focus", "foci", "no", "nothing", "not", "ano", "noé", "éfocus", "possible", "impossible", "likely", "extent", "free of", "may represent", "x" * 30, "tumour bed", "tumor bed", "aa", "—", "No\u00a0focus"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "focus no" + "x" * 75 + " focus")]
    lexicon = [("a", r"\bfocus\b"), ("a", "foc[a-z]*"), ("b", r"\btumou?r bed\b"), ("c", r"\b(?:aa|extent)\b"), ("d", "a+"), ("e", "zz")]
    phrases = ["focus", "no", "x focus", "aa aa", "zz"]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {(r.id, r.concept): (r.present, r.negated, r.uncertain, r.matches) for r in Q.recode_patterns(df, spark.createDataFrame(lexicon, "concept string, pattern string"), "id", "t").collect()}
    first = {(r.id, r.phrase): r.status for r in Q.recode_phrases(df, spark.createDataFrame([(p,) for p in phrases], "phrase string"), "id", "t").collect()}

    def status(t, a, b):
        part = t[max(0, a - 80) : b + 80]
        return 1 if re.search("|".join(C.NEGATION), part) else 2 if re.search("|".join(C.UNCERTAINTY), part) else 0

    want, want_first = {}, {}
    for i, t in rows:
        t = " ".join((t or "").lower().split())
        for c, p in lexicon:
            for m in re.finditer(p, t):
                n = want.setdefault((i, c), [0, 0, 0, 0])
                n[status(t, *m.span())] += 1
                n[3] += 1
        for p in phrases:
            if (k := t.find(p)) >= 0:
                want_first[i, p] = ["present", "negated", "uncertain"][status(t, k, k + len(p))]
    assert got == {k: tuple(v) for k, v in want.items()} and first == want_first
    assert {s for s in first.values()} == {"present", "negated", "uncertain"}


@pytest.mark.parametrize("most", [1, 2, 100])
def test_phrases_in_several_passes(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "MAX_PHRASES", most)
    df = spark.createDataFrame([(1, "abcab"), (2, "bc"), (3, None), (3, "")], "id int, t string")
    phrases = spark.createDataFrame([(p,) for p in ("ab", "bc", "c", "b", "", "b", None)], "phrase string")
    got = sorted((r.id, r.phrase) for r in Q.find_phrases(df, phrases, "id", "t").collect())
    assert got == [(1, "ab"), (1, "b"), (1, "bc"), (1, "c"), (2, "b"), (2, "bc"), (2, "c")]


def test_quotes_by_straightened_text(spark):
    docs = spark.createDataFrame([(1, "He said “It’s  fine”\nand went"), (2, "it's fine"), (3, None)], "id int, t string")
    quotes = spark.createDataFrame([(7, "\"it's fine\""), (8, "IT’S FINE"), (9, " "), (10, None)], "q int, t string")
    assert sorted(map(tuple, Q.quoted(docs, quotes, "id", "t", "q", "t").collect())) == [(1, 7), (1, 8), (2, 8)]


def test_needed_strings_are_in_every_match():
    for p, want in ((r"\bextent\b", "extent"), (r"\btumou?r bed\b", "r bed"), (r"\bnon[- ]mass\b", "mass"), ("a|bc", ""), (r"\d+", ""), ("tion[a-z]*", "tion"), ("ab{2,3}c", "a"), ("(?:xy)+z", "z"), (r"a\.b*", "a")):
        assert Q.needed(p) == want


def test_recode_context(spark):
    far = "x" * 100
    rows = [(1, "no focus here"), (2, f"no {far} focus"), (3, "possible focus, no doubt"), (4, "focus and focus"), (5, None), (6, "possible focus")]
    lex = spark.createDataFrame([("c", "focus")], "concept string, pattern string")
    got = {r.id: r for r in Q.recode_patterns(spark.createDataFrame(rows, "id int, t string"), lex, "id", "t").collect()}
    assert got[1].negated == 1 and got[2].present == 1 and got[3].negated == 1 and got[4].present == 2 and got[6].uncertain == 1 and 5 not in got
    assert all(r.present + r.negated + r.uncertain == r.matches for r in got.values())


def test_splits(spark):
    cases = spark.createDataFrame([(f"c{i}", int(i % 4 == 0)) for i in range(40)], "case_id string, y int")
    s = X.monte_carlo(cases, "case_id", "y", 3, 0.2, 7).withColumnRenamed("repeat", "split")
    assert X.violations(s, cases, "case_id").count() == 0
    assert {(r.split, r.y): r.n for r in s.where("role = 'test'").groupBy("split", "y").agg(F.count("*").alias("n")).collect()} == {(k, y): n for k in range(3) for y, n in ((0, 6), (1, 2))}
    bad = s.unionByName(s.where("split = 0 AND role = 'test'").withColumn("role", F.lit("train")))
    assert X.violations(bad, cases, "case_id").collect()[0].problem == "overlap"
    assert X.k_fold(cases, "case_id", "y", 5, 7).groupBy("fold").count().where("count <> 8").count() == 0
    assert s.exceptAll(X.monte_carlo(cases.repartition(3), "case_id", "y", 3, 0.2, 7).withColumnRenamed("repeat", "split")).count() == 0


def test_poisson_weights_have_mean_one(spark):
    w = X.poisson_bootstrap(spark.range(500).toDF("id"), "id", 50, 3).groupBy("replicate").agg(F.sum("weight").alias("n"))
    assert abs(w.agg(F.avg("n")).first()[0] - 500) < 15


def test_tail_probabilities():
    assert H.binomial_two_sided(1, 10) == pytest.approx(0.021484375)
    assert H.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-9)
    assert H.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    assert H.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)


def test_cliffs_delta_by_counting(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, 30), rng.integers(2, 12, 25)
    df = spark.createDataFrame([(1, float(x)) for x in a] + [(0, float(x)) for x in b], "g int, v double").withColumn("k", F.lit(0))
    want = np.mean([np.sign(x - y) for x in a for y in b])
    assert one(H.two_groups(df, ["k"], "g", "v"))["cliffs_delta"] == pytest.approx(want)


def test_models_against_closed_forms():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4))
    y = x @ [1.0, -2, 0.5, 0] + 3 + 0.01 * rng.normal(size=80)
    ols = np.linalg.lstsq(np.column_stack([x, np.ones(80)]), y, rcond=None)[0]
    for w, b in (B.ridge(x, y, 1e-9), B.pls(x, y, 4), B.huber(x, y), B.svr(x, y, 1e6), B.elastic_net(x, y, 1e-9)):
        assert np.allclose(np.append(w, b), ols, atol=2e-2)
    z = (x[:, 0] + 0.3 * rng.normal(size=80) > 0).astype(float)
    for w, _ in (B.logistic(x, z), B.svm(x, z), B.logistic(x, z, 1.0, 0.5)):
        assert abs(w[0]) > 3 * abs(w[1:]).max() and w[0] > 0
    assert B.skip_reason(np.zeros(5), "class") == "one class" and B.skip_reason(np.ones(5), "value") == "constant"
    assert all(math.isnan(v) for v in B.calibration(np.ones(4), np.full(4, 0.5)))


def test_gram_ridge_equals_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2))
    y = x @ [2.0, 1.0] - 1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    w, b = B.gram_ridge(df, ["a", "b"], "y", 1.0)
    v, c = B.ridge(x, y, 1.0)
    assert np.allclose(w, v) and b == pytest.approx(c)


def test_unknown_labels_stay_unknown(spark):
    df = spark.createDataFrame([("g", i, "train" if i < 30 else "test", None if i % 7 == 0 else float(i % 5), float(i), float(i % 3)) for i in range(40)], "g string, row_id long, role string, target double, a double, b double")
    got = B.predictions(df, ["g"], ["a", "b"], ["ridge"]).toPandas()
    assert len(got) == 10 and got[got.row_id == 35].y_true.isna().all()


def test_json_lines_and_csv(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": 1, "v": "a"}\n\n  \nnot json\n{"id": 2\n[1]\n{"id": 3, "v": "c"}\n')
    good, bad = S.json_lines(spark, str(path), "id long, v string")
    assert [r.id for r in good.orderBy("line").collect()] == [1, 3] and bad.count() == 3
    (tmp_path / "x.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n2,\n')
    rows = S.cases(spark, str(tmp_path / "x.csv"), ["id", "text"]).orderBy("row_index").collect()
    assert rows[0].text == 'two\nlines, "quoted"' and rows[1].text is None and rows[1].case_id == "row_1"
    with pytest.raises(ValueError, match="missing"):
        S.cases(spark, str(tmp_path / "x.csv"), ["nothing"])


def test_last_valid_and_prefer(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "bad"), (1, 3, "b"), (2, 1, "bad")], "k int, line int, v string")
    got = S.last_valid(df, ["k"], "line", F.col("v") != "bad").collect()
    assert [(r.k, r.v) for r in got] == [(1, "b")]


def test_manifest_hash_ignores_order(spark, tmp_path):
    df = spark.range(20).selectExpr("id % 2 AS split", "concat('c', id) AS case_id")
    a = S.with_manifest(df, str(tmp_path / "a"), "split", "case_id").orderBy("split").collect()
    assert a == S.with_manifest(df.orderBy(F.desc("case_id")), str(tmp_path / "b"), "split", "case_id").orderBy("split").collect()


def test_call_extractor_retries(spark):
    seen = {}

    def call(text):
        seen[text] = seen.get(text, 0) + 1
        return "ok" if seen[text] == 2 else "bad"

    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string").coalesce(1)
    got = E.call_extractor(call, lambda a: a == "ok", pause=1.0)(df).collect()
    assert [(r.answer, r.attempts) for r in got] == [("ok", 2), ("ok", 2)]


def test_chat_extractor_over_http(spark):
    """Usage of all attempts is added up; errors of the service are attempts; waits grow."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["messages"][-1]["content"]
            asked.append((time.monotonic(), text, body["model"], self.headers["X-Key"]))
            n = sum(a[1] == text for a in asked)
            self.send_response(500 if text == "broken" and n == 1 else 200)
            self.end_headers()
            answer = "bad" if text == "never" or text == "second" and n == 1 else "ok"
            self.wfile.write(b"" if text == "empty" else json.dumps({"choices": [{"message": {"content": answer}}], "usage": {"prompt_tokens": 10, "prompt_tokens_details": {"cached_tokens": 4}, "completion_tokens": 3, "completion_tokens_details": {"reasoning_tokens": 1}}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        post = E.http_post(f"http://127.0.0.1:{server.server_port}", {"X-Key": "k"}, 5)
        df = spark.createDataFrame([(i, x) for i, x in enumerate(["first", "second", "never", "broken", "empty", None])], "id int, text string").coalesce(1)
        got = {r.id: r for r in E.usage(E.chat_extractor(post, lambda a: a == "ok", pause=0.2, message={"model": "m"})(df)).collect()}
    finally:
        server.shutdown()
    assert [(got[i].answer, got[i].attempts, got[i].calls, got[i].fresh, got[i].cached, got[i].output, got[i].reasoning_tokens) for i in range(6)] == [
        ("ok", 1, 1, 6, 4, 3, 1), ("ok", 2, 2, 12, 8, 6, 2), (None, 3, 3, 18, 12, 9, 3), ("ok", 2, 1, 6, 4, 3, 1), (None, 3, 0, 0, 0, 0, 0), ("ok", 1, 1, 6, 4, 3, 1)]
    assert all(a[2:] == ("m", "k") for a in asked)
    first, second, third = (a[0] for a in asked if a[1] == "never")
    assert second - first > 0.9 and 0.15 < third - second < 0.9


def test_reports_from_a_saved_run(spark, tmp_path):
    from textcohort.operators import report

    run = str(tmp_path / "run")
    rows = [(s, f"c{i}", m, float(i), float(i + (i % 3) - 1), ((i * 7 + s) % 20) / 20, int(i % 20 >= 10)) for s in (1, 2) for i in range(40) for m in ("a", "b")]
    S.replace(spark.createDataFrame(rows, "split_id long, case_id string, model_key string, y_true double, y_value double, y_prob double, y_bin long"), f"{run}/predictions")
    S.replace(spark.createDataFrame([(s, "a", f, 1.0 if f == "x" else (-1.0) ** s) for s in (1, 2, 3) for f in ("x", "y")], report.COEFFICIENTS), f"{run}/coefficients")
    got = report.regenerate(spark, run)
    assert got["cases"].count() == 80 and {r.n_predictions for r in got["cases"].collect()} == {2}
    value = {(r.model_key, r.metric): r.value for r in got["summary"].collect()}
    assert value["a", "mae"] == pytest.approx(27 / 40) and value["a", "n"] == 40 and value["a", "auroc"] == value["b", "auroc"]
    assert {r.metric: r.model_key for r in got["best"].collect()}["mae"] == "a"
    assert got["missed"].where("kind = 'residual'").groupBy("model_key").count().collect()[0]["count"] == 10
    assert {r.feature: r.consistency for r in got["signs"].collect()} == {"x": 1.0, "y": pytest.approx(2 / 3)}
    assert {r.split_id: (r.n, r.positives) for r in got["balance"].collect()} == {1: (80, 40), 2: (80, 40)}
    # a finished report is read as it is; a forced one follows the run
    S.replace(spark.createDataFrame(rows[:20], "split_id long, case_id string, model_key string, y_true double, y_value double, y_prob double, y_bin long"), f"{run}/predictions")
    assert report.regenerate(spark, run)["cases"].count() == 80 and report.regenerate(spark, run, force=True)["cases"].count() == 20


def test_direction(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, None), ("a", 2.0, 3.0, None), ("b", 1.0, 3.0, 0.5), ("b", 2.0, 1.0, 0.5), ("c", 1.0, 1.0, None)], "f string, x double, y double, rho double")
    assert {r.f: r.direction for r in Q.direction(df, "f", "x", "y", "rho").collect()} == {"a": 1.0, "b": 1.0, "c": 0.0}
    assert {r.f: r.direction for r in Q.direction(df, "f", "x", "y").collect()} == {"a": 1.0, "b": -1.0, "c": 0.0}


def test_stream_answers_each_request_once(spark, tmp_path):
    schema = "case_id string, row_index long, mode string, split_id string, split_role string, text string"
    record = "case_id string, row_index long, mode string, split_id string, split_role string, phrases array<struct<concept:string,quote:string>>"
    rows = lambda ids: spark.createDataFrame([(f"c{i}", i, "b", "s", "train", "A diffuse mass. Clear margin.") for i in ids], schema)
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for ids in (range(3), range(5)):
        rows(ids).write.mode("append").parquet(folder)
        follow(spark, folder, schema, table, state, E.rule_extractor, record).awaitTermination()
    got = spark.read.parquet(table)
    assert got.count() == 5 and {p.concept for p in got.first().phrases} >= {"extent_span", "margin_proximity"}


def test_paired_tests_of_millions_of_pairs(spark):
    """The variance of the rank sum is beyond a long, and the sign test takes no step per pair."""
    n = 2_000_000
    d = spark.range(n).selectExpr("'a' AS g", "0.0D AS x", "CASE WHEN id < 999000 THEN 1.0D ELSE -1.0D END AS y")
    r = H.paired(d, ["g"], "x", "y").first()
    # all differences tie: each rank is (n + 1) / 2
    var = n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48
    assert r.z_wilcoxon == pytest.approx((999_000 * (n + 1) / 2 - n * (n + 1) / 4) / math.sqrt(var))
    assert r.p_sign == pytest.approx(H.normal_two_sided((2000 - 1) / math.sqrt(n)), rel=1e-3)
    for k, n in ((0, 5), (3, 6), (2, 7), (40, 100), (700, 1501)):
        exact = Fraction(2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)), 2**n)
        assert H.binomial_two_sided(k, n) == pytest.approx(float(min(1, exact)), rel=1e-9)


def test_permuted_counts_equal_the_permuted_rows(spark, monkeypatch):
    """Also with ties, null groups, null scores, groups of one class and few rows; no row is copied into a shuffle."""
    rng = np.random.default_rng(2)
    rows = [(g, i, None if rng.random() < 0.1 else float(rng.integers(0, 6)), int(rng.random() < share)) for g, n, share in (("a", 700, 0.5), (None, 300, 0.02), ("one", 40, 1.1), ("none", 40, 0.0), ("few", 1, 1.1)) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, id long, s double, y long")
    each = d.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(4))))
    mixed = X.permuted(each, ["g", "replicate"], "id", "y", F.col("replicate"), "v")
    want = mixed.where("s IS NOT NULL").groupBy("g", "replicate", "s").agg(F.sum("v"), F.sum(1 - F.col("v"))).collect()
    monkeypatch.setattr(X, "placed", None)
    got = X.permuted_counts(d, ["g"], "id", "s", "y", 5).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key) and len({r.replicate for r in got}) == 5
