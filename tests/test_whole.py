"""Queries cover their whole tables, and models score every test row."""

import numpy as np
import pytest

from textcohort import plans
from textcohort.operators import models as B
from textcohort.plans.registry import Tables

from .conftest import DATA


@pytest.mark.parametrize("name,models", [("B01", 1), ("B03", 1), ("B04", 2), ("B05", 1), ("B06", 2), ("B07", 1), ("B08", 1), ("B09", 1), ("B10", 1)])
def test_every_test_row_is_scored(spark, name, models):
    n = Tables(spark, DATA).pred_v.where("role = 'test'").count()
    got = plans.QUERIES[name](spark, DATA)
    assert got.count() == models * n and got.dropna().count() == models * n


def test_tests_and_resamples_use_all_rows(spark):
    pairs, pred = Tables(spark, DATA).pairs_v, Tables(spark, DATA).pred_v
    assert plans.QUERIES["H08p"](spark, DATA).selectExpr("sum(a + b + c + d)").first()[0] == pairs.count()
    assert plans.QUERIES["X11"](spark, DATA).count() == pairs.count()
    p = plans.QUERIES["X10"](spark, DATA).toPandas()
    assert len(p) == pred.select("dataset_key", "model_key").distinct().count() and p.p.between(1 / 51, 1).all()
    difference = pairs.groupBy("g").agg({"x": "count"}).join(plans.QUERIES["X09"](spark, DATA), "g").toPandas()
    whole = pairs.groupBy("g").pivot("bx", [0, 1]).avg("x").toPandas().set_index("g")
    spread = pairs.groupBy("g").agg({"x": "stddev"}).toPandas().set_index("g").iloc[:, 0]
    for r in difference.itertuples():
        assert r.difference_ci_low < whole.loc[r.g, "1"] - whole.loc[r.g, "0"] < r.difference_ci_high
        # an interval of all rows is about 8 standard deviations / sqrt(rows) wide, one of a twentieth 4.5 times as much
        assert r.difference_ci_high - r.difference_ci_low < 12 * spread[r.g] / np.sqrt(r._2)


def test_scores_in_spark_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, "train" if i % 3 else "test", float(rng.integers(0, 2)), *[None if rng.random() < 0.1 else float(v) for v in rng.normal(size=2)], 1.0) for g in ("p", "q", None) for i in range(60)]
    rows += [("new", 1, "test", 1.0, 0.5, 0.5, 1.0), ("one", 1, "train", 1.0, 0.5, 0.5, 1.0), ("one", 2, "train", 1.0, 0.1, 0.5, 1.0), ("one", 3, "test", 1.0, 0.5, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, row_id long, role string, target double, a double, b double, c double")
    names = ["ridge_logistic", "linear_svm", "ridge"]
    got = {(r.g, r.row_id, r.model): r for r in B.predictions(df, ["g"], ["a", "b", "c"], names).collect()}
    assert len(got) == 3 * (60 + 2) and {got["new", 1, m].status for m in names} == {"empty"} and got["one", 3, "ridge"].y_pred is None
    assert got["one", 3, "linear_svm"].status == "one class"
    for g in ("p", None):
        x = {role: np.array([r[4:7] for r in rows if r[0] == g and r[2] == role], float) for role in ("train", "test")}
        y, ids = np.array([r[3] for r in rows if r[0] == g and r[2] == "train"]), [r[1] for r in rows if r[0] == g and r[2] == "test"]
        for m in names:
            p, w, b, _ = B.fit_best(m, x["train"], y)
            want = p(x["test"]) @ w + b
            if m != "ridge":
                slope, offset = B.platt(p(x["train"]) @ w + b, y) if m == "linear_svm" else (1.0, 0.0)
                want = B.sigmoid(slope * want + offset)
            assert np.allclose([got[g, i, m].y_pred for i in ids], want)
    few = B.coefficients(df, ["g"], ["a", "b", "c"], ["ridge_logistic"])
    assert few.count() == 9
