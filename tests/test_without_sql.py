"""Each registered query that SQL can't express, against an independent computation of its whole result."""

import ast
import difflib
import json
import math
import re
import unicodedata
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textcohort import plans
from textcohort.functions import constants as C
from textcohort.operators import models as B
from textcohort.operators import split as X
from textcohort.plans import analysis, operations
from textcohort.plans.registry import Tables

from .conftest import DATA


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DATA)


@pytest.fixture(scope="module")
def pred(t):
    return t.pred_v.toPandas()


@pytest.fixture(scope="module")
def pairs(t):
    return t.pairs_v.toPandas()


def run(t, name):
    return plans.QUERIES[name](t.spark, DATA).toPandas()


def test_every_query_without_sql_is_tested_here_or_with_the_models():
    """Models B01-B10 are also compared row by row in test_whole."""
    here = open(__file__).read()
    for name in set(plans.QUERIES) - set(plans.ORACLES):
        assert re.search(rf'["_]{name.lower()}["_(]|"{name}"', here), name


# ----- texts


def straight(text):
    text = unicodedata.normalize("NFKC", text or "")
    for a, b in zip("‘’“”–— ", "''\"\"-- ", strict=True):
        text = text.replace(a, b)
    return re.sub(r"\s+", " ", text.lower()).strip()


def test_t06(t):
    want = {r.doc_id: straight(r.text) for r in t.documents.collect()}
    assert dict(zip(*run(t, "T06")[["doc_id", "folded"]].to_numpy().T, strict=True)) == want


def test_t09(t):
    want = {r.doc_id: sum(max(0, len((r.text or "").split()) - w + 1) for w in range(1, 15)) for r in t.documents.collect()}
    assert dict(zip(*run(t, "T09")[["doc_id", "n_windows"]].to_numpy().T, strict=True)) == want


def test_t10(t):
    """All candidates compared in full, for texts short enough for that."""
    got = dict(zip(*run(t, "T10")[["doc_id", "span"]].to_numpy().T, strict=True))
    rows = [r for r in t.documents.select("doc_id", "text").collect() if r.doc_id in got and len(r.text.split()) <= 45]
    assert len(rows) >= 5
    for r in rows:
        quote = "x" + re.search(r"(?:\S+\s+){3}((?:\S+\s+){5}\S+)", r.text)[1].replace("x", "y")
        want, bag = straight(quote), set(re.findall("[a-z0-9]+", straight(quote)))
        words = [m.span() for m in re.finditer(r"\S+", r.text)]
        n = len(quote.split())
        candidates = [*r.text.splitlines(), *re.split(r"(?<=[.!?])\s+", r.text)] + [r.text[words[i][0] : words[i + w - 1][1]] for w in range(max(1, n - 5), min(35, n + 8) + 1) for i in range(len(words) - w + 1)]
        best = 0.0
        scores = {}
        for c in filter(None, map(str.strip, candidates)):
            own = set(re.findall("[a-z0-9]+", straight(c)))
            jaccard = len(bag & own) / len(bag | own)
            if jaccard >= 0.55:
                scores[c] = 0.75 * difflib.SequenceMatcher(None, straight(c), want, autojunk=False).ratio() + 0.25 * jaccard
                best = max(best, scores[c])
        span = got[r.doc_id]
        assert span is None and best < 0.84 or span is not None and scores[span] == pytest.approx(best)


def test_t17(t):
    def parse(s):
        for read in (json.loads, ast.literal_eval):
            try:
                return {k: v if isinstance(v, str) else json.dumps(v) for k, v in read(s).items()}
            except (ValueError, SyntaxError):
                continue

    want = {r.event_id: parse(r.props) for r in t.events.collect()}
    got = run(t, "T17")
    assert len(got) == len(want) and all(dict(p or {}) == want[i] for i, p in zip(got.event_id, got.parsed, strict=True))


def test_q08(t):
    weight = {r.concept: r.normalized for r in plans.QUERIES["Q07"](t.spark, DATA).collect()}
    want = {(r.doc_id, w): weight[w] for r in t.documents.collect() for w in ("the", "que", "der") if w in r.text.lower()}
    got = run(t, "Q08")
    assert len(got) == len(want) > 100 and (got.status == 1).all()
    assert all(r.score == pytest.approx(want[r.doc_id, r.concept], abs=2e-6) for r in got.itertuples())


def test_q11(t):
    neg, unc = "|".join(C.NEGATION), "|".join(C.UNCERTAINTY)
    want = {}
    for r in t.documents.collect():
        quote = re.sub(r"\s+", " ", re.split(r"\.\s*|\n", r.text)[0]).strip()
        if r.doc_id % 11 == 0 or not quote:
            continue
        said = "negated" if r.doc_id % 3 == 0 or re.search(neg, quote.lower()) else "affirmed"
        sure = not (r.doc_id % 5 == 0 or re.search(unc, quote.lower()))
        said = "uncertain" if said == "affirmed" and not sure else said
        found = ["multiplicity"] + [k for k, (_, p) in C.ONTOLOGY.items() if k != "multiplicity" and any(re.search(x, f"{r.source} || {quote}".lower()) for x in p)]
        slug = re.sub("[^a-z0-9]+", "_", quote.lower()).strip("_")[:120] or "empty"
        for source in ["seed"] + ["denovo"] * (r.doc_id % 7 == 0):
            want[r.doc_id, source] = (slug, found[0], ";".join(found), int(said == "affirmed" and sure), int(said == "negated"), int(not sure or said == "uncertain"))
    got = {(r.doc_id, r.source): (r.slug.split("#")[0], r.canonical_group, r.mapped_concepts, r.is_affirmed, r.is_negated, r.is_uncertain) for r in run(t, "Q11").itertuples()}
    assert got == want


def test_e02(t):
    """The first sentence with a pattern of each concept."""
    want = {}
    for r in t.cases_v.collect():
        parts = [s for s in re.split(r"(?<=[.!?])\s+|\n+", r.text_b) if s.strip()]
        want[r.case_id] = sum(any(re.search("|".join(p), s.lower()) for s in parts) for _, p in C.ONTOLOGY.values())
    assert dict(zip(*run(t, "E02")[["case_id", "n_phrases"]].to_numpy().T, strict=True)) == want


# ----- tests


def tail(density, start):
    """Both tails of a symmetric density by Simpson's rule on a transformed axis."""
    u = np.linspace(0, 1, 200_001)[:-1]
    x = start + u / (1 - u)
    f = density(x) / (1 - u) ** 2
    return 2 * np.trapezoid(f, u)


def test_h01p(t, pairs):
    got = run(t, "H01p").set_index("g")
    for g, p in pairs.groupby("g"):
        d = (p.y - p.x).to_numpy()
        n = len(d)
        stat = d.mean() / d.std(ddof=1) * math.sqrt(n)
        const = math.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2)) / math.sqrt((n - 1) * math.pi)
        moved = d[d != 0]
        rank = pd.Series(abs(moved)).rank().to_numpy()
        m = len(moved)
        ties = pd.Series(abs(moved)).value_counts().to_numpy()
        z = (rank[moved > 0].sum() - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - (ties**3 - ties).sum() / 48)
        up, down = int((d > 0).sum()), int((d < 0).sum())
        sign = min(Fraction(1), Fraction(2 * sum(math.comb(up + down, i) for i in range(min(up, down) + 1)), 2 ** (up + down)))
        r = got.loc[g]
        assert r.t == pytest.approx(stat) and r.z_wilcoxon == pytest.approx(z)
        assert r.p_t == pytest.approx(tail(lambda x, n=n, c=const: c * (1 + x * x / (n - 1)) ** (-n / 2), abs(stat)), rel=1e-4, abs=1e-12)
        assert r.p_wilcoxon == pytest.approx(tail(lambda x: np.exp(-x * x / 2) / math.sqrt(2 * math.pi), abs(z)), rel=1e-4, abs=1e-12)
        assert r.p_sign == pytest.approx(float(sign), rel=1e-9)


def test_h02p(t, pairs):
    got = run(t, "H02p").set_index(["g", "s"])
    for k, p in pairs.groupby(["g", "s"]):
        b, c = int(((p.bx == 1) & (p.bz == 0)).sum()), int(((p.bx == 0) & (p.bz == 1)).sum())
        want = min(Fraction(1), Fraction(2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)), 2 ** (b + c)))
        assert (got.loc[k, "b"], got.loc[k, "c"]) == (b, c) and got.loc[k, "p"] == pytest.approx(float(want), rel=1e-9)


def test_h08p(t, pairs):
    got = run(t, "H08p").set_index("g")
    for g, p in pairs.groupby("g"):
        a, b, c, d = (int(((p.bx == i) & (p.bz == j)).sum()) for i, j in ((1, 1), (1, 0), (0, 1), (0, 0)))
        ways = {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        want = Fraction(sum(w for w in ways.values() if w <= ways[a]), sum(ways.values()))
        assert tuple(got.loc[g, list("abcd")]) == (a, b, c, d) and got.loc[g, "p_fisher"] == pytest.approx(float(want), rel=1e-6)


# ----- splits and resamples


def test_x01(t):
    """Test shares are exact in each class; roles are no function of the row order; seeds differ."""
    cases = analysis._cases(t).toPandas()
    got = run(t, "X01")
    assert len(got) == 3 * len(cases) and not got.duplicated(["case_id", "repeat"]).any()
    sets = []
    for _, g in got.groupby("repeat"):
        assert set(g.case_id) == set(cases.case_id)
        for y, part in g.groupby("y"):
            assert (part.role == "test").sum() == round(0.2 * (cases.y == y).sum())
        sets.append(frozenset(g.case_id[g.role == "test"]))
    assert len(set(sets)) == 3
    # the test cases of a class are those of least hash
    u = X.monte_carlo(analysis._cases(t), "case_id", "y", 3, 0.2, 17).withColumn("u", X.uniform(F.col("case_id"), F.col("repeat"), F.lit(17))).toPandas()
    for _, g in u.groupby(["repeat", "y"]):
        assert g.u[g.role == "test"].max() < g.u[g.role == "train"].min()
    again = X.monte_carlo(analysis._cases(t).repartition(3), "case_id", "y", 3, 0.2, 17).toPandas()
    key = ["case_id", "repeat", "role"]
    assert sorted(map(tuple, again[key].to_numpy())) == sorted(map(tuple, got[key].to_numpy()))


def test_x01k(t):
    cases, got = analysis._cases(t).toPandas(), run(t, "X01k")
    assert sorted(got.case_id) == sorted(cases.case_id) and set(got.fold) == set(range(5))
    size = got.groupby(["y", "fold"]).size().unstack()
    assert (size.max(axis=1) - size.min(axis=1) <= 1).all()


def test_x02(t):
    cases, got = analysis._cases(t).toPandas(), run(t, "X02")
    share = got.groupby("resample").case_id.nunique() / len(cases)
    assert len(share) == 25 and abs(share.mean() - 0.8) < 0.03 and share.between(0.65, 0.95).all() and not got.duplicated().any()
    few = t.spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    assert sorted(map(tuple, X.resamples(few, "case_id", 25, 0.8, 1).collect())) == [("a", 0), ("b", 0), ("c", 0)]


def test_x03(t):
    assert run(t, "X03").empty
    cases = t.spark.createDataFrame([(c,) for c in "abcd"], "case_id string")
    rows = [(0, c, "test" if c == "a" else "train") for c in "abcd"] + [(1, c, "train") for c in "abc"] + [(2, c, "train") for c in "abcd"] + [(2, "a", "test")]
    bad = X.violations(t.spark.createDataFrame(rows, "split int, case_id string, role string"), cases, "case_id").collect()
    assert sorted(map(tuple, bad)) == [(1, "incomplete"), (2, "overlap")]


def draws(t, rows, key, repeats, seed):
    """Rows x replicates of bootstrap weights."""
    w = X.poisson_bootstrap(rows.select(key), key, repeats, seed).toPandas().pivot_table(index=key, columns="replicate", values="weight", fill_value=0)
    assert abs(w.to_numpy().mean() - 1) < 0.02 and abs(w.to_numpy().var() - 1) < 0.05
    return w


@pytest.fixture(scope="module")
def replicates(t, pred):
    """Statistics of each model and replicate from the drawn weights, by numpy."""
    w = draws(t, t.pred_v, "row_id", 200, 42)
    out = {}
    for m, p in pred.groupby("model_key"):
        x = w.reindex(p.row_id).fillna(0).to_numpy()
        d = (p.y_value - p.y_true).abs().to_numpy()
        hit = ((p.y_prob >= 0.5).astype(int) == p.y_bin).to_numpy(float)
        out[m] = {"mae": d @ x / x.sum(0), "accuracy": hit @ x / x.sum(0), "rmse": np.sqrt(d**2 @ x / x.sum(0))}
    return out


def check_intervals(got, replicates, key, names, n):
    assert len(got) == len(replicates)
    for r in got.to_dict("records"):
        for v in names:
            low, high = np.percentile(replicates[r[key]][v][:n], [2.5, 97.5])
            assert r[f"{v}_ci_low"] == pytest.approx(low) and r[f"{v}_ci_high"] == pytest.approx(high)


@pytest.mark.parametrize("name,key,names,n", [("X06", "model_key", ["mae", "accuracy"], 200), ("X07", "config", ["mae", "rmse", "accuracy"], 200), ("X08", "model_key", ["mae", "rmse"], 200), ("X14", "model_key", ["accuracy"], 100)])
def test_bootstrap_intervals(t, pred, replicates, name, key, names, n):
    got = run(t, name)
    check_intervals(got, replicates, key, names, n)
    for r in got.to_dict("records") if name in ("X08", "X14") else []:
        p = pred[pred.model_key == r[key]]
        if name == "X08":
            d = p.y_value - p.y_true
            assert r["mae"] == pytest.approx(d.abs().mean()) and r["rmse"] == pytest.approx(math.sqrt((d**2).mean()))
        else:
            y = p.y_prob >= 0.5
            assert r["accuracy"] == pytest.approx((y == (p.y_bin == 1)).mean()) and r["f1"] == pytest.approx(2 * (y & (p.y_bin == 1)).sum() / (y.sum() + p.y_bin.sum()))


@pytest.mark.parametrize("name", ["X15", "K07"])
def test_interval_tables(t, replicates, name):
    got = run(t, name)
    assert len(got) == 2 * len(replicates) and (got.n == 100).all()
    for r in got.itertuples():
        assert [r.low, r.high] == pytest.approx(np.percentile(replicates[r.model_key][r.metric][:100], [2.5, 97.5]))


def test_x09(t, pairs):
    w = draws(t, t.pairs_v.select("id").distinct(), "id", 200, 5)
    for r in run(t, "X09").itertuples():
        p = pairs[pairs.g == r.g]
        x = w.reindex(p.id).fillna(0).to_numpy()
        mean = [(x[p.bx == k].T @ p.x[p.bx == k].to_numpy()) / x[p.bx == k].sum(0) for k in (0, 1)]
        assert [r.difference_ci_low, r.difference_ci_high] == pytest.approx(np.percentile(mean[1] - mean[0], [2.5, 97.5]))


def test_x13(t, pred):
    test = pred[pred.role == "test"]
    w = draws(t, t.pred_v.where("role = 'test'"), "row_id", 100, 9)
    for r in run(t, "X13").itertuples():
        p = test[test.model_key == r.model_key]
        x = w.reindex(p.row_id).fillna(0).to_numpy()
        agree = ((p.y_true >= 150000).astype(int) == p.y_bin).to_numpy(float)
        assert [r.mediated_ci_low, r.mediated_ci_high] == pytest.approx(np.percentile(agree @ x / x.sum(0), [2.5, 97.5]))


def auroc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()) if len(pos) and len(neg) else np.nan


def test_x10(t, pred):
    """Observed areas by counting pairs; p-values from the labels that the operator permuted, all of them."""
    by = ["dataset_key", "model_key"]
    each = t.pred_v.select(*by, "row_id", "y_prob", "y_bin").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(49))))
    mixed = X.permuted(each, [*by, "replicate"], "row_id", "y_bin", F.col("replicate"), "permuted").toPandas()
    assert len(mixed) == 50 * len(pred)
    null = {}
    for (d, m, _), g in mixed.groupby([*by, "replicate"]):
        assert sorted(g.permuted) == sorted(g.y_bin)
        null.setdefault((d, m), []).append(auroc(g.y_prob.to_numpy(), g.permuted.to_numpy()))
    for r in run(t, "X10").itertuples():
        p = pred[(pred.dataset_key == r.dataset_key) & (pred.model_key == r.model_key)]
        seen = auroc(p.y_prob.to_numpy(), p.y_bin.to_numpy())
        assert r.observed == pytest.approx(seen)
        assert r.p == pytest.approx((1 + sum(a >= r.observed - 1e-12 for a in null[r.dataset_key, r.model_key])) / 51, abs=1 / 51 + 1e-9)
    moved = mixed[mixed.y_bin != mixed.permuted].shape[0] / len(mixed)
    share = pred.y_bin.mean()
    assert abs(moved - 2 * share * (1 - share)) < 0.05


def test_x11(t, pairs):
    got = run(t, "X11")
    assert len(got) == len(pairs)
    for g, p in got.groupby("g"):
        assert sorted(p.x_shuffled) == sorted(p.x) == sorted(pairs.x[pairs.g == g])
        assert abs(np.corrcoef(p.x, p.x_shuffled)[0, 1]) < 0.1
    assert sorted(got.id) == sorted(pairs.id)


# ----- models


def test_m12(t, pred):
    """Logistic regression of the truth on the log-odds by plain gradient steps on all rows."""
    got = run(t, "M12").set_index("model_key")
    for m, p in pred.groupby("model_key"):
        q = np.clip(p.y_prob.round(4), 1e-6, 1 - 1e-6).to_numpy()
        z, y = np.log(q / (1 - q)), p.y_bin.to_numpy(float)
        a, b = got.loc[m, "intercept"], got.loc[m, "slope"]
        gap = y - 1 / (1 + np.exp(-(a + b * z)))
        assert abs(gap.mean()) < 1e-6 and abs((gap * z).mean()) < 1e-6  # the score equations hold


def cohort(t, target):
    return operations._cohort(t, target).toPandas()


def prepared(train, test):
    """Median, mean and deviation of the training rows, by hand."""
    x, z = train[operations.FEATURES].to_numpy(float), test[operations.FEATURES].to_numpy(float)
    m, s = x.mean(0), x.std(0)
    return (x - m) / s, (z - m) / s


def test_b01_b03_b04_b05_b06_b07_b08_b09(t):
    """Ridge by its normal equations; the others by what their objectives ask of the scores they give."""
    assert {"B01", "B03", "B04", "B05", "B06", "B07", "B08", "B09"} <= set(plans.QUERIES)
    value, label = cohort(t, "y_value"), cohort(t, "y_bin")
    scores = {n: run(t, n) for n in ("B01", "B03", "B04", "B05", "B06", "B07", "B08", "B09")}
    for split, d in value.groupby("split"):
        train, test = d[d.role == "train"], d[d.role == "test"].set_index("row_id")
        x, z = prepared(train, test)
        y = train.target.to_numpy()
        fits = []
        for alpha in (0.1, 1.0, 10.0, 100.0):
            w = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ (y - y.mean()))
            fits.append(z @ w + y.mean())
        flat = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
        ols = z @ flat[:-1] + flat[-1]
        for name in ("B01", "B06", "B07", "B08", "B09"):
            for model, g in scores[name][scores[name].split == split].groupby("model"):
                own = g.set_index("row_id").y_pred.loc[test.index].to_numpy()
                if model == "ridge":
                    assert min(np.abs(own - f).max() for f in fits) < 1e-6 * np.abs(y).max()
                assert np.corrcoef(own, ols)[0, 1] > 0.98, (name, model)
                truth = test.target.to_numpy()
                assert np.mean((own - truth) ** 2) < 1.1 * np.mean((ols - truth) ** 2), (name, model)
    for split, d in label.groupby("split"):
        train, test = d[d.role == "train"], d[d.role == "test"].set_index("row_id")
        x, z = prepared(train, test)
        for name in ("B03", "B04", "B05"):
            for model, g in scores[name][scores[name].split == split].groupby("model"):
                own = g.set_index("row_id").y_pred.loc[test.index].to_numpy()
                assert ((own >= 0) & (own <= 1)).all()
                # a linear model: its log-odds are an exact linear function of the features
                odds = np.log(np.clip(own, 1e-12, 1 - 1e-12) / np.clip(1 - own, 1e-12, 1))
                a = np.column_stack([z, np.ones(len(z))])
                assert np.abs(odds - a @ np.linalg.lstsq(a, odds, rcond=None)[0]).max() < 1e-4, (name, model)


def test_b10(t):
    """The student by its normal equations, with the teacher's out-of-fold scores as a second target."""
    d = cohort(t, "y_value")
    got = run(t, "B10").set_index("row_id")
    for _, p in d.groupby("split"):
        train, test = p[p.role == "train"].sort_values("row_id"), p[p.role == "test"]
        own = got.loc[test.row_id]
        x, z = train[["site", "parity"]].to_numpy(float), test[["site", "parity"]].to_numpy(float)
        m, s = x.mean(0), x.std(0)
        a = np.column_stack([(z - m) / s, np.ones(len(z))])
        for score in (own.score, own.relapse_score):
            assert np.abs(score - a @ np.linalg.lstsq(a, score, rcond=None)[0]).max() < 1e-6 * max(1, np.abs(score).max())
        r = np.linalg.solve(((x - m) / s).T @ ((x - m) / s) + np.eye(2), ((x - m) / s).T @ (train.relapse - train.relapse.mean()))
        assert np.allclose(own.relapse_score, (z - m) / s @ r + train.relapse.mean(), atol=1e-8)
        assert ((own.score >= 85) == (own.label == 1)).all()


def test_b11(t):
    """Coefficients times prepared features give the scores of B01 and B06 up to their intercept."""
    coef = run(t, "B11")
    d = cohort(t, "y_value")
    scores = pd.concat([run(t, "B01"), run(t, "B06"), run(t, "B07")]).drop_duplicates(["split", "row_id", "model"])
    for (split, model), c in coef.groupby(["split", "model"]):
        p = d[d.split == split]
        _, z = prepared(p[p.role == "train"], p[p.role == "test"])
        own = scores[(scores.split == split) & (scores.model == model)].set_index("row_id").y_pred.loc[p.row_id[p.role == "test"]].to_numpy()
        rest = own - z @ c.set_index("feature").coefficient.loc[operations.FEATURES].to_numpy()
        assert np.ptp(rest) < 1e-6 * np.abs(own).max(), model
    assert B.MODELS.keys() >= set(coef.model)
