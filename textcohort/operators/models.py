"""Small linear models, one per (split, dataset, model) group, fanned out as rows.

Groups are fitted side by side by numpy inside `applyInPandas`, each on all of its training rows,
which one task holds.  Test rows aren't gathered: Spark scores each one with its group's model.
`gram_ridge` fits from sums of products that Spark adds up and so takes any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = 1e-12


class Prepare:
    """Median imputation, low-information filter and standardisation, learned from training rows."""

    def __init__(self, x: np.ndarray):
        self.median = np.nan_to_num(np.nanmedian(np.where(np.isfinite(x), x, np.nan), axis=0)) if len(x) else np.zeros(x.shape[1])
        seen = np.isfinite(x).sum(0)
        filled = self._fill(x)
        distinct = np.array([len(np.unique(c)) for c in filled.T]) if len(x) else np.zeros(x.shape[1])
        keep = (seen >= 2) & ((filled != 0).sum(0) >= 1) & (distinct >= 2)
        self.keep = keep if keep.any() else np.ones(x.shape[1], bool)
        kept = filled[:, self.keep]
        self.mean, sd = kept.mean(0), kept.std(0)
        self.sd = np.where(sd > ZERO, sd, 1.0)

    def _fill(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(x), x, self.median)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self._fill(x)[:, self.keep] - self.mean) / self.sd

    def widen(self, coef: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.keep))
        out[self.keep] = coef
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray | float]:
    """Least squares with a squared penalty; y may have several columns, solved together."""
    mx, my = x.mean(0), y.mean(0)
    a = x - mx
    w = np.linalg.solve(a.T @ a + alpha * np.eye(x.shape[1]), a.T @ (y - my))
    return w, my - mx @ w


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, l1: float = 0.0, balanced: bool = True, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression with an elastic-net penalty: Newton's method, or proximal steps if there is an absolute part."""
    n, p = x.shape
    weight = np.where(y == 1, n / (2 * max(y.sum(), 1)), n / (2 * max((1 - y).sum(), 1))) if balanced else np.ones(n)
    w, b = np.zeros(p), 0.0
    if l1 == 0:
        a = np.column_stack([x, np.ones(n)])
        penalty = np.append(np.full(p, 1 / c), 0.0)
        theta = np.zeros(p + 1)
        for _ in range(min(steps, 60)):
            q = sigmoid(a @ theta)
            grad = a.T @ (weight * (q - y)) + penalty * theta
            hess = (a * (weight * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ a + np.diag(penalty + 1e-9)
            step = np.linalg.solve(hess, grad)
            theta -= step * min(1.0, 10 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        return theta[:-1], float(theta[-1])
    size = 1 / (0.25 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + weight.sum() / 4 + (1 - l1) / c)
    for _ in range(steps * 10):
        q = weight * (sigmoid(x @ w + b) - y)
        new = w - size * (x.T @ q + (1 - l1) / c * w)
        new = np.sign(new) * np.maximum(np.abs(new) - size * l1 / c, 0)
        b -= size * q.sum()
        moved, w = np.abs(new - w).max(initial=0), new
        if moved < 1e-8:
            break
    return w, float(b)


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 0.1, l1: float = 0.5, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Coordinate descent on mean squares / 2 + alpha (l1 |w| + (1 - l1) w2 / 2)."""
    n, p = x.shape
    mx, my = x.mean(0), float(y.mean())
    a, w = x - mx, np.zeros(p)
    left, norm = y - my, (a * a).sum(0) / n
    for _ in range(steps):
        worst = 0.0
        for j in range(p):
            rho = a[:, j] @ left / n + norm[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (norm[j] + alpha * (1 - l1) + ZERO)
            if new != w[j]:
                left -= a[:, j] * (new - w[j])
                worst, w[j] = max(worst, abs(new - w[j])), new
        if worst < 1e-8:
            break
    return w, my - float(mx @ w)


def pls(x: np.ndarray, y: np.ndarray, parts: int = 2) -> tuple[np.ndarray, float]:
    """Partial least squares with one target, by successive deflation."""
    mx, my = x.mean(0), float(y.mean())
    a, t, weights, loads, inner = x - mx, y - my, [], [], []
    for _ in range(max(1, min(parts, x.shape[1], len(x) - 1))):
        w = a.T @ t
        size = np.linalg.norm(w)
        if size < 1e-10:
            break
        w /= size
        s = a @ w
        ss = float(s @ s)
        if ss < ZERO:
            break
        load, q = a.T @ s / ss, float(t @ s / ss)
        a, t = a - np.outer(s, load), t - q * s
        weights.append(w)
        loads.append(load)
        inner.append(q)
    if not weights:
        return np.zeros(x.shape[1]), my
    w, load = np.array(weights).T, np.array(loads).T
    coef = w @ np.linalg.solve(load.T @ w, np.array(inner))
    return coef, my - float(mx @ coef)


def huber(x: np.ndarray, y: np.ndarray, eps: float = 1.35, alpha: float = 1e-4) -> tuple[np.ndarray, float]:
    """Huber regression by reweighted ridge with a robust scale."""
    w, b = ridge(x, y, max(alpha, 1e-6))
    for _ in range(100):
        left = y - x @ w - b
        scale = max(np.median(np.abs(left - np.median(left))) / 0.6745, 1e-9)
        weight = np.minimum(1.0, eps * scale / np.maximum(np.abs(left), ZERO))
        m = weight.sum()
        mx, my = weight @ x / m, weight @ y / m
        a = x - mx
        new = np.linalg.solve((a * weight[:, None]).T @ a + max(alpha, 1e-6) * np.eye(x.shape[1]), (a * weight[:, None]).T @ (y - my))
        moved, w, b = np.abs(new - w).max(initial=0), new, my - mx @ new
        if moved < 1e-9:
            break
    return w, float(b)


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, balanced: bool = True, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear classifier with squared hinge loss, by Newton steps on the rows inside the margin."""
    n, p = x.shape
    sign = 2 * y - 1
    weight = c * (np.where(y == 1, n / (2 * max(y.sum(), 1)), n / (2 * max((1 - y).sum(), 1))) if balanced else np.ones(n))
    a = np.column_stack([x, np.ones(n)])
    theta, penalty = np.zeros(p + 1), np.append(np.ones(p), 1e-3)
    for _ in range(min(steps, 100)):
        gap = np.maximum(1 - sign * (a @ theta), 0)
        on = gap > 0
        grad = penalty * theta - 2 * a.T @ (weight * sign * gap)
        hess = np.diag(penalty) + 2 * (a[on] * weight[on, None]).T @ a[on]
        step = np.linalg.solve(hess, grad)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return theta[:-1], float(theta[-1])


def svr(x: np.ndarray, y: np.ndarray, c: float = 1.0, eps: float = 0.0, steps: int = 100) -> tuple[np.ndarray, float]:
    """Linear regression with squared loss outside a tube, by Newton steps on the rows outside."""
    a = np.column_stack([x, np.ones(len(x))])
    theta, penalty = np.append(np.zeros(x.shape[1]), y.mean()), np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(steps):
        left = a @ theta - y
        out = np.abs(left) > eps
        grad = penalty * theta + 2 * c * a[out].T @ (left[out] - eps * np.sign(left[out]))
        step = np.linalg.solve(np.diag(penalty) + 2 * c * a[out].T @ a[out], grad)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return theta[:-1], float(theta[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into probabilities."""
    w, b = logistic(margin[:, None], y, 1e6, balanced=False)
    return float(w[0]), b


def calibration(y: np.ndarray, prob: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the truth on the probability's log-odds; NaN with one class."""
    if len(np.unique(y)) < 2:
        return float("nan"), float("nan")
    p = np.clip(prob, 1e-6, 1 - 1e-6)
    w, b = logistic(np.log(p / (1 - p))[:, None], y, 1e6, balanced=False)
    return b, float(w[0])


#: Model key: task, fit(x, y, parameter), grid.
MODELS: dict[str, tuple[str, Callable, list[float]]] = {
    "ridge_logistic": ("class", lambda x, y, c: logistic(x, y, c), [0.01, 0.1, 1.0, 10.0]),
    "elastic_net_logistic": ("class", lambda x, y, c: logistic(x, y, c, 0.5), [0.1, 1.0]),
    "linear_svm": ("class", lambda x, y, c: svm(x, y, c), [0.01, 0.1, 1.0]),
    "ridge": ("value", lambda x, y, a: ridge(x, y, a), [0.1, 1.0, 10.0, 100.0]),
    "elastic_net": ("value", lambda x, y, a: elastic_net(x, y, a), [0.01, 0.1, 1.0]),
    "pls_regression": ("value", lambda x, y, k: pls(x, y, int(k)), [1, 2, 3, 5]),
    "linear_svr": ("value", lambda x, y, c: svr(x, y, c), [0.01, 0.1, 1.0]),
    "huber": ("value", lambda x, y, a: huber(x, y, alpha=a), [1e-4, 1e-2]),
}


def folds(y: np.ndarray, task: str, most: int = 5) -> np.ndarray:
    """Inner folds, stratified for classes; fewer where the rarer class or the rows are few."""
    if task == "class":
        k = int(min(most, max(2, min(y.sum(), len(y) - y.sum()))))
        out = np.zeros(len(y), int)
        for c in (0, 1):
            where = np.flatnonzero(y == c)
            out[where] = np.arange(len(where)) % k
        return out
    return np.arange(len(y)) % max(2, min(most, len(y)))


def _loss(task: str, y: np.ndarray, score: np.ndarray) -> float:
    if task == "value":
        return float(np.mean((y - score) ** 2))
    pos, neg = score[y == 1], score[y == 0]
    if not len(pos) or not len(neg):
        return 0.0
    rank = pd.Series(np.concatenate([pos, neg])).rank().to_numpy()
    return 1 - (rank[: len(pos)].sum() - len(pos) * (len(pos) + 1) / 2) / (len(pos) * len(neg))


def skip_reason(y: np.ndarray, task: str) -> str | None:
    if not len(y):
        return "empty"
    if task == "class":
        k = min(y.sum(), len(y) - y.sum())
        return "one class" if k == 0 else "rare class" if k < 2 else None
    return "few rows" if len(y) < 3 else "constant" if np.ptp(y) == 0 else None


def fit_best(model: str, x: np.ndarray, y: np.ndarray) -> tuple[Prepare, np.ndarray, float, float]:
    """Preparation, coefficients, intercept and chosen parameter after an inner grid search."""
    task, fit, grid = MODELS[model]
    fold = folds(y, task)

    def loss(g: float) -> float:
        out = []
        for k in np.unique(fold):
            a, b = fold != k, fold == k
            if skip_reason(y[a], task):
                continue
            p = Prepare(x[a])
            w, c = fit(p(x[a]), y[a], g)
            out.append(_loss(task, y[b], p(x[b]) @ w + c))
        return float(np.mean(out)) if out else 0.0

    best = min(grid, key=lambda g: (loss(g), grid.index(g)))
    p = Prepare(x)
    w, b = fit(p(x), y, best)
    return p, w, float(b), float(best)


LINEAR = "model string, status string, median array<double>, mean array<double>, sd array<double>, weight array<double>, intercept double, slope double, offset double"
COEFFICIENTS = "model string, feature string, coefficient double, parameter double"


def _linear(model: str, status: str, p: Prepare | None = None, w: np.ndarray | None = None, b: float = 0.0, slope: float = 1.0, offset: float = 0.0) -> dict:
    """A row of LINEAR: what Spark needs to score rows; weights of filtered features are 0."""
    if p is None:
        return dict.fromkeys(("median", "mean", "sd", "weight"), None) | {"model": model, "status": status, "intercept": None, "slope": None, "offset": None}
    mean, sd = np.zeros(len(p.keep)), np.ones(len(p.keep))
    mean[p.keep], sd[p.keep] = p.mean, p.sd
    return {"model": model, "status": status, "median": p.median.tolist(), "mean": mean.tolist(), "sd": sd.tolist(), "weight": p.widen(w).tolist(), "intercept": float(b), "slope": float(slope), "offset": float(offset)}


def _training(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.where((F.col("role") == "train") & F.col("target").isNotNull() & ~F.isnan("target")).select(*dict.fromkeys([*by, "row_id", "target", *columns]))


def _fitted(df: DataFrame, by: list[str], columns: list[str], fit: Callable[[pd.DataFrame], list[dict]], schema: str) -> DataFrame:
    """The rows that fit makes of each group's training rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pd.DataFrame(fit(pdf.sort_values("row_id")), columns=names)
        for k in by:
            got[k] = pdf[k].iloc[0]
        return got

    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    return _training(df, by, columns).groupBy(*by).applyInPandas(run, f"{schema}, {keys}")


def _margin(features: list[str], weight: str, intercept: str) -> Column:
    out = F.col(intercept)
    for j in range(len(features)):
        x = F.col(f"__x{j}")
        filled = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.col("median")[j]).otherwise(x)
        out = out + F.col(weight)[j] * ((filled - F.col("mean")[j]) / F.col("sd")[j])
    return out


def _tested(df: DataFrame, by: list[str], features: list[str], models: list[str], fits: DataFrame, keep: list[Column]) -> DataFrame:
    """Each test row with each model's row of LINEAR, status `empty` where the group has no training rows."""
    test = df.where("role = 'test'").select(*(F.col(k).alias(f"__by{i}") for i, k in enumerate(by)), *keep, *(F.col(f).cast("double").alias(f"__x{j}") for j, f in enumerate(features)), F.explode(F.array(*map(F.lit, models))).alias("__model"))
    on = F.col("__model") == F.col("model")
    for i, k in enumerate(by):
        on &= F.col(f"__by{i}").eqNullSafe(F.col(k))
    joined = test.join(fits, on, "left").drop("model", *by).withColumnsRenamed({"__model": "model"} | {f"__by{i}": k for i, k in enumerate(by)})
    return joined.withColumn("status", F.coalesce("status", F.lit("empty")))


def predictions(df: DataFrame, by: list[str], features: list[str], models: list[str]) -> DataFrame:
    """Predictions of every model for every test row of every group; columns row_id, role, target and features."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        x, y, out = pdf[features].to_numpy(float), pdf.target.to_numpy(float), []
        for m in models:
            if why := skip_reason(y, MODELS[m][0]):
                out.append(_linear(m, why))
                continue
            p, w, b, _ = fit_best(m, x, y)
            out.append(_linear(m, "fit", p, w, b, *(platt(p(x) @ w + b, y) if m == "linear_svm" else (1.0, 0.0))))
        return out

    got = _tested(df, by, features, models, _fitted(df, by, features, fit, LINEAR), [F.col("row_id").cast("long").alias("row_id"), F.col("target").cast("double").alias("y_true")])
    margin = _margin(features, "weight", "intercept")
    z = F.least(F.greatest(F.col("slope") * margin + F.col("offset"), F.lit(-35.0)), F.lit(35.0))
    score = F.when(F.col("model").isin([m for m in models if MODELS[m][0] == "class"]), 1 / (1 + F.exp(-z))).otherwise(margin)
    return got.select("row_id", "model", "status", "y_true", score.alias("y_pred"), *by)


def coefficients(df: DataFrame, by: list[str], features: list[str], models: list[str]) -> DataFrame:
    """Coefficients of the standardised features, 0 for features that were filtered out."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        x, y, out = pdf[features].to_numpy(float), pdf.target.to_numpy(float), []
        for m in models:
            if not skip_reason(y, MODELS[m][0]):
                p, w, _, g = fit_best(m, x, y)
                out += [{"model": m, "feature": f, "coefficient": c, "parameter": g} for f, c in zip(features, p.widen(w).tolist(), strict=True)]
        return out

    return _fitted(df, by, features, fit, COEFFICIENTS)


def teacher_student(df: DataFrame, by: list[str], teacher: list[str], student: list[str], cut: float) -> DataFrame:
    """A student on its own features learns the target and an out-of-fold teacher score together.

    Rows: row_id, score, label (score at least `cut`), relapse_score; the last one is linear and
    no probability.  Errors aren't swallowed.
    """

    def fit(train: pd.DataFrame) -> list[dict]:
        y, xt, xs = train.target.to_numpy(float), train[teacher].to_numpy(float), train[student].to_numpy(float)
        if why := skip_reason(y, "value"):
            return [_linear("score", why)]
        fold, oof = folds(y, "value"), np.zeros(len(y))
        for k in np.unique(fold):
            p = Prepare(xt[fold != k])
            w, b = ridge(p(xt[fold != k]), y[fold != k])
            oof[fold == k] = p(xt[fold == k]) @ w + b
        p = Prepare(xs)
        w, b = ridge(p(xs), np.column_stack([y, oof]))
        out = _linear("score", "fit", p, w.mean(1), b.mean())
        known = train.relapse.notna().to_numpy()
        if known.sum() >= 3:
            wr, br = ridge(p(xs)[known], train.relapse.to_numpy(float)[known])
            out |= {"relapse_weight": p.widen(wr).tolist(), "relapse_intercept": float(br)}
        return [out]

    fits = _fitted(df, by, ["relapse", *teacher, *student], fit, f"{LINEAR}, relapse_weight array<double>, relapse_intercept double")
    got = _tested(df, by, student, ["score"], fits, [F.col("row_id").cast("long").alias("row_id")])
    score = _margin(student, "weight", "intercept")
    return got.select("row_id", score.alias("score"), (score >= cut).cast("int").alias("label"), _margin(student, "relapse_weight", "relapse_intercept").alias("relapse_score"), *by)


def calibrated(df: DataFrame, by: list[str], truth: str, prob: str, digits: int = 4) -> DataFrame:
    """Calibration intercept and slope per group, fitted on counts of rounded probabilities."""
    counted = df.where(F.col(truth).isNotNull() & F.col(prob).isNotNull()).groupBy(*by, F.round(prob, digits).alias("p")).agg(F.sum(truth).cast("double").alias("k"), F.count("*").cast("double").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.clip(pdf.p.to_numpy(float), 1e-6, 1 - 1e-6)
        z, k, n = np.log(q / (1 - q)), pdf.k.to_numpy(), pdf.n.to_numpy()
        theta = np.zeros(2)
        out = {c: pdf[c].iloc[0] for c in by}
        if 0 < k.sum() < n.sum():
            a = np.column_stack([np.ones(len(z)), z])
            for _ in range(100):
                s = sigmoid(a @ theta)
                step = np.linalg.solve((a * (n * np.maximum(s * (1 - s), 1e-12))[:, None]).T @ a + np.diag([1e-9, 1e-6]), a.T @ (k - n * s) - np.array([0.0, 1e-6]) * theta)
                theta += step
                if np.abs(step).max() < 1e-10:
                    break
        else:
            theta[:] = np.nan
        return pd.DataFrame([out | {"intercept": theta[0], "slope": theta[1]}])

    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return counted.groupBy(*by).applyInPandas(run, f"{keys}, intercept double, slope double")


def gram_ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge coefficients from sums of products: one aggregate over any number of rows, p x p numbers to the driver."""
    cols = [*features, target]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    got = df.dropna(subset=cols).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)), *(F.sum(F.col(a) * F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first()
    n, s = got["n"], np.array([got[f"s{i}"] for i in range(len(cols))])
    g = np.zeros((len(cols), len(cols)))
    for i, (a, b) in enumerate(pairs):
        g[cols.index(a), cols.index(b)] = g[cols.index(b), cols.index(a)] = got[f"p{i}"]
    c = g - np.outer(s, s) / n
    w = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(len(features)), c[:-1, -1])
    return w, float(s[-1] / n - s[:-1] @ w / n)
