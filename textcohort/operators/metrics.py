"""Evaluation metrics as grouped aggregates over truth, score and prediction columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import average_rank, threshold_table

EPS = 1e-12


def finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    return df.where(ok(x) & ok(y))


def safe_corr(x: str, y: str, least: int = 3) -> Column:
    """Correlation as an aggregate; null below `least` rows or if a side is constant."""
    varied = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when((F.count("*") >= least) & varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def regression(df: DataFrame, by: list[str], truth: str, pred: str, least: int = 3) -> DataFrame:
    """n, mae, rmse, r2, pearson_r, spearman_rho per group."""
    pairs = finite_pairs(df, truth, pred)
    ranked = average_rank(average_rank(pairs, by, truth, "__rt"), by, pred, "__rp")
    d = F.col(pred) - F.col(truth)
    spread = F.var_pop(truth) * F.count("*")
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.when(spread > 0, 1 - F.sum(d * d) / spread).alias("r2"),
        safe_corr(truth, pred, least).alias("pearson_r"),
        safe_corr("__rt", "__rp", least).alias("spearman_rho"),
    )


def confusion(truth: str, pred: str) -> dict[str, Column]:
    hit = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    return {"tp": hit(1, 1), "fp": hit(0, 1), "fn": hit(1, 0), "tn": hit(0, 0)}


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy to negative predictive value from the four counts; null where undefined, F1 then 0."""
    part = lambda a, b: F.try_divide(a, b)
    sens, spec = part(tp, tp + fn), part(tn, tn + fp)
    return {
        "accuracy": part(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": (sens + spec) / 2,
        "f1": F.coalesce(part(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        "ppv": part(tp, tp + fp),
        "sensitivity": sens,
        "specificity": spec,
        "npv": part(tn, tn + fn),
    }


def binary_labels(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """Counts and rates per group."""
    counted = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(*(c.alias(k) for k, c in confusion(truth, pred).items()))
    return counted.withColumns(rates(*(F.col(k) for k in ("tp", "fp", "fn", "tn"))))


def auroc_auprc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under ROC with tied scores averaged, and average precision as a step sum; null with one class."""
    return areas(threshold_table(df, by, score, label), by)


def areas(t: DataFrame, by: list[str]) -> DataFrame:
    """The same from positives and negatives, each and so far, per distinct score."""
    area = F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp")) + 0.5 * F.col("pos") * F.col("neg"))
    step = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    got = t.groupBy(*by).agg(F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"), area.alias("a"), step.alias("s"))
    two = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return got.select(*by, "n_pos", "n_neg", F.when(two, F.col("a") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"), F.when(two, F.col("s") / F.col("n_pos")).alias("auprc"))


def best_f1(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Threshold of the greatest F1 for score >= threshold, the least such threshold on ties."""
    t = threshold_table(df, by, score, label).withColumn("f1", 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos")))
    return t.groupBy(*by).agg(F.max(F.struct("f1", (-F.col(score)).alias("t"))).alias("b")).select(*by, F.col("b.f1").alias("best_f1"), (-F.col("b.t")).alias("threshold"))


def classification(df: DataFrame, by: list[str], truth: str, prob: str, cut: float = 0.5) -> DataFrame:
    """Prevalence, no-skill level, positive rate, AUROC, AP, Brier score, counts and rates."""
    p = F.least(F.greatest(F.col(prob), F.lit(0.0)), F.lit(1.0))
    d = df.where(F.col(truth).isNotNull() & F.col(prob).isNotNull()).withColumns({"__p": p, "__y": (p >= cut).cast("long")})
    plain = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(truth).alias("prevalence"), F.avg("__y").alias("positive_rate"), F.avg((F.col("__p") - F.col(truth)) ** 2).alias("brier"), *(c.alias(k) for k, c in confusion(truth, "__y").items())
    )
    areas = auroc_auprc(d, by, "__p", truth).drop("n_pos", "n_neg")
    out = plain.withColumns(rates(*(F.col(k) for k in ("tp", "fp", "fn", "tn")))).withColumn("no_skill_auprc", F.col("prevalence"))
    return out.join(areas, by) if by else out.crossJoin(areas)


def calibration_curve(df: DataFrame, by: list[str], truth: str, prob: str, bins: int = 5) -> DataFrame:
    """Mean probability, observed rate and size of equal-width bins closed on the right."""
    b = F.greatest(F.ceil(F.col(prob) * bins), F.lit(1)).cast("long")
    return df.groupBy(*by, b.alias("bin")).agg(F.avg(prob).alias("mean_prob"), F.avg(truth).alias("observed"), F.count("*").alias("n"))


def curve_points(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    t = threshold_table(df, by, score, label)
    return t.select(*by, F.col(score).alias("threshold"), F.try_divide("fp", "n_neg").alias("fpr"), F.try_divide("tp", "n_pos").alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows: column, n_missing, n_rows; one pass over the table."""
    got = df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return got.unpivot("n_rows", columns, "column", "n_missing")


def pooled(df: DataFrame, keys: list[str], values: list[str], truths: list[str], split: str = "split_id") -> DataFrame:
    """Repeated held-out predictions of a case: mean values, a truth, and the sorted splits."""
    return df.groupBy(*keys).agg(
        *(F.avg(v).alias(v) for v in values),
        *(F.max(c).alias(c) for c in truths),
        F.array_join(F.sort_array(F.collect_set(F.col(split).cast("string"))), ";").alias("split_ids"),
        F.count("*").alias("n_predictions"),
    )


#: Metric families by name: the package's extension point.
REGISTRY: dict[str, Callable[..., DataFrame]] = {"regression": regression, "binary_labels": binary_labels, "auroc_auprc": auroc_auprc, "best_f1": best_f1, "classification": classification, "calibration_curve": calibration_curve, "curve_points": curve_points}


def register(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a metric family (df, by, ...) -> one row or more per group."""
    REGISTRY[name] = fn
