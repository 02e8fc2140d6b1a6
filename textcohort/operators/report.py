"""The tables behind a run's reports, made again from what the run saved.

A run folder holds `predictions` (split_id, case_id, model_key, y_true, y_value, y_prob, y_bin) and,
if there are any, `coefficients` (split_id, model_key, feature, coefficient), as Parquet.  The report
tables go beside them, each written whole or not at all, and a marker comes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as S
from . import metrics as M
from . import ranks as R
from . import split as X

MODEL = ["model_key"]
COEFFICIENTS = "split_id long, model_key string, feature string, coefficient double"
DONE = "done"


def cases(predictions: DataFrame) -> DataFrame:
    """One row per case and model: mean predictions of its splits, rounded so that ties don't depend on the order of addition."""
    got = M.pooled(predictions, ["case_id", *MODEL], ["y_true", "y_value", "y_prob"], ["y_bin"])
    return got.withColumns({c: F.round(c, 9) for c in ("y_true", "y_value", "y_prob")})


def summary(pooled: DataFrame) -> DataFrame:
    """model_key, metric, value in long form, of the pooled predictions."""
    wide = M.regression(pooled, MODEL, "y_true", "y_value").select(*MODEL, "mae", "rmse", "r2", "spearman_rho", "pearson_r")
    wide = R.with_group(wide, M.classification(pooled, MODEL, "y_bin", "y_prob").select(*MODEL, "n", "prevalence", "auroc", "auprc", "brier", "accuracy", "f1", "sensitivity", "specificity"), MODEL)
    names = [c for c in wide.columns if c not in MODEL]
    return wide.unpivot(MODEL, [F.col(c).cast("double").alias(c) for c in names], "metric", "value").where("value IS NOT NULL")


def best(metrics: DataFrame) -> DataFrame:
    """The best model of each metric; errors are best when small."""
    error = F.col("metric").isin("mae", "rmse", "brier")
    order = F.when(error, -F.col("value")).otherwise(F.col("value"))
    return R.best_row(metrics.where(~F.col("metric").isin("n", "prevalence")).withColumn("__o", order), ["metric"], [F.desc("__o"), F.asc("model_key")]).drop("__o")


def missed(pooled: DataFrame, k: int = 10) -> DataFrame:
    """The k largest residuals, and the surest false positives and false negatives, of each model."""
    kind = lambda name, where, size: pooled.where(where).select(*MODEL, "case_id", F.lit(name).alias("kind"), size.alias("size"))
    parts = [
        kind("residual", F.lit(True), F.abs(F.col("y_value") - F.col("y_true"))),
        kind("false_positive", (F.col("y_bin") == 0) & (F.col("y_prob") >= 0.5), F.col("y_prob")),
        kind("false_negative", (F.col("y_bin") == 1) & (F.col("y_prob") < 0.5), 1 - F.col("y_prob")),
    ]
    return R.top_rows(S.union_all(parts), [*MODEL, "kind"], [F.desc("size"), F.asc("case_id")], k, "place")


def sign_stability(coefficients: DataFrame) -> DataFrame:
    """Signs of each feature's coefficients over splits, and the share of the commoner one."""
    c = F.col("coefficient")
    got = coefficients.groupBy(*MODEL, "feature").agg(F.count("*").alias("n"), F.count_if(c > 1e-8).alias("n_pos"), F.count_if(c < -1e-8).alias("n_neg"), F.avg(c).alias("mean_coef"))
    return got.withColumn("consistency", F.greatest("n_pos", "n_neg") / F.col("n"))


def regenerate(spark: SparkSession, run: str, force: bool = False) -> dict[str, DataFrame]:
    """Make a run's report tables again and return them as written; those of a finished report are only read, unless forced."""
    out = f"{run.rstrip('/')}/report"
    names = ["cases", "summary", "best", "calibration", "curve", "missed", "balance", "signs"]
    finished = not S.optional(spark, f"{out}/{DONE}", "name string").isEmpty()
    if force or not finished:
        predictions = spark.read.parquet(f"{run}/predictions")
        S.replace(cases(predictions), f"{out}/cases")
        pooled = spark.read.parquet(f"{out}/cases")
        S.replace(summary(pooled), f"{out}/summary")
        tables = {
            "best": best(spark.read.parquet(f"{out}/summary")),
            "calibration": M.calibration_curve(pooled, MODEL, "y_bin", "y_prob"),
            "curve": M.curve_points(pooled, MODEL, "y_prob", "y_bin"),
            "missed": missed(pooled),
            "balance": X.balance(predictions, ["split_id"], "y_bin"),
            "signs": sign_stability(S.optional(spark, f"{run}/coefficients", COEFFICIENTS)),
        }
        for name, table in tables.items():
            S.replace(table, f"{out}/{name}")
        S.replace(spark.createDataFrame([(n,) for n in names], "name string"), f"{out}/{DONE}")
    return {n: spark.read.parquet(f"{out}/{n}") for n in names}
