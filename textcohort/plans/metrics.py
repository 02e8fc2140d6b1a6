"""Queries of the metric, pooling and ranking inventories (M, W, A08-A15, A27, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import ranks as R
from ..operators import report
from ..sources import files as S
from ..sources.scratch import new_path
from .registry import query

r = lambda c, k=6: F.round(c, k).alias(c)
BY = ["model_key"]

AREA = """t AS (SELECT model_key, y_prob, sum(y_bin) AS pos, sum(1 - y_bin) AS neg FROM pred_v GROUP BY ALL),
 c AS (SELECT *, sum(pos) OVER (PARTITION BY model_key ORDER BY y_prob DESC) AS tp, sum(neg) OVER (PARTITION BY model_key ORDER BY y_prob DESC) AS fp, sum(pos) OVER (PARTITION BY model_key) AS n_pos, sum(neg) OVER (PARTITION BY model_key) AS n_neg FROM t)"""
RANKED = """k AS (SELECT *, rank() OVER (PARTITION BY model_key ORDER BY y_true) + (count(*) OVER (PARTITION BY model_key, y_true) - 1) / 2.0 AS rt,
 rank() OVER (PARTITION BY model_key ORDER BY y_value) + (count(*) OVER (PARTITION BY model_key, y_value) - 1) / 2.0 AS rp FROM pred_v)"""


@query("M01", f"WITH {RANKED} SELECT model_key, count(*) AS n, round(avg(abs(y_value - y_true)), 3) AS mae, round(sqrt(avg((y_value - y_true) ** 2)), 3) AS rmse, round(corr(rt, rp), 6) AS spearman_rho FROM k GROUP BY 1")
def m01(t):
    return M.regression(t.pred_v, BY, "y_true", "y_value", 2).select("model_key", "n", r("mae", 3), r("rmse", 3), r("spearman_rho"))


@query("M02", f"WITH {RANKED} SELECT model_key, count(*) AS n, round(avg(abs(y_value - y_true)), 3) AS mae, round(sqrt(avg((y_value - y_true) ** 2)), 3) AS rmse, round(1 - sum((y_value - y_true) ** 2) / (var_pop(y_true) * count(*)), 6) AS r2, round(corr(y_true, y_value), 6) AS pearson_r, round(corr(rt, rp), 6) AS spearman_rho FROM k GROUP BY 1")
def m02(t):
    return M.regression(t.pred_v, BY, "y_true", "y_value").select("model_key", "n", r("mae", 3), r("rmse", 3), r("r2"), r("pearson_r"), r("spearman_rho"))


@query("M03", """SELECT o_custkey AS case_id, count(*) AS n, round(CASE WHEN count(*) >= 3 AND max(o_totalprice) > min(o_totalprice) AND max(o_orderkey % 2) > min(o_orderkey % 2) THEN corr(o_totalprice, o_orderkey % 2) END, 6) AS r FROM orders GROUP BY 1""")
def m03(t):
    o = t.orders.withColumn("parity", (F.col("o_orderkey") % 2).cast("double"))
    return o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("n"), F.round(M.safe_corr("o_totalprice", "parity"), 6).alias("r"))


@query("M04", f"WITH {AREA} SELECT model_key, round(sum(pos * (n_neg - fp) + 0.5 * pos * neg) / (max(n_pos) * max(n_neg)), 6) AS auroc FROM c GROUP BY 1")
def m04(t):
    return M.auroc_auprc(t.pred_v, BY, "y_prob", "y_bin").select("model_key", r("auroc"))


@query("M05", f"WITH {AREA} SELECT model_key, round(sum(pos * tp / (tp + fp)) / max(n_pos), 6) AS auprc FROM c GROUP BY 1")
def m05(t):
    return M.auroc_auprc(t.pred_v, BY, "y_prob", "y_bin").select("model_key", r("auprc"))


RATES = "round((tp + tn) / n, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1"


@query("M06", f"SELECT model_key, tp, fp, fn, tn, {RATES} FROM (SELECT model_key, count(*) AS n, count(*) FILTER (y_bin = 1 AND y_prob >= 0.5) AS tp, count(*) FILTER (y_bin = 0 AND y_prob >= 0.5) AS fp, count(*) FILTER (y_bin = 1 AND y_prob < 0.5) AS fn, count(*) FILTER (y_bin = 0 AND y_prob < 0.5) AS tn FROM pred_v GROUP BY 1)")
def m06(t):
    return M.binary_labels(t.pred_v.withColumn("y", (F.col("y_prob") >= 0.5).cast("long")), BY, "y_bin", "y").select("model_key", "tp", "fp", "fn", "tn", r("accuracy"), r("f1"))


@query("M07", f"WITH {AREA} SELECT model_key, round(max(f1), 6) AS best_f1, arg_max(y_prob, (f1, -y_prob)) AS threshold FROM (SELECT *, 2 * tp / (tp + fp + n_pos) AS f1 FROM c) GROUP BY 1")
def m07(t):
    return M.best_f1(t.pred_v, BY, "y_prob", "y_bin").select("model_key", r("best_f1"), "threshold")


THREE = """p AS (SELECT 'label' AS predictor, CAST(y_prob >= 0.5 AS DOUBLE) AS s, y_bin FROM pred_v UNION ALL SELECT 'predicted', y_prob, y_bin FROM pred_v UNION ALL SELECT 'truth', y_true, y_bin FROM pred_v),
 t AS (SELECT predictor, s, sum(y_bin) AS pos, sum(1 - y_bin) AS neg FROM p GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY predictor ORDER BY s DESC) AS fp, sum(pos) OVER (PARTITION BY predictor) AS n_pos, sum(neg) OVER (PARTITION BY predictor) AS n_neg FROM t)"""


@query("M08", f"WITH {THREE} SELECT predictor, round(sum(pos * (n_neg - fp) + 0.5 * pos * neg) / (max(n_pos) * max(n_neg)), 6) AS auroc FROM c GROUP BY 1")
def m08(t):
    scores = {"label": (F.col("y_prob") >= 0.5).cast("double"), "predicted": F.col("y_prob"), "truth": F.col("y_true")}
    long = t.pred_v.select("y_bin", F.explode(F.array(*(F.struct(F.lit(k).alias("predictor"), c.alias("s")) for k, c in scores.items()))).alias("x")).select("y_bin", "x.*")
    return M.auroc_auprc(long, ["predictor"], "s", "y_bin").select("predictor", r("auroc"))


@query("M09", "SELECT model_key, round(avg(CAST(row_id % 10 <> 0 AS INT)), 6) AS retrieval_rate, count(*) FILTER (row_id % 10 = 0) AS n_failures FROM pred_v GROUP BY 1")
def m09(t):
    ok = (F.col("row_id") % 10 != 0).cast("int")
    return t.pred_v.groupBy("model_key").agg(F.round(F.avg(ok), 6).alias("retrieval_rate"), F.count_if(ok == 0).alias("n_failures"))


@query("M10", "SELECT model_key, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT model_key, count(*) FILTER (y_bin = 1 AND y_prob >= 0.4) AS tp, count(*) FILTER (y_bin = 0 AND y_prob >= 0.4) AS fp, count(*) FILTER (y_bin = 1 AND y_prob < 0.4) AS fn, count(*) FILTER (y_bin = 0 AND y_prob < 0.4) AS tn FROM pred_v GROUP BY 1)")
def m10(t):
    return M.binary_labels(t.pred_v.withColumn("y", (F.col("y_prob") >= 0.4).cast("long")), BY, "y_bin", "y").select("model_key", r("sensitivity"), r("specificity"), r("f1"))


@query(
    "M11",
    f"""WITH {AREA}, a AS (SELECT model_key, sum(pos * (n_neg - fp) + 0.5 * pos * neg) / (max(n_pos) * max(n_neg)) AS auroc, sum(pos * tp / (tp + fp)) / max(n_pos) AS auprc FROM c GROUP BY 1),
 q AS (SELECT model_key, count(*) AS n, avg(y_bin) AS prevalence, avg(CAST(y_prob >= 0.5 AS INT)) AS positive_rate, avg((y_prob - y_bin) ** 2) AS brier, count(*) FILTER (y_bin = 1 AND y_prob >= 0.5) AS tp, count(*) FILTER (y_bin = 0 AND y_prob >= 0.5) AS fp, count(*) FILTER (y_bin = 1 AND y_prob < 0.5) AS fn, count(*) FILTER (y_bin = 0 AND y_prob < 0.5) AS tn FROM pred_v GROUP BY 1)
 SELECT model_key, n, round(prevalence, 6) AS prevalence, round(prevalence, 6) AS no_skill_auprc, round(positive_rate, 6) AS positive_rate, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(brier, 6) AS brier, round((tp + tn) / n, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
 round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS ppv, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tn / (tn + fn), 6) AS npv, tn, fp, fn, tp FROM q JOIN a USING (model_key)""",
)
def m11(t):
    got = M.classification(t.pred_v, BY, "y_bin", "y_prob")
    return got.select("model_key", "n", *(r(c) for c in ("prevalence", "no_skill_auprc", "positive_rate", "auroc", "auprc", "brier", "accuracy", "balanced_accuracy", "f1", "ppv", "sensitivity", "specificity", "npv")), "tn", "fp", "fn", "tp")


@query("M14", "SELECT row_id, round(y_value - y_true, 4) AS residual, round((y_value - y_true) / greatest(stddev_pop(y_value - y_true) OVER (PARTITION BY model_key), 1e-12), 6) AS standardised, round(2 * abs(y_prob - 0.5), 6) AS confidence, concat_ws(';', CASE WHEN y_bin = 1 AND y_prob < 0.5 THEN 'false_negative' END, CASE WHEN y_bin = 0 AND y_prob >= 0.5 THEN 'false_positive' END, CASE WHEN abs(y_prob - 0.5) < 0.1 THEN 'uncertain' END) AS tags FROM pred_v")
def m14(t):
    d = F.col("y_value") - F.col("y_true")
    sd = t.pred_v.groupBy("model_key").agg(F.greatest(F.stddev_pop(d), F.lit(M.EPS)).alias("sd"))
    tags = F.array(F.when((F.col("y_bin") == 1) & (F.col("y_prob") < 0.5), "false_negative"), F.when((F.col("y_bin") == 0) & (F.col("y_prob") >= 0.5), "false_positive"), F.when(F.abs(F.col("y_prob") - 0.5) < 0.1, "uncertain"))
    return t.pred_v.join(sd, "model_key").select("row_id", F.round(d, 4).alias("residual"), F.round(d / F.col("sd"), 6).alias("standardised"), F.round(2 * F.abs(F.col("y_prob") - 0.5), 6).alias("confidence"), F.array_join(F.array_compact(tags), ";").alias("tags"))


@query("M15", f"WITH {AREA} SELECT model_key, y_prob AS threshold, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM c")
def m15(t):
    return M.curve_points(t.pred_v, BY, "y_prob", "y_bin").select("model_key", "threshold", r("fpr"), r("tpr"), r("precision"))


@query("M16", f"WITH {AREA} SELECT model_key, auroc FROM (SELECT model_key, round(sum(pos * (n_neg - fp) + 0.5 * pos * neg) / (max(n_pos) * max(n_neg)), 6) AS auroc FROM c GROUP BY 1) ORDER BY auroc DESC, model_key LIMIT 1")
def m16(t):
    return M.auroc_auprc(t.pred_v, BY, "y_prob", "y_bin").select("model_key", r("auroc")).orderBy(F.desc("auroc"), "model_key").limit(1)


@query("M17", "SELECT model_key, count(*) AS n, round(avg(abs(y_value - y_true)), 3) AS mae FROM pred_v WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = case_id AND c_acctbal < 0) GROUP BY 1")
def m17(t):
    gone = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("case_id"))
    return t.pred_v.join(gone, "case_id", "left_anti").groupBy("model_key").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y_value") - F.col("y_true"))), 3).alias("mae"))


@query("M18", "SELECT dataset_key || '/' || role AS config, 'mae' AS metric, round(avg(abs(y_value - y_true)), 3) AS value FROM pred_v GROUP BY 1 UNION ALL SELECT dataset_key || '/' || role, 'accuracy', round(avg(CAST((y_prob >= 0.5) = (y_bin = 1) AS INT)), 6) FROM pred_v GROUP BY 1")
def m18(t):
    got = t.pred_v.groupBy(F.concat_ws("/", "dataset_key", "role").alias("config")).agg(F.round(F.avg(F.abs(F.col("y_value") - F.col("y_true"))), 3).alias("mae"), F.round(F.avg(((F.col("y_prob") >= 0.5) == (F.col("y_bin") == 1)).cast("int")), 6).alias("accuracy"))
    return got.unpivot("config", ["mae", "accuracy"], "metric", "value")


@query("M19", "SELECT run_id, target, lower(raw_metric) AS metric, modality, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, target, raw_metric ORDER BY CASE WHEN lower(raw_metric) IN ('mae', 'brier') THEN value ELSE -value END, modality) AS k FROM metric_v) WHERE k = 1")
def m19(t):
    less = F.lower("raw_metric").isin("mae", "brier")
    return R.best_row(t.metric_v, ["run_id", "target", "raw_metric"], [F.when(less, F.col("value")).otherwise(-F.col("value")), F.col("modality")]).select("run_id", "target", F.lower("raw_metric").alias("metric"), "modality", "value")


@query("W01", "SELECT row_id, rank() OVER (PARTITION BY model_key ORDER BY y_prob) + (count(*) OVER (PARTITION BY model_key, y_prob) - 1) / 2.0 AS avg_rank FROM pred_v")
def w01(t):
    return R.average_rank(t.pred_v, BY, "y_prob").select("row_id", F.col("avg_rank").cast("double").alias("avg_rank"))


@query("W02", "SELECT dataset_key, model_key, mae, row_number() OVER (PARTITION BY dataset_key ORDER BY mae, model_key) AS rank FROM (SELECT dataset_key, model_key, round(avg(abs(y_value - y_true)), 3) AS mae FROM pred_v GROUP BY ALL) QUALIFY rank <= 3")
def w02(t):
    got = t.pred_v.groupBy("dataset_key", "model_key").agg(F.round(F.avg(F.abs(F.col("y_value") - F.col("y_true"))), 3).alias("mae"))
    return R.top_rows(got, ["dataset_key"], [F.asc("mae"), F.asc("model_key")], 3)


@query("W03", "SELECT run_id, raw_metric, modality, value FROM metric_v QUALIFY row_number() OVER (PARTITION BY run_id, raw_metric ORDER BY value DESC, modality, target) = 1")
def w03(t):
    return R.best_row(t.metric_v, ["run_id", "raw_metric"], [F.desc("value"), F.asc("modality"), F.asc("target")]).select("run_id", "raw_metric", "modality", "value")


@query("W04", "SELECT run_id, modality, value FROM metric_v WHERE raw_metric = 'AUROC' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY CASE target WHEN 'relapse' THEN 0 ELSE 1 END, value DESC, modality) = 1")
def w04(t):
    first = F.when(F.col("target") == "relapse", 0).otherwise(1)
    return R.best_row(t.metric_v.where("raw_metric = 'AUROC'"), ["run_id"], [first, F.desc("value"), F.asc("modality")]).select("run_id", "modality", "value")


BH = "SELECT run_id, modality, target, p, CASE WHEN p IS NOT NULL THEN round(least(min(p * m / k) OVER (PARTITION BY run_id ORDER BY p DESC NULLS FIRST), 1.0), 8) END AS q FROM (SELECT *, count(p) OVER (PARTITION BY run_id) AS m, rank() OVER (PARTITION BY run_id ORDER BY p NULLS LAST) + count(*) OVER (PARTITION BY run_id, p) - 1 AS k FROM (SELECT run_id, modality, target, CASE WHEN modality <> 'm3' THEN value / 2 END AS p FROM metric_v WHERE raw_metric = 'mae'))"


@query("W05", BH)
def w05(t):
    d = t.metric_v.where("raw_metric = 'mae'").select("run_id", "modality", "target", F.when(F.col("modality") != "m3", F.col("value") / 2).alias("p"))
    return R.benjamini_hochberg(d, ["run_id"], "p").select("run_id", "modality", "target", "p", F.round("q", 8).alias("q"))


@query("W06", "SELECT seq, mode, row_number() OVER (PARTITION BY mode ORDER BY seq) > 1 AS cacheable FROM usage_v")
def w06(t):
    first = t.usage_v.groupBy("mode").agg(F.min("seq").alias("first"))
    return t.usage_v.join(first, "mode").select("seq", "mode", (F.col("seq") > F.col("first")).alias("cacheable"))


@query("W07", "SELECT user_id, event_id, event_type FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w07(t):
    got = t.events.where("value IS NOT NULL").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    return got.select("user_id", "e.event_id", "e.event_type")


@query("W08", f"WITH {AREA} SELECT model_key, y_prob, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c")
def w08(t):
    return R.threshold_table(t.pred_v, BY, "y_prob", "y_bin").select("model_key", "y_prob", "tp", "fp")


@query("W09", "SELECT run_id, modality, target, raw_metric, round(CASE WHEN hi > lo THEN CASE WHEN raw_metric = 'mae' THEN 1 - (value - lo) / (hi - lo) ELSE (value - lo) / (hi - lo) END ELSE 0.5 END, 6) AS scaled FROM (SELECT *, min(value) OVER (PARTITION BY raw_metric) AS lo, max(value) OVER (PARTITION BY raw_metric) AS hi FROM metric_v)")
def w09(t):
    return R.min_max(t.metric_v, ["raw_metric"], "value", F.col("raw_metric") == "mae").select("run_id", "modality", "target", "raw_metric", F.round("scaled", 6).alias("scaled"))


@query("W10", "SELECT run_id, modality, value, CASE WHEN d <= 4 THEN 'top' ELSE 'bottom' END AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value, modality) AS u, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, modality) AS d FROM metric_v WHERE raw_metric = 'mae') WHERE u <= 4 OR d <= 4")
def w10(t):
    return R.top_and_bottom(t.metric_v.where("raw_metric = 'mae'"), ["run_id"], "value", "modality", 4).select("run_id", "modality", "value", "bucket")


@query("W11", "SELECT modality, round(median(value), 7) AS m, row_number() OVER (ORDER BY round(median(value), 7), modality) AS position FROM metric_v WHERE raw_metric = 'AUROC' GROUP BY 1")
def w11(t):
    got = t.metric_v.where("raw_metric = 'AUROC'").groupBy("modality").agg(F.round(F.median("value"), 7).alias("m"))
    return R.top_rows(got.withColumn("all", F.lit(0)), ["all"], [F.asc("m"), F.asc("modality")], 1_000_000, "position").drop("all")


@query("A08", "SELECT case_id, model_key, round(avg(y_prob), 6) AS y_prob, round(avg(y_value), 6) AS y_value, max(y_bin) AS y_bin, string_agg(DISTINCT CAST(split_id AS VARCHAR), ';' ORDER BY CAST(split_id AS VARCHAR)) AS split_ids, count(*) AS n_predictions FROM pred_v GROUP BY 1, 2")
def a08(t):
    return M.pooled(t.pred_v, ["case_id", "model_key"], ["y_prob", "y_value"], ["y_bin"]).withColumns({"y_prob": F.round("y_prob", 6), "y_value": F.round("y_value", 6)})


@query("A09", f"WITH {AREA.replace('model_key', 'dataset_key, model_key').replace('pred_v GROUP BY ALL', 'pred_v GROUP BY ALL')} SELECT dataset_key, model_key, round(sum(pos * (n_neg - fp) + 0.5 * pos * neg) / (max(n_pos) * max(n_neg)), 6) AS auroc FROM c GROUP BY 1, 2")
def a09(t):
    return M.auroc_auprc(t.pred_v, ["dataset_key", "model_key"], "y_prob", "y_bin").select("dataset_key", "model_key", r("auroc"))


@query("A10", "SELECT model_key, n_pos, n_neg, n_zero, round(mean_coef, 4) AS mean_coef, CASE WHEN n_pos >= n_neg THEN 'positive' ELSE 'negative' END AS dominant, round(greatest(n_pos, n_neg) / nullif(n_pos + n_neg + n_zero, 0), 6) AS consistency FROM (SELECT model_key, count(*) FILTER (d > 1e-8) AS n_pos, count(*) FILTER (d < -1e-8) AS n_neg, count(*) FILTER (abs(d) <= 1e-8) AS n_zero, avg(d) AS mean_coef FROM (SELECT model_key, y_prob - 0.5 AS d FROM pred_v) GROUP BY 1)")
def a10(t):
    d = F.col("y_prob") - 0.5
    got = t.pred_v.groupBy("model_key").agg(F.count_if(d > 1e-8).alias("n_pos"), F.count_if(d < -1e-8).alias("n_neg"), F.count_if(F.abs(d) <= 1e-8).alias("n_zero"), F.round(F.avg(d), 4).alias("mean_coef"))
    return got.withColumns({"dominant": F.when(F.col("n_pos") >= F.col("n_neg"), "positive").otherwise("negative"), "consistency": F.round(F.try_divide(F.greatest("n_pos", "n_neg"), F.col("n_pos") + F.col("n_neg") + F.col("n_zero")), 6)})


@query("A11", "SELECT dataset_key, count(*) FILTER (abs(y_prob) > 1e-8) AS n_nonzero, round(avg(y_prob), 6) AS mean_abs, round(median(y_prob), 6) AS median_abs, string_agg(DISTINCT model_key, ';' ORDER BY model_key) AS models FROM pred_v GROUP BY 1")
def a11(t):
    return t.pred_v.groupBy("dataset_key").agg(F.count_if(F.abs("y_prob") > 1e-8).alias("n_nonzero"), F.round(F.avg("y_prob"), 6).alias("mean_abs"), F.round(F.median("y_prob"), 6).alias("median_abs"), F.array_join(F.sort_array(F.collect_set("model_key")), ";").alias("models"))


@query("A14", "SELECT model_key, count(*) AS n, round(avg(y_true), 3) AS mean, round(stddev_pop(y_true), 3) AS std, min(y_true) AS min, max(y_true) AS max, CAST(sum(y_bin) AS BIGINT) AS positives, round(avg(y_bin), 6) AS prevalence FROM pred_v GROUP BY 1")
def a14(t):
    return t.pred_v.groupBy("model_key").agg(F.count("*").alias("n"), F.round(F.avg("y_true"), 3).alias("mean"), F.round(F.stddev_pop("y_true"), 3).alias("std"), F.min("y_true").alias("min"), F.max("y_true").alias("max"), F.sum("y_bin").alias("positives"), F.round(F.avg("y_bin"), 6).alias("prevalence"))


@query("A15", "SELECT split_id, role, count(*) AS n, CAST(sum(y_bin) AS BIGINT) AS positives, sum(y_bin) < 2 OR count(*) - sum(y_bin) < 2 AS warning FROM pred_v GROUP BY GROUPING SETS ((split_id, role), ())")
def a15(t):
    return t.pred_v.groupingSets([["split_id", "role"], []], "split_id", "role").agg(F.count("*").alias("n"), F.sum("y_bin").alias("positives"), ((F.sum("y_bin") < 2) | (F.count("*") - F.sum("y_bin") < 2)).alias("warning"))


@query("A27", "SELECT model_key, CAST(greatest(ceil(y_prob * 5), 1) AS BIGINT) AS bin, round(avg(y_prob), 6) AS mean_prob, round(avg(y_bin), 6) AS observed, count(*) AS n FROM pred_v GROUP BY 1, 2")
def a27(t):
    return M.calibration_curve(t.pred_v, BY, "y_bin", "y_prob").select("model_key", "bin", r("mean_prob"), r("observed"), "n")


@query("P22", """SELECT "column", n_missing, n_rows FROM (UNPIVOT (SELECT count(*) AS n_rows, count(*) FILTER (score IS NULL) AS score, count(*) FILTER (relapse IS NULL) AS relapse, count(*) FILTER (text_a IS NULL) AS text_a FROM cases_v) ON score, relapse, text_a INTO NAME "column" VALUE n_missing)""")
def p22(t):
    return M.missingness(t.cases_v, ["score", "relapse", "text_a"])


@query("L04", "SELECT row_id, kind, place FROM (SELECT row_id, kind, row_number() OVER (PARTITION BY kind ORDER BY size DESC, row_id) AS place FROM (SELECT row_id, 'residual' AS kind, abs(y_value - y_true) AS size FROM pred_v UNION ALL SELECT row_id, 'false_positive', y_prob FROM pred_v WHERE y_bin = 0 AND y_prob >= 0.5 UNION ALL SELECT row_id, 'false_negative', -y_prob FROM pred_v WHERE y_bin = 1 AND y_prob < 0.5)) WHERE place <= 10")
def l04(t):
    p = t.pred_v
    kinds = [p.select("row_id", F.lit("residual").alias("kind"), F.abs(F.col("y_value") - F.col("y_true")).alias("size")), p.where("y_bin = 0 AND y_prob >= 0.5").select("row_id", F.lit("false_positive").alias("kind"), F.col("y_prob").alias("size")), p.where("y_bin = 1 AND y_prob < 0.5").select("row_id", F.lit("false_negative").alias("kind"), (-F.col("y_prob")).alias("size"))]
    return R.top_rows(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), ["kind"], [F.desc("size"), F.asc("row_id")], 10, "place").drop("size")


@query("L05", "SELECT row_id, y_prob FROM (SELECT row_id, y_prob FROM pred_v ORDER BY y_prob DESC, row_id LIMIT 200) ORDER BY y_prob DESC, row_id LIMIT 25")
def l05(t):
    order = [F.desc("y_prob"), F.asc("row_id")]
    return t.pred_v.select("row_id", "y_prob").orderBy(*order).limit(200).orderBy(*order).limit(25)


@query("L06", "SELECT run_id, modality, target, value FROM metric_v WHERE raw_metric = 'AUROC' ORDER BY value DESC, run_id, modality LIMIT 20")
def l06(t):
    return t.metric_v.where("raw_metric = 'AUROC'").orderBy(F.desc("value"), "run_id", "modality").limit(20).drop("raw_metric")


@query("L09", "SELECT raw_metric, run_id, modality, value FROM metric_v QUALIFY row_number() OVER (PARTITION BY raw_metric ORDER BY value DESC, run_id, modality) = 1")
def l09(t):
    return R.best_row(t.metric_v, ["raw_metric"], [F.desc("value"), F.asc("run_id"), F.asc("modality")]).select("raw_metric", "run_id", "modality", "value")


#: The report flow: areas under the curve and errors of pooled predictions, from a saved run.
Q19_SQL = """WITH p AS (SELECT model_key, case_id, round(avg(y_true), 9) AS y_true, round(avg(y_value), 9) AS y_value, round(avg(y_prob), 9) AS y_prob, max(y_bin) AS y_bin FROM pred_v WHERE role = 'test' GROUP BY ALL),
 d AS (SELECT model_key, y_prob, sum(y_bin) AS pos, sum(1 - y_bin) AS neg FROM p GROUP BY ALL),
 c AS (SELECT model_key, pos, neg, sum(neg) OVER (PARTITION BY model_key ORDER BY y_prob) AS below, sum(pos) OVER (PARTITION BY model_key) AS n_pos, sum(neg) OVER (PARTITION BY model_key) AS n_neg FROM d),
 m AS (SELECT model_key, 'auroc' AS metric, sum(pos * (below - neg) + 0.5 * pos * neg) / (max(n_pos) * max(n_neg)) AS value FROM c GROUP BY 1
  UNION ALL SELECT model_key, 'mae', avg(abs(y_value - y_true)) FROM p GROUP BY 1 UNION ALL SELECT model_key, 'n', count(*) FROM p GROUP BY 1)
 SELECT model_key, metric, round(CAST(value AS DOUBLE), 6) AS value FROM m"""


@query("Q19", Q19_SQL)
def q19(t):
    """Reports made again from the predictions that a run saved."""
    run = new_path(t.spark)
    S.replace(t.pred_v.where("role = 'test'").select("split_id", "case_id", "model_key", "y_true", "y_value", "y_prob", "y_bin"), f"{run}/predictions")
    return report.regenerate(t.spark, run)["summary"].where("metric IN ('auroc', 'mae', 'n')").select("model_key", "metric", r("value"))
