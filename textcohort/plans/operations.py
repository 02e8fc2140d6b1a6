"""Queries of the source, sink, model, cost and extraction inventories (S, K, B, T25-T26, E, M12)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cost as P
from ..operators import extract as E
from ..operators import models as B
from ..sources import files as S
from ..sources.scratch import new_path
from .registry import query


def _csv(t, df):
    path = new_path(t.spark)
    df.write.options(header=True, escape='"').csv(path)
    return path


def _json(t, df):
    path = new_path(t.spark)
    df.write.json(path)
    return path


def _lines(t, df):
    path = new_path(t.spark)
    df.write.text(path)
    return path


@query("S01", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'doc_' || doc_id AS case_id, md5(text) AS h FROM documents")
def s01(t):
    path = _csv(t, t.documents.select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("case_id"), "text"))
    return S.cases(t.spark, path, ["doc_id", "text"]).select("doc_id", "case_id", F.md5("text").alias("h"))


@query("S02", "SELECT case_id, score, relapse, text_a = 'N/A' AS a_missing FROM cases_v")
def s02(t):
    return t.cases_v.select("case_id", T.number(F.col("score").cast("string")).alias("score"), "relapse", T.is_missing(F.col("text_a"), "a").alias("a_missing"))


@query("S03", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0")
def s03(t):
    row = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    value = F.when(F.col("o_orderkey") % 10 != 0, row).when(F.col("o_orderkey") % 20 == 0, F.substring(row, 1, 8)).otherwise(F.lit(" "))
    good, _ = S.json_lines(t.spark, _lines(t, t.orders.select(value.alias("value"))), "o_orderkey long, o_orderstatus string")
    return good.where("o_orderkey IS NOT NULL").drop("line")


@query("S04", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s04(t):
    path = _csv(t, t.events.select("event_id", "props"))
    return S.csv(t.spark, path, "event_id long, props string").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("S05", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'jsonl' ELSE 'csv' END AS origin FROM orders")
def s05(t):
    a = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("jsonl").alias("origin"))
    return S.prefer(a, t.orders.select("o_orderkey", F.lit("csv").alias("origin")), ["o_orderkey"])


@query("S06", "SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1")
def s06(t):
    return S.last_valid(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") != "error").select("user_id", "event_id")


@query("S07", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def s07(t):
    items = t.conversations.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role"))).alias("phrases"))
    back = S.csv(t.spark, _csv(t, items), "conv_id long, phrases string")
    return back.select("conv_id", F.size(F.from_json("phrases", "array<struct<turn:long,role:string>>")).cast("long").alias("n"))


@query("S08", "SELECT part, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS part FROM supplier) GROUP BY 1")
def s08(t):
    paths = {k: _csv(t, t.supplier.where(w).select("s_suppkey")) for k, w in (("a", "s_suppkey % 2 = 0"), ("b", "s_suppkey % 2 <> 0"))}
    got = S.with_source(t.spark, list(paths.values()), "s_suppkey long")
    return got.where(F.startswith("source_file", F.lit("part-"))).groupBy(F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("b").alias("part")).agg(F.count("*").alias("n"))


@query("S09", "SELECT s_suppkey, CAST(NULL AS BIGINT) AS extra FROM supplier")
def s09(t):
    none = S.optional(t.spark, new_path(t.spark), "s_suppkey long, extra long")
    return t.supplier.select("s_suppkey").join(none, "s_suppkey", "left")


@query("S10", "SELECT CAST(split_id AS BIGINT) AS split_id, count(*) AS n FROM pred_v GROUP BY 1")
def s10(t):
    path = new_path(t.spark)
    S.replace(t.pred_v.select("row_id", "split_id"), path, ["split_id"])
    return t.spark.read.parquet(path).groupBy(F.col("split_id").cast("long").alias("split_id")).agg(F.count("*").alias("n"))


RUNS = "(SELECT run_id, modality, CASE WHEN raw_metric = 'n' THEN 'cost_json_b' WHEN raw_metric = 'mae' THEN 'metrics_csv' WHEN raw_metric = 'AUROC' THEN 'run_log' ELSE 'other' END AS kind FROM metric_v)"


@query("S11", f"SELECT run_id, kind, count(DISTINCT modality) AS n FROM {RUNS} GROUP BY ALL")
def s11(t):
    """Run folders with a folder per modality and artifact, written from the metric rows and found again."""
    root = new_path(t.spark)
    artifact = F.when(F.col("raw_metric") == "n", "all_cost.json").when(F.col("raw_metric") == "mae", "metrics.csv").when(F.col("raw_metric") == "AUROC", "run.log").otherwise("notes.txt")
    rows = t.metric_v.select("run_id", "modality", artifact.alias("artifact"), F.to_json(F.struct("target", "value")).alias("value"))
    rows.write.partitionBy("run_id", "modality", "artifact").text(root)
    got = S.artifacts(t.spark, root, "b").where("name LIKE 'part-%'")
    part = lambda k: F.element_at(F.split(F.element_at(F.split("path", "/"), k), "="), -1)
    return got.groupBy("run_id", S.classify(F.lit("b"), part(-2)).alias("kind")).agg(F.count_distinct(part(-3)).alias("n"))


@query("S12", "SELECT DISTINCT run_id, CASE WHEN starts_with(run_id, 'A') THEN 'first ' || run_id ELSE run_id END AS label, CASE WHEN starts_with(run_id, 'A') THEN 'a' ELSE 'b' END AS approach, CASE WHEN starts_with(run_id, 'A') THEN '/runs/' || run_id END AS path FROM metric_v")
def s12(t):
    """A comparison's configuration, written as JSON for the runs there are; some give neither label nor path."""
    runs = sorted(r.run_id for r in t.metric_v.select("run_id").distinct().collect())
    told = [{"run_id": r, "label": f"first {r}", "approach": "a", "path": f"/runs/{r}"} if r.startswith("A") else {"run_id": r, "approach": "b"} for r in runs]
    return S.config(t.spark, json.dumps({"runs": told}))


WIDE = "SELECT l_returnflag, avg(l_quantity) AS mae, min(l_quantity) AS mae_ci_low, max(l_quantity) AS mae_ci_high, avg(l_discount) AS rmse FROM lineitem GROUP BY 1"


def _wide(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mae"), F.min("l_quantity").alias("mae_ci_low"), F.max("l_quantity").alias("mae_ci_high"), F.avg("l_discount").alias("rmse"))


@query("S13", f"SELECT l_returnflag, metric, round(value, 5) AS value FROM (UNPIVOT (SELECT l_returnflag, mae, rmse FROM ({WIDE})) ON mae, rmse INTO NAME metric VALUE value)")
def s13(t):
    return S.long_metrics(_wide(t), ["l_returnflag"], ["mae", "rmse"]).select("l_returnflag", "metric", F.round("value", 5).alias("value"))


@query("S14", "SELECT run_id, target, metric, max(value) AS value FROM (SELECT run_id, target, raw_metric || '_' || modality AS metric, value FROM metric_v) GROUP BY ALL")
def s14(t):
    """Evaluation files, one for each run, with an object of metrics for each target and a note that is no number."""
    path = new_path(t.spark)
    metrics = t.metric_v.groupBy("run_id", "target", F.concat_ws("_", "raw_metric", "modality").alias("metric")).agg(F.max("value").alias("value"))
    inner = metrics.groupBy("run_id", "target").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("value").cast("string")))).alias("m"))
    noted = inner.withColumn("m", F.map_concat("m", F.create_map(F.lit("note"), F.lit("text"))))
    files = noted.groupBy("run_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("target", "m")))).alias("value"))
    files.repartition("run_id").write.partitionBy("run_id").text(path)
    run = F.regexp_extract("path", "run_id=([^/]+)", 1)
    return S.json_metrics(S.whole_texts(t.spark, path)).select(run.alias("run_id"), "target", "metric", "value")


@query("S15", f"SELECT l_returnflag, metric, round(value, 5) AS value, low, high FROM (SELECT l_returnflag, 'mae' AS metric, mae AS value, mae_ci_low AS low, mae_ci_high AS high FROM ({WIDE}) UNION ALL SELECT l_returnflag, 'rmse', rmse, NULL, NULL FROM ({WIDE}))")
def s15(t):
    return S.long_metrics(_wide(t), ["l_returnflag"], ["mae", "rmse"]).withColumn("value", F.round("value", 5))


@query("S16", "SELECT mode, block, metric, CAST(value AS DOUBLE) AS value FROM (SELECT mode, 'root' AS block, 'calls' AS metric, count(*) AS value FROM usage_v GROUP BY 1 UNION ALL SELECT mode, 'cumulative', 'calls', count(*) * 2 FROM usage_v GROUP BY 1 UNION ALL SELECT mode, 'cumulative', 'tokens', sum(tokens) FROM usage_v GROUP BY 1)")
def s16(t):
    """Cost files, one for each mode."""
    path = new_path(t.spark)
    counted = t.usage_v.groupBy("mode").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    value = F.to_json(F.struct("calls", F.struct((F.col("calls") * 2).alias("calls"), "tokens").alias("cumulative")))
    counted.select("mode", value.alias("value")).repartition("mode").write.partitionBy("mode").text(path)
    return S.cost_metrics(S.whole_texts(t.spark, path)).select(F.regexp_extract("path", "mode=([^/]+)", 1).alias("mode"), "block", "metric", "value")


@query("S17", "SELECT user_id, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1")
def s17(t):
    lines = t.events.select("user_id", F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] step")).alias("value"))
    return S.runtime(lines, ["user_id"])


@query("S18", "SELECT run_id, target, raw_metric AS metric, max(value) AS value, 'manual' AS source FROM metric_v WHERE raw_metric = 'AUROC' GROUP BY ALL")
def s18(t):
    """Metrics entered by hand: the best of each run and target, as plain records."""
    best = t.metric_v.where("raw_metric = 'AUROC'").groupBy("run_id", "target").agg(F.max("value").alias("value")).collect()
    return S.manual(t.spark, [{"run_id": r.run_id, "target": r.target, "metric": "AUROC", "value": r.value} for r in best])


@query("S19", r"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' ELSE 'utf-16' END AS encoding, md5(text) AS h, CAST(length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS BIGINT) AS n_non_ascii FROM documents")
def s19(t):
    """Each text in one of three encodings, told from its bytes."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-16"))
    return S.decoded(t.documents.select("doc_id", raw.alias("content"))).select("doc_id", "encoding", F.md5("text").alias("h"), "n_non_ascii")


@query("S20", "SELECT doc_id, lang FROM documents")
def s20(t):
    return S.subset(t.documents, ["doc_id", "lang"])


@query("S21", "SELECT doc_id, md5(trim(text, ' ' || chr(10))) AS h FROM documents")
def s21(t):
    path = _csv(t, S.trimmed(t.documents.select("doc_id", "text"), ["text"]))
    return S.csv(t.spark, path, "doc_id long, text string").select("doc_id", F.md5("text").alias("h"))


@query("S22", "SELECT case_id, row_index, CAST(NULL AS VARCHAR) AS phrases, 1 AS missing, 'no text' AS missing_reason FROM cases_v WHERE text_a = 'N/A'")
def s22(t):
    from pyspark.sql import types as Y

    shape = Y.StructType([Y.StructField("case_id", Y.StringType()), Y.StructField("row_index", Y.LongType()), Y.StructField("phrases", Y.StringType())])
    return S.missing_record(t.cases_v.where(T.is_missing(F.col("text_a"))).select("case_id", "row_index"), "no text", shape)


@query("S23", "SELECT case_id, score FROM cases_v")
def s23(t):
    return S.subset(t.cases_v, ["case_id", "score"])


@query("S24", "SELECT DISTINCT split_id FROM pred_v WHERE y_prob > 0.9985")
def s24(t):
    return E.finished(t.pred_v, ["split_id"], F.col("y_prob") > 0.9985)


@query("S25", "SELECT run_id, raw_metric, value FROM metric_v WHERE raw_metric IN ('mae', 'n')")
def s25(t):
    kinds = [t.metric_v.where(F.col("raw_metric") == k).select("run_id", "raw_metric", "value") for k in ("mae", "n")]
    return S.union_all(kinds)


@query("S26", "SELECT run_id, 'configured' AS source FROM metric_v GROUP BY 1 UNION ALL SELECT 'm1', 'manual'")
def s26(t):
    manual = S.manual(t.spark, [{"run_id": "m1", "target": "score", "metric": "rho", "value": 0.7}])
    return t.metric_v.select("run_id").distinct().withColumn("source", F.lit("configured")).unionByName(manual.select("run_id", "source"))


# ----- sinks: what a table holds after it was written


@query("K01", "SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def k01(t):
    path = new_path(t.spark)
    S.replace(t.supplier.select("s_suppkey", "s_name"), path)
    S.replace(t.supplier.select("s_suppkey", F.upper("s_name").alias("s_name")), path)
    return t.spark.read.parquet(path)


@query("K02", "SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation")
def k02(t):
    path = new_path(t.spark)
    S.append(t.nation.select("n_nationkey"), path)
    S.append(t.nation.select((F.col("n_nationkey") + 100).alias("n_nationkey")), path)
    return t.spark.read.parquet(path)


@query("K03", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars < 100) AS n_short FROM documents GROUP BY 1")
def k03(t):
    path = new_path(t.spark)
    S.replace(t.documents.select("doc_id", "lang", "n_chars"), path)
    return t.spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 100).alias("n_short"))


@query("K04", "SELECT split_id, count(*) FILTER (split_id <> 1996) + count(*) FILTER (split_id = 1996 AND role = 'test') AS n FROM pred_v GROUP BY 1")
def k04(t):
    path = new_path(t.spark)
    S.replace(t.pred_v.select("row_id", "split_id"), path, ["split_id"])
    S.replace(t.pred_v.where("split_id = 1996 AND role = 'test'").select("row_id", "split_id"), path, ["split_id"])
    return t.spark.read.parquet(path).groupBy(F.col("split_id").cast("long").alias("split_id")).agg(F.count("*").alias("n"))


@query("K05", "SELECT split_id, count(*) AS n FROM pred_v GROUP BY 1")
def k05(t):
    return S.with_manifest(t.pred_v.select("split_id", "case_id"), new_path(t.spark), "split_id", "case_id").drop("hash")


@query("K06", "SELECT source, row_index // 1000 AS block, count(*) AS n, string_agg(case_id, ';' ORDER BY row_index) AS skipped FROM cases_v WHERE text_a = 'N/A' GROUP BY ALL")
def k06(t):
    """Skipped cases as joined lists, one for each thousand of the table, so that no cell grows with it."""
    gone = t.cases_v.where(T.is_missing(F.col("text_a")))
    return S.joined_lists(gone, ["source", F.floor(F.col("row_index") / 1000).alias("block")], "row_index", "case_id", "skipped")


@query("K07")
def k07(t):
    from .analysis import x15

    path = new_path(t.spark)
    S.replace(x15(t), path)
    return t.spark.read.parquet(path)


@query("K08", """SELECT '{"id":' || event_id || ',"x":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '0.5' END || '}' AS value FROM events""")
def k08(t):
    x = F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(0.5)
    return S.json_safe(t.events.select(F.col("event_id").alias("id"), x.alias("x")))


# ----- costs


def _usage(t):
    return t.usage_v.select("mode", "conv_id", F.col("tokens").alias("fresh"), F.floor(F.col("tokens") / 4).alias("cached"), F.lit(50).cast("long").alias("output"))


TOTALS = "SELECT mode, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS fresh, CAST(sum(tokens // 4) AS BIGINT) AS cached, CAST(sum(50) AS BIGINT) AS output FROM usage_v GROUP BY 1"


@query("T25", "WITH e AS (SELECT mode, min(seq) AS first, list_min(list_filter(range(1, least(length(min(text)), length(max(text))) + 1), lambda i: min(text)[i] <> max(text)[i])) AS d, least(length(min(text)), length(max(text))) AS m FROM usage_v GROUP BY 1), p AS (SELECT mode, first, CAST(ceil(coalesce(d - 1, m) / 4.0) AS BIGINT) AS prefix FROM e) SELECT mode, count(*) AS calls, CAST(sum(tokens - CASE WHEN seq > first THEN least(tokens, prefix) ELSE 0 END) AS BIGINT) AS fresh, CAST(sum(CASE WHEN seq > first THEN least(tokens, prefix) ELSE 0 END) AS BIGINT) AS cached, count(*) * 100 AS output FROM usage_v JOIN p USING (mode) GROUP BY 1")
def t25(t):
    return P.estimate(t.usage_v, "mode", "seq", "text", 100)


@query("T26", f"WITH a AS ({TOTALS}) SELECT mode, measure, planned, actual, actual - planned AS delta, round(100 * (actual - planned) / planned, 6) AS percent FROM (SELECT mode, 'calls' AS measure, CAST(calls AS DOUBLE) AS planned, CAST(calls + 1 AS DOUBLE) AS actual FROM a UNION ALL SELECT mode, 'fresh', CAST(fresh AS DOUBLE), CAST(fresh * 2 AS DOUBLE) FROM a)")
def t26(t):
    planned = P.totals(_usage(t), ["mode"])
    actual = planned.withColumns({"calls": F.col("calls") + 1, "fresh": F.col("fresh") * 2})
    return P.comparison(planned, actual, ["mode"], ["calls", "fresh"]).withColumn("percent", F.round("percent", 6))


@query("T31", f"SELECT mode, round((fresh * CAST(1.25 AS DOUBLE) + cached * CAST(0.13 AS DOUBLE) + output * CAST(10.0 AS DOUBLE)) / 1000000, 6) AS cost, round(cached * CAST(1.12 AS DOUBLE) / 1000000, 6) AS savings FROM ({TOTALS})")
def t31(t):
    return P.priced(P.totals(_usage(t), ["mode"]), "large").select("mode", F.round("cost", 6).alias("cost"), F.round("savings", 6).alias("savings"))


# ----- extraction and resume


REQUESTS = "SELECT case_id, row_index, 'b' AS mode FROM cases_v"


def _requests(t):
    return t.cases_v.select("case_id", "row_index", F.lit("b").alias("mode"), F.lit("s0").alias("split_id"), F.lit("train").alias("split_role"), F.col("text_b").alias("text"))


@query("E03", "SELECT case_id FROM cases_v WHERE row_index % 4 <> 0")
def e03(t):
    done = _requests(t).where("row_index % 4 = 0")
    return E.pending(_requests(t), done).select("case_id")


RECORD = "case_id string, row_index long, mode string, split_id string, split_role string, phrases array<struct<concept:string,quote:string>>"


@query("E02")
def e02(t):
    """Records by the rule extractor, resumed: the second call finds all answered."""
    path = new_path(t.spark)
    E.resume(_requests(t).where("row_index % 2 = 0"), path, E.rule_extractor, RECORD)
    return E.resume(_requests(t), path, E.rule_extractor, RECORD).select("case_id", F.size("phrases").alias("n_phrases"))


@query("E05", "SELECT case_id, sha256('{\"mode\":\"b\",\"row_index\":' || row_index || '}') AS fingerprint FROM cases_v")
def e05(t):
    return t.cases_v.select("case_id", E.fingerprint(F.lit("b").alias("mode"), F.col("row_index")).alias("fingerprint"))


@query("E06", "SELECT DISTINCT w.split_id FROM (SELECT DISTINCT split_id, split_id % 3 AS cfg FROM pred_v) w JOIN (SELECT DISTINCT split_id, CASE WHEN split_id % 2 = 0 THEN split_id % 3 ELSE 9 END AS cfg FROM pred_v) m ON w.split_id = m.split_id AND w.cfg = m.cfg")
def e06(t):
    wanted = t.pred_v.select("split_id", (F.col("split_id") % 3).alias("cfg")).distinct()
    manifest = t.pred_v.select("split_id", F.when(F.col("split_id") % 2 == 0, F.col("split_id") % 3).otherwise(9).alias("cfg")).distinct()
    return E.completed(manifest, wanted, "split_id", ["cfg"]).select("split_id")


@query("E07", TOTALS)
def e07(t):
    """Counters of two sessions added up."""
    parts = [P.totals(_usage(t).where(w), ["mode"]) for w in ("conv_id % 2 = 0", "conv_id % 2 <> 0")]
    return S.union_all(parts).groupBy("mode").agg(*(F.sum(c).alias(c) for c in ("calls", "fresh", "cached", "output")))


@query("E08", "SELECT case_id, CASE WHEN max(y_bin) = 1 THEN 'only 1' ELSE 'only 0' END AS error FROM pred_v GROUP BY 1 HAVING min(y_bin) = max(y_bin)")
def e08(t):
    """Units that can't be fitted, as each has one class only, marked as failed."""
    return E.failed(t.pred_v, ["case_id"], "y_bin")


@query("E09", "SELECT n_nationkey, 'kept' AS state FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey >= 5")
def e09(t):
    have = t.nation.where("n_nationkey < 5").select("n_nationkey", F.lit("kept").alias("state"))
    return E.insert_if_absent(have, t.nation.select("n_nationkey", F.lit("new").alias("state")), ["n_nationkey"])


# ----- models


FEATURES = ["y_prob", "site", "parity"]


def _cohort(t, target: str):
    """All cases in three splits."""
    p = t.pred_v.withColumn("split", F.pmod("case_id", F.lit(3)))
    return p.select("split", "row_id", "role", F.col(target).cast("double").alias("target"), "y_prob", F.col("site").cast("double").alias("site"), (F.col("row_id") % 2).cast("double").alias("parity"), F.col("y_bin").cast("double").alias("relapse"))


def _fits(name, models, target):
    @query(name)
    def run(t):
        return B.predictions(_cohort(t, target), ["split"], FEATURES, models)

    return run


_fits("B01", ["ridge", "ridge_logistic"][:1], "y_value")
_fits("B03", ["ridge_logistic"], "y_bin")
_fits("B04", ["ridge_logistic", "elastic_net_logistic"], "y_bin")
_fits("B05", ["linear_svm"], "y_bin")
_fits("B06", ["ridge", "elastic_net"], "y_value")
_fits("B07", ["pls_regression"], "y_value")
_fits("B08", ["linear_svr"], "y_value")
_fits("B09", ["huber"], "y_value")


@query("B02", "SELECT split_id, greatest(2, least(5, CAST(least(sum(y_bin), count(*) - sum(y_bin)) AS BIGINT))) AS folds FROM pred_v GROUP BY 1")
def b02(t):
    rare = F.least(F.sum("y_bin"), F.count("*") - F.sum("y_bin"))
    return t.pred_v.groupBy("split_id").agg(F.greatest(F.lit(2), F.least(F.lit(5), rare)).cast("long").alias("folds"))


@query("B10")
def b10(t):
    return B.teacher_student(_cohort(t, "y_value"), ["split"], FEATURES, ["site", "parity"], 85.0)


@query("B11")
def b11(t):
    return B.coefficients(_cohort(t, "y_value"), ["split"], FEATURES, ["ridge", "elastic_net", "pls_regression"])


@query("M12")
def m12(t):
    return B.calibrated(t.pred_v, ["model_key"], "y_bin", "y_prob")


@query("P13", "SELECT id, feature, value FROM (UNPIVOT (SELECT id, x AS grp__x__present, y AS phr__y__present FROM pairs_v) ON grp__x__present, phr__y__present INTO NAME feature VALUE value) WHERE starts_with(feature, 'grp__')")
def p13(t):
    long = t.pairs_v.select("id", F.col("x").alias("grp__x__present"), F.col("y").alias("phr__y__present")).unpivot("id", ["grp__x__present", "phr__y__present"], "feature", "value")
    return long.where(F.startswith("feature", F.lit("grp__")))


@query("P18", "SELECT c_custkey, c_acctbal AS balance FROM customer")
def p18(t):
    names = {c.lower(): c for c in t.customer.columns}
    found = next(names[c] for c in ("balance", "C_ACCTBAL".lower()) if c in names)
    return t.customer.select("c_custkey", F.col(found).alias("balance"))


@query("M13", "SELECT model_key, count(*) AS n, round(avg(CAST((y_true >= 150000) = (y_bin = 1) AS INT)), 6) AS accuracy FROM pred_v WHERE role = 'test' GROUP BY 1")
def m13(t):
    ok = ((F.col("y_true") >= 150000) == (F.col("y_bin") == 1)).cast("int")
    return t.pred_v.where("role = 'test'").groupBy("model_key").agg(F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("accuracy"))


@query("H12", "SELECT CAST(least(greatest(floor(y / 2.0 + 1), 1), 25) AS BIGINT) AS bin, count(*) AS n FROM pairs_v GROUP BY 1")
def h12(t):
    """Histogram of 25 equal bins, the table behind a residual plot."""
    b = F.least(F.greatest(F.floor(F.col("y") / 2.0 + 1), F.lit(1)), F.lit(25)).cast("long")
    return t.pairs_v.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


# ----- planning


@query("P28", "SELECT needed AS mode, count(*) AS n FROM usage_v JOIN (VALUES ('mode0', 'a'), ('mode1', 'b'), ('mode2', 'a'), ('mode2', 'b')) m(mode, needed) USING (mode) GROUP BY 1")
def p28(t):
    """Calls for each text that the modes in use need: single texts, however they are combined later."""
    return E.needed(t.usage_v.select("mode"), {"mode0": ["a"], "mode1": ["b"], "mode2": ["a", "b"]}, "mode").groupBy(F.col("needed").alias("mode")).agg(F.count("*").alias("n"))


@query("P32", "SELECT c_custkey AS custkey, c_nationkey AS nationkey, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def p32(t):
    """Tables joined on the key columns that both have."""
    bare = lambda df, p: df.select(*(F.col(c).alias(c.removeprefix(p)) for c in df.columns))
    a, b = bare(t.customer, "c_"), bare(t.supplier, "s_").withColumnRenamed("suppkey", "custkey").withColumnRenamed("name", "s_name").drop("acctbal")
    keys = [c for c in a.columns if c in b.columns]
    return a.join(b, keys).select("custkey", "nationkey", "s_name")


def _post(message):
    """A local stand-in for the service, which echoes a length and says what it used."""
    text = message["messages"][-1]["content"]
    tokens = -(-len(text) // 4)
    return {"choices": [{"message": {"content": json.dumps({"length": len(text)})}}], "usage": {"prompt_tokens": tokens, "prompt_tokens_details": {"cached_tokens": tokens // 2}, "completion_tokens": 7}}


def _is_object(answer):
    return answer.startswith("{")


@query("E01", "SELECT case_id, length(text_b) AS length, 1 AS attempts, CAST(ceil(length(text_b) / 4.0) AS BIGINT) - CAST(ceil(length(text_b) / 4.0) AS BIGINT) // 2 AS fresh, CAST(ceil(length(text_b) / 4.0) AS BIGINT) // 2 AS cached, 7 AS output FROM cases_v")
def e01(t):
    """One chat call per request with its usage, here with a local stand-in for the service."""
    got = E.usage(E.chat_extractor(_post, _is_object)(_requests(t).select("case_id", "text")))
    return got.select("case_id", F.from_json("answer", "length long")["length"].alias("length"), "attempts", "fresh", "cached", "output")


@query("E04", "SELECT count(*) AS n, true AS capped FROM cases_v")
def e04(t):
    """At most two tasks ask at a time."""
    got = E.chat_extractor(_post, _is_object, most_at_once=2)(_requests(t).select("case_id", "text"))
    return got.withColumn("task", F.spark_partition_id()).agg(F.count("*").alias("n"), (F.count_distinct("task") <= 2).alias("capped"))