"""Queries of the join, aggregation, set, sort and reshape inventories (J, A, U, L, R)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import ranks as R
from ..operators import recode as Q
from .registry import query


@query("J01", "SELECT c_custkey, n_orders, n_urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j01(t):
    got = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))
    return t.customer.select("c_custkey").join(got, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@query("J02", "SELECT coalesce(a.k, b.k) AS k, a.x AS a__x, b.x AS b__x FROM (SELECT l_partkey % 97 AS k, sum(l_linenumber) AS x FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 97 < 60 GROUP BY 1) a FULL JOIN (SELECT l_partkey % 97 AS k, sum(l_linenumber) AS x FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 97 > 30 GROUP BY 1) b ON a.k = b.k")
def j02(t):
    side = lambda flag, where, name: t.lineitem.where((F.col("l_returnflag") == flag) & where).groupBy((F.col("l_partkey") % 97).alias("k")).agg(F.sum("l_linenumber").alias(f"{name}__x"))
    return side("R", F.col("l_partkey") % 97 < 60, "a").join(side("A", F.col("l_partkey") % 97 > 30, "b"), "k", "full_outer")


@query("J03", "SELECT a.case_id, a.n AS n__a, b.n AS n__b FROM (SELECT case_id, count(*) AS n FROM pred_v WHERE role = 'train' GROUP BY 1) a JOIN (SELECT case_id, count(*) AS n FROM pred_v WHERE role = 'test' GROUP BY 1) b USING (case_id)")
def j03(t):
    side = lambda role, name: t.pred_v.where(F.col("role") == role).groupBy("case_id").agg(F.count("*").alias(name))
    return side("train", "n__a").join(side("test", "n__b"), "case_id")


@query("J04", "SELECT t.row_id, t.y_prob AS teacher, s.acct AS student FROM pred_v t JOIN (SELECT c_custkey, c_acctbal AS acct FROM customer WHERE c_acctbal > 0) s ON t.case_id = s.c_custkey WHERE t.model_key IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_totalprice > 300000)")
def j04(t):
    student = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("case_id"), F.col("c_acctbal").alias("student"))
    models = t.orders.where("o_totalprice > 300000").select(F.col("o_orderpriority").alias("model_key"))
    return t.pred_v.join(models, "model_key", "left_semi").join(student, "case_id").select("row_id", F.col("y_prob").alias("teacher"), "student")


@query("J05", "SELECT case_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM cases_v LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = row_index LEFT JOIN (SELECT c_custkey, count(*) AS m FROM customer GROUP BY 1) ON c_custkey = row_index")
def j05(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("row_index")).agg(F.count("*").alias("n"))
    b = t.customer.groupBy(F.col("c_custkey").alias("row_index")).agg(F.count("*").alias("m"))
    return t.cases_v.join(a, "row_index", "left").join(b, "row_index", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


@query("J06", "SELECT row_id, source, lang FROM pred_v LEFT JOIN cases_v ON row_index = row_id WHERE y_bin = 1 AND y_prob < 0.2")
def j06(t):
    flags = t.cases_v.select(F.col("row_index").alias("row_id"), "source", "lang")
    return t.pred_v.where("y_bin = 1 AND y_prob < 0.2").select("row_id").join(flags, "row_id", "left")


def paired(a, b, on: list[str], how: str = "outer", suffixes: tuple[str, str] = ("a", "b")):
    """Join with a merge indicator: both, left_only or right_only."""
    left, right = a.withColumn("__l", F.lit(True)), b.withColumn("__r", F.lit(True))
    which = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return left.join(right, on, how).withColumn("merge", which).drop("__l", "__r")


@query("J07", "SELECT coalesce(a.k, b.k) AS k, x, y, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge FROM (SELECT c_custkey AS k, c_acctbal AS x FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS y FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1) b ON a.k = b.k")
def j07(t):
    a = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    b = t.orders.where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("y"))
    return paired(a, b, ["k"])


@query("J08", "SELECT case_id, round(avg(y_prob), 8) AS p, count(*) AS n_rows FROM pred_v GROUP BY 1")
def j08(t):
    return t.pred_v.groupBy("case_id").agg(F.round(F.avg("y_prob"), 8).alias("p"), F.count("*").alias("n_rows"))


@query("J09", "SELECT a.run_id, a.value AS best, b.value AS n FROM (SELECT run_id, CASE WHEN modality <> 'm0' THEN modality END AS m, max(value) AS value FROM metric_v WHERE raw_metric = 'AUROC' GROUP BY ALL) a JOIN (SELECT run_id, CASE WHEN modality <> 'm0' THEN modality END AS m, max(value) AS value FROM metric_v WHERE raw_metric = 'n' GROUP BY ALL) b ON a.run_id = b.run_id AND a.m IS NOT DISTINCT FROM b.m")
def j09(t):
    side = lambda k: t.metric_v.where(F.col("raw_metric") == k).groupBy("run_id", F.when(F.col("modality") != "m0", F.col("modality")).alias("m")).agg(F.max("value").alias("value"))
    a, b = side("AUROC").alias("a"), side("n").alias("b")
    return a.join(b, F.col("a.run_id").eqNullSafe(F.col("b.run_id")) & F.col("a.m").eqNullSafe(F.col("b.m"))).select("a.run_id", F.col("a.value").alias("best"), F.col("b.value").alias("n"))


@query("J10", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j10(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("J11", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j11(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("J12", "SELECT doc_id, word FROM documents, (VALUES ('nation'), ('thing'), ('ention'), ('zzz')) w(word) WHERE contains(lower(text), word)")
def j12(t):
    lexicon = t.spark.createDataFrame([("nation",), ("thing",), ("ention",), ("zzz",)], "phrase string")
    return Q.find_phrases(t.documents.select("doc_id", F.lower("text").alias("text")), lexicon, "doc_id", "text").withColumnRenamed("phrase", "word")


@query("J13", "SELECT a.l_shipdate_month AS a, b.l_shipdate_month AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, month(l_shipdate) AS l_shipdate_month FROM lineitem WHERE l_returnflag = 'R') a JOIN (SELECT DISTINCT l_orderkey, month(l_shipdate) AS l_shipdate_month FROM lineitem WHERE l_returnflag = 'N') b USING (l_orderkey) GROUP BY 1, 2")
def j13(t):
    side = lambda flag, name: t.lineitem.where(F.col("l_returnflag") == flag).select("l_orderkey", F.month("l_shipdate").cast("long").alias(name)).distinct()
    return side("R", "a").join(side("N", "b"), "l_orderkey").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("J14", "SELECT scenario, price, tier FROM (VALUES ('cold'), ('warm')) s(scenario), (VALUES ('small'), ('large')) p(price), (SELECT DISTINCT l_returnflag AS tier FROM lineitem)")
def j14(t):
    s = t.spark.createDataFrame([("cold",), ("warm",)], "scenario string")
    p = t.spark.createDataFrame([("small",), ("large",)], "price string")
    return t.lineitem.select(F.col("l_returnflag").alias("tier")).distinct().crossJoin(F.broadcast(s)).crossJoin(F.broadcast(p))


@query("J15", "SELECT s_suppkey, n_name, coalesce(k, 0) AS k FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT n_regionkey AS r, count(*) AS k FROM nation WHERE n_regionkey < 3 GROUP BY 1) ON r = n_regionkey")
def j15(t):
    n = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    k = t.nation.where("n_regionkey < 3").groupBy("n_regionkey").agg(F.count("*").alias("k"))
    return t.supplier.join(F.broadcast(n), "s_nationkey", "left").join(F.broadcast(k), "n_regionkey", "left").select("s_suppkey", "n_name", F.coalesce("k", F.lit(0)).alias("k"))


@query("J16", "SELECT e.event_id, coalesce(a.o_orderpriority, b.c_mktsegment) AS label FROM events e LEFT JOIN orders a ON a.o_orderkey = e.event_id LEFT JOIN customer b ON b.c_custkey = e.user_id")
def j16(t):
    a = t.orders.select(F.col("o_orderkey").alias("event_id"), "o_orderpriority")
    b = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return t.events.select("event_id", "user_id").join(a, "event_id", "left").join(b, "user_id", "left").select("event_id", F.coalesce("o_orderpriority", "c_mktsegment").alias("label"))


@query("J17", "SELECT row_id, y_prob, y_true FROM pred_v WHERE role = 'test'")
def j17(t):
    """Predictions meet their rows by key, never by position."""
    return t.pred_v.where("role = 'test'").select("row_id", "y_prob").join(t.pred_v.select("row_id", "y_true"), "row_id")


# ----- aggregates


@query("A01", "SELECT user_id, count(DISTINCT event_type) AS n_types, count(*) AS n, round(sum(value), 4) AS s, count(*) FILTER (value > 50) AS n_high FROM events GROUP BY 1")
def a01(t):
    return t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("n_types"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"), F.count_if(F.col("value") > 50).alias("n_high"))


@query("A02", "SELECT o_custkey, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS n_known, count(*) FILTER (o_orderstatus = 'P') AS n_other FROM orders GROUP BY 1")
def a02(t):
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus").isin("F", "O")).alias("n_known"), F.count_if(F.col("o_orderstatus") == "P").alias("n_other"))


@query("A03", "SELECT label, value_, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS sd, count(*) AS n FROM (SELECT 'status' AS label, CAST(o_orderstatus = 'F' AS INT) AS value_, length(o_orderpriority) * 1.0 AS x FROM orders UNION ALL SELECT 'even', CAST(o_orderkey % 2 AS INT), length(o_orderpriority) * 1.0 FROM orders) GROUP BY 1, 2 HAVING (SELECT count(DISTINCT o_orderstatus) FROM orders) >= 2")
def a03(t):
    x = t.orders.select((F.col("o_orderstatus") == "F").cast("int").alias("status"), (F.col("o_orderkey") % 2).cast("int").alias("even"), F.length("o_orderpriority").cast("double").alias("x"))
    long = x.unpivot("x", ["status", "even"], "label", "value_")
    got = long.groupBy("label", "value_").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.median("x"), 4).alias("median"), F.round(F.stddev_samp("x"), 4).alias("sd"), F.count("*").alias("n"))
    return got.withColumn("k", F.count("*").over(Window.partitionBy("label"))).where("k >= 2").drop("k")


@query("A04", "SELECT l_shipdate, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a04(t):
    return t.lineitem.groupBy("l_shipdate", "l_returnflag").agg(F.count("*").alias("n"))


SUPPORT = "s AS (SELECT r AS resample, l_returnflag || l_suppkey % 40 AS feature, count(DISTINCT l_orderkey) AS support FROM lineitem, range(10) x(r) WHERE (l_orderkey * 31 + r * 17) % 10 < 5 GROUP BY ALL)"


def _support(t):
    member = F.explode(F.filter(F.expr("sequence(0L, 9L)"), lambda k: F.pmod(F.col("l_orderkey") * 31 + k * 17, F.lit(10)) < 5)).alias("resample")
    rows = t.lineitem.select("l_orderkey", F.concat("l_returnflag", F.col("l_suppkey") % 40).alias("feature"), member)
    return rows.groupBy("resample", "feature").agg(F.count_distinct("l_orderkey").alias("support"))


@query("A05", f"WITH {SUPPORT} SELECT resample, feature, support FROM s")
def a05(t):
    return _support(t)


@query("A06", f"WITH {SUPPORT} SELECT feature, round(count(*) FILTER (support >= 120) / 10.0, 6) AS frequency, round(sum(support) / 10.0, 6) AS mean_support, count(*) FILTER (support >= 120) >= 6 AS stable FROM s GROUP BY 1")
def a06(t):
    n = F.count_if(F.col("support") >= 120)
    return _support(t).groupBy("feature").agg(F.round(n / 10.0, 6).alias("frequency"), F.round(F.sum("support") / 10.0, 6).alias("mean_support"), (n >= 6).alias("stable"))


@query("A07", "SELECT dataset_key, model_key, count(DISTINCT split_id) AS n_splits FROM pred_v WHERE y_prob > 0.9 GROUP BY 1, 2")
def a07(t):
    return t.pred_v.where("y_prob > 0.9").groupBy("dataset_key", "model_key").agg(F.count_distinct("split_id").alias("n_splits"))


@query("A12", "SELECT coalesce(a.k, b.k) AS mode, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_stable, 0) AS n_stable FROM (SELECT l_returnflag AS k, count(DISTINCT l_partkey) AS n_candidates FROM lineitem GROUP BY 1) a FULL JOIN (SELECT o_orderstatus AS k, count(*) AS n_stable FROM orders WHERE o_totalprice > 200000 GROUP BY 1) b ON a.k = b.k")
def a12(t):
    a = t.lineitem.groupBy(F.col("l_returnflag").alias("mode")).agg(F.count_distinct("l_partkey").alias("n_candidates"))
    b = t.orders.where("o_totalprice > 200000").groupBy(F.col("o_orderstatus").alias("mode")).agg(F.count("*").alias("n_stable"))
    return a.join(b, "mode", "full_outer").select("mode", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_stable", F.lit(0)).alias("n_stable"))


@query("A13", "SELECT p_brand, round(avg(p_size), 6) AS mean_size FROM part GROUP BY 1")
def a13(t):
    return t.part.groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("mean_size"))


@query("A16", "SELECT case_id, round(avg(y_prob), 8) AS p, max(y_bin) AS label, count(*) AS n FROM pred_v GROUP BY 1")
def a16(t):
    return t.pred_v.groupBy("case_id").agg(F.round(F.avg("y_prob"), 8).alias("p"), F.max("y_bin").alias("label"), F.count("*").alias("n"))


@query("A17", "SELECT case_id, any_value(CASE WHEN has_test THEN 'test' ELSE 'train' END) AS role, round(avg(y_prob), 6) AS p FROM (SELECT *, bool_or(role = 'test') OVER (PARTITION BY case_id) AS has_test FROM pred_v) WHERE role = 'test' OR NOT has_test GROUP BY 1")
def a17(t):
    test = F.col("role") == "test"
    got = t.pred_v.groupBy("case_id").agg(F.avg(F.when(test, F.col("y_prob"))).alias("a"), F.avg(F.when(~test, F.col("y_prob"))).alias("b"))
    return got.select("case_id", F.when(F.col("a").isNotNull(), "test").otherwise("train").alias("role"), F.round(F.coalesce("a", "b"), 6).alias("p"))


@query("A18", "SELECT case_id, round(median(y_prob), 6) AS p, string_agg(DISTINCT CAST(split_id AS VARCHAR), ';' ORDER BY CAST(split_id AS VARCHAR)) AS splits FROM pred_v GROUP BY 1")
def a18(t):
    return t.pred_v.groupBy("case_id").agg(F.round(F.median("y_prob"), 6).alias("p"), F.array_join(F.sort_array(F.collect_set(F.col("split_id").cast("string"))), ";").alias("splits"))


@query("A19", "SELECT case_id, count(DISTINCT role) AS n_roles FROM pred_v GROUP BY 1 HAVING count(DISTINCT role) > 1")
def a19(t):
    return t.pred_v.groupBy("case_id").agg(F.count_distinct("role").alias("n_roles")).where("n_roles > 1")


@query("A20", "SELECT mode, count(*) AS calls, count(DISTINCT conv_id) AS cases, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(tokens), 4) AS mean, median(tokens) AS median FROM usage_v GROUP BY 1")
def a20(t):
    return t.usage_v.groupBy("mode").agg(F.count("*").alias("calls"), F.count_distinct("conv_id").alias("cases"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 4).alias("mean"), F.median("tokens").alias("median"))


@query("A21", "SELECT price, cached, round(sum(tokens) * (CASE WHEN cached THEN CASE price WHEN 'small' THEN CAST(0.01 AS DOUBLE) ELSE 0.13 END ELSE CASE price WHEN 'small' THEN CAST(0.05 AS DOUBLE) ELSE 1.25 END END) / 1000000, 6) AS cost FROM usage_v, (VALUES ('small'), ('large')) p(price), (VALUES (true), (false)) c(cached) GROUP BY 1, 2")
def a21(t):
    rows = [("small", True, 0.01), ("small", False, 0.05), ("large", True, 0.13), ("large", False, 1.25)]
    prices = t.spark.createDataFrame(rows, "price string, cached boolean, per_million double")
    return t.usage_v.agg(F.sum("tokens").alias("n")).crossJoin(F.broadcast(prices)).select("price", "cached", F.round(F.col("n") * F.col("per_million") / 1_000_000, 6).alias("cost"))


@query("A22", "SELECT model_key, count(*) AS n, round(avg(k), 6) AS mean, median(k) AS median, min(k) AS min, max(k) AS max FROM (SELECT model_key, split_id, count(*) AS k FROM pred_v GROUP BY 1, 2) GROUP BY 1")
def a22(t):
    k = t.pred_v.groupBy("model_key", "split_id").agg(F.count("*").alias("k"))
    return k.groupBy("model_key").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("mean"), F.median("k").alias("median"), F.min("k").alias("min"), F.max("k").alias("max"))


@query("A23", "SELECT role, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage_v GROUP BY 1")
def a23(t):
    return t.usage_v.groupBy("role").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


@query("A24", "SELECT run_id, round(sum(value), 4) AS total FROM metric_v m WHERE raw_metric = 'n' AND NOT EXISTS (SELECT 1 FROM metric_v x WHERE x.run_id = m.run_id AND x.raw_metric = 'AUROC' AND x.value > 0.53) GROUP BY 1")
def a24(t):
    whole = t.metric_v.where("raw_metric = 'AUROC' AND value > 0.53").select("run_id")
    return t.metric_v.where("raw_metric = 'n'").join(whole, "run_id", "left_anti").groupBy("run_id").agg(F.round(F.sum("value"), 4).alias("total"))


@query("A25", "SELECT run_id, count(*) FILTER (raw_metric = 'AUROC' AND target = 'relapse') AS n_auroc, count(*) FILTER (raw_metric = 'mae' AND target = 'score') AS n_mae, count(*) FILTER (raw_metric = 'f1') > 0 AS has_f1 FROM metric_v GROUP BY 1")
def a25(t):
    is_ = lambda m, g: (F.col("raw_metric") == m) & (F.col("target") == g)
    return t.metric_v.groupBy("run_id").agg(F.count_if(is_("AUROC", "relapse")).alias("n_auroc"), F.count_if(is_("mae", "score")).alias("n_mae"), (F.count_if(F.col("raw_metric") == "f1") > 0).alias("has_f1"))


@query("A26", "SELECT run_id, modality, max(value) AS best FROM metric_v WHERE raw_metric = 'AUROC' GROUP BY 1, 2")
def a26(t):
    return t.metric_v.where("raw_metric = 'AUROC'").groupBy("run_id", "modality").agg(F.max("value").alias("best"))


@query("A28", "SELECT run_id, round(a, 9) AS relapse, round(b, 9) AS score, round(a - b, 9) AS difference FROM (SELECT run_id, avg(value) FILTER (target = 'relapse') AS a, avg(value) FILTER (target = 'score') AS b FROM metric_v WHERE raw_metric = 'AUROC' GROUP BY 1)")
def a28(t):
    got = t.metric_v.where("raw_metric = 'AUROC'").groupBy("run_id").pivot("target", ["relapse", "score"]).agg(F.avg("value"))
    return got.select("run_id", F.round("relapse", 9).alias("relapse"), F.round("score", 9).alias("score"), F.round(F.col("relapse") - F.col("score"), 9).alias("difference"))


@query("A29", "SELECT split_id, n, coalesce(done, false) AS done FROM (SELECT split_id, count(*) AS n FROM pred_v GROUP BY 1) LEFT JOIN (SELECT DISTINCT split_id, true AS done FROM pred_v WHERE y_prob > 0.9985) USING (split_id)")
def a29(t):
    done = t.pred_v.where("y_prob > 0.9985").select("split_id", F.lit(True).alias("done")).distinct()
    return t.pred_v.groupBy("split_id").agg(F.count("*").alias("n")).join(done, "split_id", "left").select("split_id", "n", F.coalesce("done", F.lit(False)).alias("done"))


STOP = ", ".join("'" + w + "'" for w in __import__("textcohort.functions.constants", fromlist=["STOPWORDS"]).STOPWORDS)
EVIDENCE = rf"""x AS (SELECT d.doc_id, toxic AS y, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s\-/]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND w NOT IN ({STOP})))) AS term FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
 k AS (SELECT term, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM x GROUP BY 1), n AS (SELECT count(*) FILTER (toxic = 1) AS t1, count(*) FILTER (toxic = 0) AS t0 FROM documents JOIN labels USING (doc_id))"""


def evidence(t):
    """Term by class counts, distinct per case, with odds ratios smoothed by one half."""
    labelled = t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("toxic").alias("y"))
    terms = labelled.select("doc_id", "y", F.explode(F.array_distinct(T.evidence_tokens(F.col("text")))).alias("term"))
    k = terms.groupBy("term").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    n = labelled.agg(F.count_if(F.col("y") == 1).alias("t1"), F.count_if(F.col("y") == 0).alias("t0"))
    ratio = ((F.col("n1") + 0.5) * (F.col("t0") - F.col("n0") + 0.5)) / ((F.col("n0") + 0.5) * (F.col("t1") - F.col("n1") + 0.5))
    return k.crossJoin(F.broadcast(n)).select("term", "n1", "n0", F.round(ratio, 6).alias("odds_ratio"))


ODDS = "round(((n1 + 0.5) * (t0 - n0 + 0.5)) / ((n0 + 0.5) * (t1 - n1 + 0.5)), 6) AS odds_ratio"


@query("A30", f"WITH {EVIDENCE} SELECT term, n1, n0, {ODDS} FROM k, n")
def a30(t):
    return evidence(t)


@query("L03", f"WITH {EVIDENCE} SELECT term, n1 + n0 AS support, {ODDS} FROM k, n WHERE n1 + n0 >= 3 ORDER BY odds_ratio DESC, term LIMIT 15")
def l03(t):
    return evidence(t).withColumn("support", F.col("n1") + F.col("n0")).where("support >= 3").orderBy(F.desc("odds_ratio"), "term").limit(15).select("term", "support", "odds_ratio")


@query("Q12", f"WITH {EVIDENCE} SELECT direction, term, odds_ratio FROM (SELECT CASE WHEN odds_ratio >= 1 THEN 'for' ELSE 'against' END AS direction, term, odds_ratio, row_number() OVER (PARTITION BY odds_ratio >= 1 ORDER BY abs(ln(odds_ratio)) DESC, term) AS i FROM (SELECT term, {ODDS} FROM k, n WHERE n1 + n0 >= 3)) WHERE i <= 10")
def q12(t):
    d = evidence(t).where("n1 + n0 >= 3").withColumn("direction", F.when(F.col("odds_ratio") >= 1, "for").otherwise("against"))
    return R.top_rows(d, ["direction"], [F.desc(F.abs(F.ln("odds_ratio"))), F.asc("term")], 10).select("direction", "term", "odds_ratio")


# ----- sorts, sets


@query("L01", "SELECT run_id, modality, raw_metric, value, row_number() OVER (PARTITION BY run_id ORDER BY value DESC NULLS LAST, modality, raw_metric) AS place FROM metric_v")
def l01(t):
    return R.top_rows(t.metric_v, ["run_id"], [F.desc_nulls_last("value"), F.asc("modality"), F.asc("raw_metric")], 10**9, "place").select("run_id", "modality", "raw_metric", "value", "place")


@query("L02", f"WITH {SUPPORT} SELECT feature, round(count(*) FILTER (support >= 100) / 10.0, 6) AS frequency, round(sum(support) / 10.0, 6) AS mean_support FROM s GROUP BY 1 ORDER BY frequency DESC, mean_support DESC, feature LIMIT 20")
def l02(t):
    got = _support(t).groupBy("feature").agg(F.round(F.count_if(F.col("support") >= 100) / 10.0, 6).alias("frequency"), F.round(F.sum("support") / 10.0, 6).alias("mean_support"))
    return got.orderBy(F.desc("frequency"), F.desc("mean_support"), "feature").limit(20)


@query("L07", "SELECT case_id, relapse, score FROM cases_v ORDER BY relapse NULLS LAST, score DESC NULLS LAST, case_id LIMIT 100")
def l07(t):
    return t.cases_v.select("case_id", "relapse", "score").orderBy(F.asc_nulls_last("relapse"), F.desc_nulls_last("score"), "case_id").limit(100)


@query("L08", "SELECT row_index, lang FROM cases_v WHERE row_index < 50")
def l08(t):
    return t.cases_v.where("row_index < 50").select("row_index", "lang")


@query("L10", "SELECT target, modality, raw_metric, value FROM metric_v ORDER BY target, modality, raw_metric, value LIMIT 80")
def l10(t):
    return t.metric_v.select("target", "modality", "raw_metric", "value").orderBy("target", "modality", "raw_metric", "value").limit(80)


@query("U01", "SELECT o_orderkey AS id, 'order' AS kind, o_orderstatus AS s, NULL AS v FROM orders UNION ALL SELECT event_id, 'event', NULL, value FROM events")
def u01(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("s"))
    b = t.events.select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), F.col("value").alias("v"))
    return a.unionByName(b, allowMissingColumns=True)


@query("U02", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def u02(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("U03", "SELECT p_brand AS name FROM part UNION SELECT p_type FROM part UNION SELECT n_name FROM nation")
def u03(t):
    return t.part.select(F.col("p_brand").alias("name")).union(t.part.select("p_type")).union(t.nation.select("n_name")).distinct()


@query("U04", "SELECT 'both' AS kind, k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000) UNION ALL SELECT 'only', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def u04(t):
    a, b = t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "k").unionAll(a.subtract(b).select(F.lit("only").alias("kind"), "k"))


@query("U05", "SELECT h, max_by(split_id, (n, split_id)) AS split_id FROM (SELECT split_id, count(*) AS n, sum(y_bin) % 3 AS h FROM pred_v GROUP BY 1) GROUP BY 1")
def u05(t):
    s = t.pred_v.groupBy("split_id").agg(F.count("*").alias("n"), (F.sum("y_bin") % 3).alias("h"))
    return s.groupBy("h").agg(F.max(F.struct("n", "split_id")).alias("b")).select("h", "b.split_id")


@query("U06", "SELECT k, n FROM (UNPIVOT (SELECT count(*) FILTER (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus) AS status, count(*) FILTER (a.o_custkey IS DISTINCT FROM b.o_custkey) AS cust FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 4) ON status, cust INTO NAME k VALUE n)")
def u06(t):
    a, b = t.orders.alias("a"), t.orders.withColumn("o_orderkey", F.col("o_orderkey") - 4).alias("b")
    differs = lambda c: F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")))
    got = a.join(b, F.col("a.o_orderkey") == F.col("b.o_orderkey")).agg(differs("o_orderstatus").alias("status"), differs("o_custkey").alias("cust"))
    return got.unpivot([], ["status", "cust"], "k", "n")


@query("U07", "SELECT run_id, modality, raw_metric FROM metric_v m WHERE raw_metric <> 'n' OR NOT EXISTS (SELECT 1 FROM metric_v x WHERE x.run_id = m.run_id AND x.modality = m.modality AND x.raw_metric = 'mae' AND x.value < 0.05)")
def u07(t):
    first = t.metric_v.where("raw_metric = 'mae' AND value < 0.05").select("run_id", "modality", F.lit("n").alias("raw_metric"))
    return t.metric_v.select("run_id", "modality", "raw_metric").join(first, ["run_id", "modality", "raw_metric"], "left_anti")


# ----- reshapes


@query("R02", "SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent__count, coalesce(max(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 0) AS urgent__max, count(*) FILTER (o_orderpriority = '5-LOW') AS low__count, coalesce(max(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 0) AS low__max FROM orders GROUP BY 1")
def r02(t):
    got = t.orders.groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count("o_totalprice").alias("count"), F.max("o_totalprice").alias("max"))
    names = {"1-URGENT": "urgent", "5-LOW": "low"}
    return got.select("o_custkey", *(F.coalesce(F.col(f"`{k}_{a}`"), F.lit(0)).alias(f"{n}__{a}") for k, n in names.items() for a in ("count", "max")))


@query("R03", "SELECT user_id, CAST(max(CAST(event_type = 'click' AS INT)) AS INT) AS click, CAST(max(CAST(event_type = 'view' AS INT)) AS INT) AS view FROM events GROUP BY 1")
def r03(t):
    got = t.events.withColumn("one", F.lit(1)).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max("one"))
    return got.select("user_id", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("view", F.lit(0)).alias("view"))


@query("R04", "SELECT c_custkey AS k, 'a__' || c_mktsegment AS feature, c_acctbal AS value FROM customer UNION ALL SELECT o_custkey, 'b__' || o_orderpriority, round(sum(o_totalprice), 2) FROM orders GROUP BY 1, 2")
def r04(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.concat(F.lit("a__"), "c_mktsegment").alias("feature"), F.col("c_acctbal").alias("value"))
    b = t.orders.groupBy(F.col("o_custkey").alias("k"), F.concat(F.lit("b__"), "o_orderpriority").alias("feature")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return a.unionByName(b)


@query("R05", "SELECT DISTINCT case_id, dataset_key, site FROM pred_v")
def r05(t):
    return t.pred_v.select("case_id", "dataset_key", "site").distinct()


@query("R06", "SELECT modality, round(avg(value) FILTER (run_id = 'AF'), 6) AS \"AF\", round(avg(value) FILTER (run_id = 'RF'), 6) AS \"RF\" FROM metric_v WHERE raw_metric = 'AUROC' GROUP BY 1")
def r06(t):
    got = t.metric_v.where("raw_metric = 'AUROC'").groupBy("modality").pivot("run_id", ["AF", "RF"]).agg(F.avg("value"))
    return got.select("modality", F.round("AF", 6).alias("AF"), F.round("RF", 6).alias("RF"))


@query("R07", "SELECT run_id, max(value) FILTER (raw_metric = 'n') AS n, max(value) FILTER (raw_metric = 'mae') AS mae FROM metric_v GROUP BY 1")
def r07(t):
    return t.metric_v.groupBy("run_id").pivot("raw_metric", ["n", "mae"]).agg(F.max("value"))


@query("R08", "SELECT p_partkey, name, value FROM (UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) ON size, price INTO NAME name VALUE value)")
def r08(t):
    wide = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "name", "value").where("value IS NOT NULL")


@query("R09", "SELECT raw_metric, printf('%.6f', max(value) FILTER (run_id = 'AF')) || ' vs ' || printf('%.6f', max(value) FILTER (run_id = 'RF')) AS cell FROM metric_v WHERE raw_metric <> 'n' GROUP BY 1")
def r09(t):
    got = t.metric_v.where("raw_metric <> 'n'").groupBy("raw_metric").pivot("run_id", ["AF", "RF"]).agg(F.max("value"))
    return got.select("raw_metric", F.when(F.col("AF").isNotNull() & F.col("RF").isNotNull(), F.format_string("%.6f vs %.6f", "AF", "RF")).alias("cell"))


@query("R10", "SELECT a.modality, a.value AS a__value, b.value AS b__value FROM metric_v a JOIN metric_v b ON a.modality = b.modality AND a.raw_metric = 'mae' AND b.raw_metric = 'mae' AND a.run_id = 'AF' AND b.run_id = 'RF'")
def r10(t):
    side = lambda run, name: t.metric_v.where((F.col("raw_metric") == "mae") & (F.col("run_id") == run)).select("modality", F.col("value").alias(f"{name}__value"))
    return side("AF", "a").join(side("RF", "b"), "modality")


ONTOLOGY = ", ".join(f"('{k}', '{c}', {i}, '{p}')" for k, (c, ps) in C.ONTOLOGY.items() for i, p in enumerate(ps))


@query("R11", f"SELECT * FROM (VALUES {ONTOLOGY}) v(concept, category, place, pattern)")
def r11(t):
    from ..operators.recode import ontology

    return ontology(t.spark)


@query("R12", "SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def r12(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))


@query("R13", "SELECT event_id, json_extract_string(props, '$.k') AS page FROM events WHERE props IS NOT NULL")
def r13(t):
    return t.events.where("props IS NOT NULL").select("event_id", F.get_json_object("props", "$.k").alias("page"))
