"""Views that map the sample tables to cohorts, predictions, metric tables and usage logs.

Each is written once for Spark and once, identically, in SQL.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .registry import Tables


def cases_v(t: Tables) -> DataFrame:
    """One row per document: two text columns, a score with gaps, and a label known for some."""
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("case_id"),
        F.col("doc_id").alias("row_index"),
        F.when(F.col("doc_id") % 6 == 0, "N/A").otherwise(F.col("text")).alias("text_a"),
        F.col("text").alias("text_b"),
        F.when(F.col("doc_id") % 17 != 0, (F.col("n_chars") % 451).cast("double")).alias("score"),
        F.col("toxic").alias("relapse"),
        "lang",
        "source",
    )


def pred_v(t: Tables) -> DataFrame:
    """Repeated held-out predictions: five models, one split per year, several rows per case."""
    p = F.pmod(F.col("o_orderkey") * 7919 + F.col("o_custkey"), F.lit(1000))
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderpriority").alias("model_key"),
        F.year("o_orderdate").cast("long").alias("split_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "train").otherwise("test").alias("role"),
        F.col("o_totalprice").alias("y_true"),
        (F.col("o_totalprice") * 0.5 + p * 100.0).alias("y_value"),
        (p / 1000.0).alias("y_prob"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("long").alias("y_bin"),
        F.col("c_mktsegment").alias("dataset_key"),
        F.col("c_nationkey").cast("long").alias("site"),
    )


def pairs_v(t: Tables) -> DataFrame:
    """Two numeric measures per line item with a group and a stratum."""
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_returnflag").alias("g"),
        F.col("l_linestatus").alias("s"),
        F.col("l_quantity").alias("x"),
        F.pmod(F.col("l_partkey"), F.lit(53)).cast("double").alias("y"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_discount") > 0.05, 1).otherwise(0).cast("long").alias("bx"),
        F.when(F.col("l_tax") > 0.04, 1).otherwise(0).cast("long").alias("bz"),
    )


def metric_v(t: Tables) -> DataFrame:
    """Long metric rows: run, modality, target, metric, value."""
    agg = t.lineitem.groupBy("l_returnflag", "l_linestatus", F.pmod("l_suppkey", F.lit(7)).alias("k")).agg(
        F.round(F.avg("l_quantity") / 50, 6).alias("AUROC"), F.round(F.avg("l_discount"), 6).alias("mae"), F.round(F.avg("l_tax"), 6).alias("Brier"), F.count("*").cast("double").alias("n")
    )
    long = agg.unpivot(["l_returnflag", "l_linestatus", "k"], ["AUROC", "mae", "Brier", "n"], "raw_metric", "value")
    return long.select(F.concat("l_returnflag", "l_linestatus").alias("run_id"), F.concat(F.lit("m"), F.col("k")).alias("modality"), F.when(F.col("k") % 2 == 0, "relapse").otherwise("score").alias("target"), "raw_metric", "value")


def usage_v(t: Tables) -> DataFrame:
    """One call per user turn with estimated prompt and output tokens and a mode."""
    return t.conversations.select(
        "conv_id", "turn", "role", F.ceil(F.length("text") / 4).cast("long").alias("tokens"), F.concat(F.lit("mode"), F.col("conv_id") % 3).alias("mode"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text"
    )


VIEWS = {f.__name__: f for f in (cases_v, pred_v, pairs_v, metric_v, usage_v)}

SQL = {
    "cases_v": """SELECT 'doc_' || d.doc_id AS case_id, d.doc_id AS row_index, CASE WHEN d.doc_id % 6 = 0 THEN 'N/A' ELSE d.text END AS text_a, d.text AS text_b,
  CASE WHEN d.doc_id % 17 <> 0 THEN CAST(d.n_chars % 451 AS DOUBLE) END AS score, l.toxic AS relapse, d.lang, d.source FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "pred_v": """SELECT o_orderkey AS row_id, o_custkey AS case_id, o_orderpriority AS model_key, CAST(year(o_orderdate) AS BIGINT) AS split_id, CASE WHEN o_orderkey % 3 = 0 THEN 'train' ELSE 'test' END AS role,
  o_totalprice AS y_true, o_totalprice * 0.5 + ((o_orderkey * 7919 + o_custkey) % 1000) * CAST(100.0 AS DOUBLE) AS y_value, CAST((o_orderkey * 7919 + o_custkey) % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS y_prob,
  CAST(o_orderstatus = 'F' AS BIGINT) AS y_bin, c_mktsegment AS dataset_key, CAST(c_nationkey AS BIGINT) AS site FROM orders JOIN customer ON o_custkey = c_custkey""",
    "pairs_v": """SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS g, l_linestatus AS s, l_quantity AS x, CAST(l_partkey % 53 AS DOUBLE) AS y, l_extendedprice AS price,
  CAST(l_discount > 0.05 AS BIGINT) AS bx, CAST(l_tax > 0.04 AS BIGINT) AS bz FROM lineitem""",
    "metric_v": """SELECT l_returnflag || l_linestatus AS run_id, 'm' || k AS modality, CASE WHEN k % 2 = 0 THEN 'relapse' ELSE 'score' END AS target, raw_metric, value FROM (
  UNPIVOT (SELECT l_returnflag, l_linestatus, l_suppkey % 7 AS k, round(avg(l_quantity) / 50, 6) AS "AUROC", round(avg(l_discount), 6) AS mae, round(avg(l_tax), 6) AS "Brier", CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL)
  ON "AUROC", mae, "Brier", n INTO NAME raw_metric VALUE value)""",
    "usage_v": """SELECT conv_id, turn, role, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, 'mode' || (conv_id % 3) AS mode, conv_id * 1000 + turn AS seq, text FROM conversations""",
}


def with_views(sql: str) -> str:
    """Put the views that a statement names before it, as common table expressions."""
    used = [f"{n} AS ({body})" for n, body in SQL.items() if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        return f"WITH {own[1] or ''}{', '.join(used)}, {sql[own.end():]}"
    return f"WITH {', '.join(used)} {sql}"
