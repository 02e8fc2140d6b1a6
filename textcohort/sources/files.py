"""Scans and sinks: CSV, JSON lines, text, bytes and run folders, through Spark's readers only."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions import text as X
from ..functions import udfs

CSV = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE"}


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV table whose cells may hold quotes and line breaks; all text without a schema."""
    reader = spark.read.options(**CSV)
    return (reader.schema(schema) if schema else reader).csv(path)


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError("duplicate column names")
    return df


def with_case_id(df: DataFrame, index: str = "row_index") -> DataFrame:
    """A case_id for each row, row_<index> where there is none."""
    made = F.concat(F.lit("row_"), F.col(index).cast("string"))
    return df.withColumn("case_id", F.coalesce(F.col("case_id").cast("string"), made) if "case_id" in df.columns else made)


def numbered(df: DataFrame, index: str = "row_index") -> DataFrame:
    """Rows with their dense place in the file order; two narrow passes, nothing is sorted.

    Spark's own ids grow by one within a partition; the rows of the partitions before, a number
    for each partition, are added.
    """
    at = df.withColumn("__at", F.monotonically_increasing_id())
    before, total = [], 0
    for part, n in sorted(at.groupBy(F.shiftright("__at", 33)).count().collect()):
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__part long, __before long")
    joined = at.join(F.broadcast(offsets), F.shiftright("__at", 33) == F.col("__part"))
    return joined.withColumn(index, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def cases(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return with_case_id(numbered(required(csv(spark, path), columns)))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows with their line text's file order hint, and the lines that aren't objects of the schema; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("line"))
    parsed = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = parsed.where(F.col("row").isNotNull() & F.startswith(F.trim("value"), F.lit("{")) & F.get_json_object("value", "$").isNotNull())
    bad = parsed.where(F.col("row").isNull() | ~F.startswith(F.trim("value"), F.lit("{")) | F.get_json_object("value", "$").isNull())
    return good.select("line", "row.*"), bad.select("line", "value")


def last_valid(df: DataFrame, key: list[str], order: str, valid: Column) -> DataFrame:
    """The last valid record of each key."""
    rest = [c for c in df.columns if c not in key]
    got = df.where(valid).groupBy(*key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("r"))
    return got.select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def prefer(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """All of the first source and what only the second has."""
    return first.unionByName(second.join(first.select(*key), key, "left_anti"), allowMissingColumns=True)


def with_source(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Many CSV files as one table with their source file."""
    return spark.read.options(**CSV).schema(schema).csv(paths).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def optional(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The table at a path, or an empty one if there is none."""
    try:
        return spark.read.format(kind).options(**(CSV if kind == "csv" else {})).schema(schema).load(path).select("*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


#: Artifact kinds: approach (or any), pattern of the file name, kind; the first that fits counts.
KINDS = [("a", r"eval_summary\.csv$", "summary_csv"), ("a", r"evaluation\.json$", "eval_json"), ("b", r"metrics\.csv$", "metrics_csv"), ("a", r"cost\.json$", "cost_json_a"), ("b", r"cost\.json$", "cost_json_b"), ("", r"\.log$", "run_log")]


def classify(approach: Column, name: Column) -> Column:
    out = F.lit("other")
    for which, pattern, kind in reversed(KINDS):
        out = F.when(name.rlike(pattern) & ((approach == which) | F.lit(which == "")), kind).otherwise(out)
    return out


def artifacts(spark: SparkSession, root: str, approach: str) -> DataFrame:
    """Files of run folders, root/run/.../file (a run's folder may be named run_id=run): run_id, path, name, kind, shots, modality; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    parts = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    name = F.element_at(parts, -1)
    pick = lambda p: F.nullif(F.regexp_extract("path", p, 1), F.lit(""))
    return files.select(F.element_at(F.split(F.element_at(parts, 1), "="), -1).alias("run_id"), "path", name.alias("name"), classify(F.lit(approach), name).alias("kind"), pick(r"(shotset_[A-Za-z0-9]+)").alias("shots"), pick(r"(mri_only|path_only|combined)").alias("modality"), "length")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def json_metrics(files: DataFrame) -> DataFrame:
    """path, target, metric, value of nested evaluation objects {target: {metric: value}}; values that aren't numbers go."""
    inner = files.select("path", F.explode(F.from_json("value", "map<string,string>")).alias("target", "o"))
    long = inner.select("path", "target", F.explode(F.from_json("o", "map<string,string>")).alias("metric", "v"))
    return long.select("path", "target", "metric", X.number(F.col("v")).alias("value")).where("value IS NOT NULL")


def cost_metrics(files: DataFrame) -> DataFrame:
    """path, block, metric, value of cost objects, from their root and their `cumulative` block."""
    numbers = lambda c: F.explode(F.from_json(c, "map<string,string>")).alias("metric", "v")
    root = files.select("path", F.lit("root").alias("block"), numbers(F.col("value")))
    inner = files.select("path", F.lit("cumulative").alias("block"), numbers(F.get_json_object("value", "$.cumulative")))
    return root.unionByName(inner).select("path", "block", "metric", X.number(F.col("v")).alias("value")).where("value IS NOT NULL")


def runtime(lines: DataFrame, by: list[str], text: str = "value") -> DataFrame:
    """Seconds between the first and the last ISO time stamp in log lines."""
    at = F.try_to_timestamp(F.replace(F.regexp_extract(text, r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)", 1), F.lit("T"), F.lit(" ")))
    return lines.withColumn("__at", at).where("__at IS NOT NULL").groupBy(*by).agg((F.unix_timestamp(F.max("__at")) - F.unix_timestamp(F.min("__at"))).alias("seconds"))


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value, low, high: each metric with its interval columns where the table has them."""
    has = set(wide.columns)
    col = lambda c: F.col(c).cast("double") if c in has else F.lit(None).cast("double")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), col(m).alias("value"), col(f"{m}_ci_low").alias("low"), col(f"{m}_ci_high").alias("high")) for m in metrics if m in has))).alias("m")
    return wide.select(*keys, each).select(*keys, "m.*").where("value IS NOT NULL")


def manual(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["run_id"], r["target"], r["metric"], float(r["value"]), "manual") for r in rows], "run_id string, target string, metric string, value double, source string")


def decoded(raw: DataFrame, content: str = "content") -> DataFrame:
    """Rows with the encoding that their bytes suggest, their text, and how many of its characters aren't ASCII."""
    d = raw.withColumn("__d", udfs.decode_udf(content))
    n = F.length("__d.text") - F.length(F.regexp_replace("__d.text", r"[^\x00-\x7F]", ""))
    return d.select(*(c for c in raw.columns if c != content), F.col("__d.encoding").alias("encoding"), F.col("__d.text").alias("text"), n.cast("long").alias("n_non_ascii"))


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, decoded."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"))


def trimmed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table with blanks and line breaks cut from both ends of text columns."""
    return df.withColumns({c: F.btrim(c, F.lit(" \n")) for c in columns})


def config(spark: SparkSession, text: str) -> DataFrame:
    """Runs of a comparison, given as a JSON object {"runs": [...]}, as a table."""
    runs = json.loads(text)["runs"]
    return spark.createDataFrame([(r["run_id"], r.get("label", r["run_id"]), r["approach"], r.get("path")) for r in runs], "run_id string, label string, approach string, path string")


def subset(df: DataFrame, columns: list[str]) -> DataFrame:
    return required(df, columns).select(*columns)


def missing_record(df: DataFrame, reason: str, shape: T.StructType) -> DataFrame:
    """Typed records for rows that get no call: their own columns, all others null."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in shape), F.lit(1).alias("missing"), F.lit(reason).alias("missing_reason"))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


# ----- sinks


def replace(df: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet") -> None:
    """Write all or nothing; with partition columns only their partitions are replaced."""
    writer = df.write.mode("overwrite").format(kind)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def with_manifest(df: DataFrame, path: str, key: str, case: str) -> DataFrame:
    """Write a table and return its manifest: key, rows, and a hash of the cases that no order changes."""
    replace(df, path, [key])
    return df.groupBy(key).agg(F.count("*").alias("n"), F.substring(F.sha2(F.concat_ws("|", F.sum(F.xxhash64(case).cast("decimal(38,0)")).cast("string"), F.count("*").cast("string")), 256), 1, 16).alias("hash"))


def joined_lists(df: DataFrame, by: list, order: str, name: str, out: str) -> DataFrame:
    """by, n and the names of a group joined by semicolons in order; groups must be of bounded size."""
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(order, name))).alias("__x"))
    return got.withColumn(out, F.array_join(F.transform("__x", lambda s: s[name]), ";")).drop("__x")


def json_safe(df: DataFrame) -> DataFrame:
    """Rows as JSON, non-finite numbers as null."""
    safe = [X.finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))
