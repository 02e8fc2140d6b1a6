"""Ranks, cumulative counts and picks, formed on distinct values so that ties and hot groups stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(value: str | Column) -> Column:
    """A number that grows with a value, of 256 steps between powers of two: neighbours in order, in many small groups.

    Nulls come first and NaN last, as in Spark's order.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.when((v != 0) & (F.abs(v) < float("inf")), F.abs(v)).otherwise(1.0)
    power = F.floor(F.log2(size))
    step = (power + 1100) * 1024 + F.floor(size / F.pow(F.lit(2.0), power) * 256)
    far = F.lit(1 << 40)
    finite = F.when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * (far - 1)).when(v > 0, step).otherwise(-step)
    return F.when(v.isNull(), -far).when(F.isnan(v), far).otherwise(finite).cast("long")


def with_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the other columns of their group's row, null where there is none; a null in `by` is a value like others."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))  # one row
    named = groups.withColumnsRenamed({k: f"__{k}" for k in by})
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by], "left").drop(*(f"__{k}" for k in by))


def running(df: DataFrame, by: list[str], order: list[Column], bucket: Column, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Rows with running sums within groups, the row itself included; rows that tie come one after the other.

    bucket grows with the order (falls, if descending); a task sums a bucket at a time, and the
    buckets' totals are summed before, so no group has to be sorted in one task.
    """
    d = df.withColumns({"__b": bucket, **{f"__v_{k}": c for k, c in sums.items()}})
    key = [*by, "__b"]
    totals = d.groupBy(*key).agg(*(F.sum(f"__v_{k}").alias(k) for k in sums))
    before = Window.partitionBy(*by).orderBy(F.desc("__b") if descending else F.asc("__b"))
    base = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), *((F.sum(k).over(before) - F.col(k)).alias(f"__s_{k}") for k in sums))
    within = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = d.withColumns({f"__r_{k}": F.sum(f"__v_{k}").over(within) for k in sums})
    joined = inner.join(base, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)])
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"__r_{k}") + F.col(f"__s_{k}")).alias(k) for k in sums))


def placed(df: DataFrame, by: list[str], order: list[Column], bucket: Column, out: str) -> DataFrame:
    """Rows with their place, from 1, in a total order within a group."""
    return running(df, by, order, bucket, {out: F.lit(1).cast("long")})


def average_rank(df: DataFrame, by: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Rows with the average rank of their value within a group; only distinct values are sorted."""
    key = [*by, value]
    n = df.groupBy(*key).agg(F.count("*").alias("__n"))
    upto = running(n, by, [F.col(value)], bucket(value), {"__upto": F.col("__n")})
    ranks = upto.withColumn(out, F.col("__upto") - (F.col("__n") - 1) / 2).select(*(F.col(k).alias(f"__{k}") for k in key), out)
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return df.join(ranks, on).drop(*(f"__{k}" for k in key))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """by and exact quantiles with linear interpolation, from the counts of distinct values."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    upto = running(n, by, [F.col(value)], bucket(value), {"__upto": F.col("__n")})
    total = n.groupBy(*by).agg(F.sum("__n").alias("__total"))
    d = with_group(upto, total, by)
    cols = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("__total") - 1)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.min(F.when(F.col("__upto") > low, F.col(value))), F.min(F.when(F.col("__upto") > high, F.col(value)))
        part = F.max(place - low)
        cols.append(F.when(a == b, a.cast("double")).otherwise(a + part * (b - a)).alias(name))
    return d.groupBy(*by).agg(*cols)


def best_row(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_rows(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group with their place."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(out) <= k)


def threshold_table(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Per group and distinct score, from high to low: positives, negatives, and both so far."""
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    return thresholds(d, by, score)


def thresholds(d: DataFrame, by: list[str], score: str) -> DataFrame:
    """The same from a row per group and score with the counts pos and neg."""
    down = running(d, by, [F.desc(score)], bucket(score), {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    total = d.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return with_group(down, total, by)


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, out: str = "q") -> DataFrame:
    """Adjusted p-values: the least p * m / rank of this and all larger ones; null p stays null."""
    real = F.col(p).isNotNull()
    m = F.count(p).over(Window.partitionBy(*by))
    up = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())
    ranked = df.withColumns({"__m": m, "__r": F.rank().over(up) + F.count("*").over(Window.partitionBy(*by, p)) - 1})
    least = F.min(F.when(real, F.col(p) * F.col("__m") / F.col("__r"))).over(Window.partitionBy(*by).orderBy(F.col(p).desc_nulls_first()))
    return ranked.withColumn(out, F.when(real, F.least(least, F.lit(1.0)))).drop("__m", "__r")


def min_max(df: DataFrame, by: list[str], value: str, inverted: Column, out: str = "scaled") -> DataFrame:
    """Values scaled to 0..1 within a group, inverted where less is better; 0.5 if all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    x = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.5)
    return df.withColumn(out, F.when(inverted, 1 - x).otherwise(x))


def top_and_bottom(df: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    """First and last k rows of each group, marked; a row that is both counts as top."""
    up = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), tie))
    down = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), tie))
    return df.withColumn("__u", up).withColumn("__d", down).withColumn("bucket", F.when(F.col("__d") <= k, "top").when(F.col("__u") <= k, "bottom")).where("bucket IS NOT NULL").drop("__u", "__d")
