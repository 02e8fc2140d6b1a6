"""Reproducible stratified splits and resamples from hashes of the case names.

A case's place depends on its name, the repeat and the seed alone.  Exact shares per stratum
need a rank; `exact=False` uses the hash itself as a uniform number, so that nothing is sorted
and shares hold in expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources.scratch import broadcast_upto, kept
from .ranks import bucket, placed, with_group

#: Buckets of a hash whose rows are counted to find the last positive of a permutation.
STEPS = 256


def uniform(case: Column, *salt: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(case, *salt), 11).cast("double") / float(1 << 53)


def _bucket(u: Column) -> Column:
    """Neighbours in the order of a uniform number; a task ranks a bucket at a time."""
    return F.floor(u * 4096)


def monte_carlo(cases: DataFrame, case: str, label: str, repeats: int, test_share: float, seed: int, exact: bool = True) -> DataFrame:
    """case, label, repeat, role: a stratified share of test cases in each repeat."""
    each = cases.select(case, label, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias("repeat"))
    u = uniform(F.col(case), F.col("repeat"), F.lit(seed))
    if not exact:
        return each.withColumn("role", F.when(u < test_share, "test").otherwise("train"))
    size = cases.groupBy(label).agg(F.count("*").alias("__size")).withColumnRenamed(label, "__label")
    each = placed(each.withColumn("__u", u), ["repeat", label], [F.col("__u"), F.col(case)], _bucket(F.col("__u")), "__place").drop("__u")
    each = each.join(size, F.col(label).eqNullSafe(F.col("__label")))
    return each.withColumn("role", F.when(F.col("__place") <= F.round(test_share * F.col("__size")), "test").otherwise("train")).drop("__label", "__size", "__place")


def k_fold(cases: DataFrame, case: str, label: str, folds: int, seed: int, exact: bool = True) -> DataFrame:
    """case, label, fold: each case once in a test fold."""
    u = uniform(F.col(case), F.lit(seed))
    if not exact:
        return cases.select(case, label, F.floor(u * folds).cast("long").alias("fold"))
    each = placed(cases.select(case, label, u.alias("__u")), [label], [F.col("__u"), F.col(case)], _bucket(F.col("__u")), "__place")
    return each.select(case, label, F.pmod(F.col("__place") - 1, F.lit(folds)).cast("long").alias("fold"))


def rebuilt(rows: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the roles that a saved manifest gives their cases, found by name and never by position; a case in two roles comes in both."""
    return rows.join(manifest.select(*key, "role"), key)


def resamples(cases: DataFrame, case: str, repeats: int, share: float, seed: int) -> DataFrame:
    """resample, case: a hash share of the cases in each; all of them once if there are fewer than four."""
    each = cases.select(case, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias("resample"))
    few = cases.limit(4).count() < 4
    return each.where("resample = 0") if few else each.where(uniform(F.col(case), F.col("resample"), F.lit(seed)) < share)


def violations(splits: DataFrame, cases: DataFrame, case: str) -> DataFrame:
    """split, problem: cases in both roles, and cases that a split lacks; no rows if all is well."""
    both = splits.groupBy("split", case).agg(F.count_distinct("role").alias("k")).where("k > 1").select("split", F.lit("overlap").alias("problem")).distinct()
    n = cases.agg(F.count_distinct(case).alias("n"))
    part = splits.groupBy("split").agg(F.count_distinct(case).alias("m")).crossJoin(F.broadcast(n)).where("m <> n").select("split", F.lit("incomplete").alias("problem"))
    return both.unionByName(part)


def balance(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Rows and positives of each part of each split."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).alias("positives"))


def poisson_bootstrap(rows: DataFrame, key: str, repeats: int, seed: int) -> DataFrame:
    """Rows with replicate and weight, weights drawn from Poisson(1) by hash; weight 0 makes no row.

    Each row's weights are its own, so replicates need no sampling pass; sums of weights vary
    about the row count.
    """
    u = uniform(F.col(key), F.col("replicate"), F.lit(seed))
    steps, total, p = [], 0.0, 0.36787944117144233
    for k in range(1, 12):
        total += p
        steps.append(F.when(u >= total, 1).otherwise(0))
        p /= k
    weight = sum(steps[1:], steps[0])
    return rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("weight", weight).where("weight > 0")


def intervals(stats: DataFrame, by: list[str], values: list[str], level: float = 0.95) -> DataFrame:
    """Percentile intervals over replicates, with how many replicates had a value."""
    low, high = (1 - level) / 2, (1 + level) / 2
    cols = []
    for v in values:
        q = F.percentile(v, F.array(F.lit(low), F.lit(high)))
        cols += [q[0].alias(f"{v}_ci_low"), q[1].alias(f"{v}_ci_high"), F.count(v).alias(f"{v}_n")]
    return stats.groupBy(*by).agg(*cols)


def permuted(rows: DataFrame, by: list[str], key: str, value: str, seed: Column, out: str) -> DataFrame:
    """Rows with the value of another row of the group: in a hash order, numbers are dealt out from the
    greatest down (so that `permuted_counts` need not place rows), other values in a second hash order.

    seed may be a column that is constant in a group, so that each group has its own order.
    """
    d = rows.withColumns({"__u": uniform(F.col(key), seed, F.lit(1)), "__w": uniform(F.col(key), seed, F.lit(2))})
    first = placed(d, by, [F.col("__u"), F.col(key)], _bucket(F.col("__u")), "__i")
    order, step = [F.col("__w"), F.col(key)], _bucket(F.col("__w"))
    if isinstance(rows.schema[value].dataType, NumericType):  # values that tie in buckets by the second hash
        order, step = [F.desc(out), *order], F.struct((-bucket(out)).alias("v"), F.floor(F.col("__w") * 64).alias("w"))
    second = placed(d.select(*by, key, "__w", F.col(value).alias(out)), by, order, step, "__j")
    second = second.select(*(F.col(k).alias(f"__k_{k}") for k in by), "__j", out)
    on = [F.col("__i") == F.col("__j"), *(F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by)]
    return first.join(second, on).select(*(F.col(f"`{c}`") for c in rows.columns), out)


def permuted_counts(rows: DataFrame, by: list[str], key: str, score: str, label: str, repeats: int) -> DataFrame:
    """by, replicate, score, pos, neg: how often labels 0 and 1 meet each score after each replicate's permutation.

    The same as by counting what `permuted` gives per group and replicate, with the replicate as seed
    and keys that tell a group's rows apart: positives are the first rows in the hash order.  So no row
    is placed but those of the bucket where the last positive is; rows are read three times and only
    counts are shuffled.  Rows without a label take no part.
    """
    rows = rows.where(F.col(label).isNotNull()).select(*by, key, score, label)
    group = [*by, "replicate"]
    replicates = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    each = rows.drop(label).withColumn("replicate", replicates).withColumn("__u", uniform(F.col(key), F.col("replicate"), F.lit(1))).withColumn("__b", F.floor(F.col("__u") * STEPS))
    size = each.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    size = size.withColumn("__before", F.sum("__n").over(Window.partitionBy(*group).orderBy("__b")) - F.col("__n"))
    size = with_group(size, rows.groupBy(*by).agg(F.sum(label).alias("__pos")), by)
    left = F.col("__pos") - F.col("__before")
    cut = kept(size.where((left > 0) & (left <= F.col("__n"))).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(group)), F.col("__b").alias("__last"), left.alias("__left")))
    placed_ = each.join(broadcast_upto(cut, 200_000), [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(group)])
    scored = F.col(score).isNotNull()
    first = placed_.where((F.col("__b") < F.col("__last")) & scored).groupBy(*group, score).agg(F.count("*").alias("pos"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("__u", key))
    edge = placed_.where("__b = __last").withColumn("__place", place).where((F.col("__place") <= F.col("__left")) & scored)
    n = rows.where(scored).groupBy(*by, score).agg(F.count("*").alias("n")).withColumn("replicate", replicates)
    counts = [n.select(*group, score, "n", F.lit(0).cast("long").alias("pos"))] + [d.select(*group, score, F.lit(0).cast("long").alias("n"), "pos") for d in (first, edge.groupBy(*group, score).agg(F.count("*").alias("pos")))]
    every = counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy(*group, score).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return every.select(*group, score, "pos", (F.col("n") - F.col("pos")).alias("neg"))


def shuffled(rows: DataFrame, by: list[str], value: str, seed: int, out: str) -> DataFrame:
    """Rows with another row's value within the group, in a seeded order."""
    own = rows.withColumn("__id", F.xxhash64(*rows.columns))
    return permuted(own, by, "__id", value, F.lit(seed), out).drop("__id")
