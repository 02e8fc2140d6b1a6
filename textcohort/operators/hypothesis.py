"""Tests and effect sizes: counts, ranks and moments natively, tail probabilities per result row.

The Arrow functions see one row per finished test, never the tested rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .metrics import safe_corr
from .ranks import average_rank, quantiles, with_group


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_two_sided(k: int, n: int) -> float:
    """Two-sided exact binomial test at one half."""
    if n == 0:
        return 1.0
    m = min(k, n - k)
    total = term = 1.0  # in units of the greatest term; the others fall off within some sqrt(n) steps
    for i in range(m, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < 1e-18 * total:
            break
    return min(1.0, 2 * total * math.exp(_log_choose(n, m) - n * math.log(2)))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher test: all tables of the margins that are no likelier than the one seen."""
    r, s, k = a + b, c + d, a + c
    if min(r, s, k, b + d) == 0:
        return 1.0
    p = lambda x: _log_choose(r, x) + _log_choose(s, k - x) - _log_choose(r + s, k)
    seen = p(a)
    return min(1.0, math.fsum(math.exp(p(x)) for x in range(max(0, k - s), min(r, k) + 1) if p(x) <= seen + 1e-7))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _row_udf(fn):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*columns, strict=True)], dtype="float64")

    return run


def p_value(kind: str, *columns: Column) -> Column:
    """t (statistic, df), normal (z), binomial (k, n) or fisher (a, b, c, d) as a two-sided p-value column."""
    fn = {"t": t_two_sided, "normal": normal_two_sided, "binomial": lambda k, n: binomial_two_sided(int(k), int(n)), "fisher": lambda a, b, c, d: fisher_two_sided(int(a), int(b), int(c), int(d))}[kind]
    run = _row_udf(fn)
    arity = {"t": 2, "normal": 1, "binomial": 2, "fisher": 4}[kind]
    typed = {
        1: lambda a: run(a),
        2: lambda a, b: run(a, b),
        4: lambda a, b, c, d: run(a, b, c, d),
    }[arity]
    typed.__annotations__ = dict.fromkeys(typed.__code__.co_varnames[:arity], pd.Series) | {"return": pd.Series}
    return F.pandas_udf(typed, DoubleType())(*columns)


def paired(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Paired differences: mean, median, dz, correlations, t, sign and Wilcoxon tests per group."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y, (F.col(y) - F.col(x)).alias("__d"))
    base = average_rank(average_rank(d, by, x, "__rx"), by, y, "__ry").groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("__d").alias("mean_diff"),
        F.try_divide(F.avg("__d"), F.stddev_samp("__d")).alias("dz"),
        safe_corr(x, y).alias("pearson_r"),
        safe_corr("__rx", "__ry").alias("spearman_rho"),
        F.count_if(F.col("__d") > 0).alias("n_up"),
        F.count_if(F.col("__d") < 0).alias("n_down"),
    )
    base = with_group(base, quantiles(d, by, "__d", {"median_diff": 0.5}), by)
    moved = average_rank(d.where("__d <> 0").withColumn("__a", F.abs("__d")), by, "__a", "__ra")
    ties = moved.groupBy(*by, "__a").agg(F.count("*").alias("k"), F.sum(F.when(F.col("__d") > 0, F.col("__ra")).otherwise(0.0)).alias("w"))
    w = ties.groupBy(*by).agg(F.sum("w").alias("w_plus"), F.sum("k").alias("m"), F.sum(F.col("k") ** 3 - F.col("k")).alias("tie"))
    m = F.col("m").cast("double")  # its cube is beyond a long from two million pairs on
    var = m * (m + 1) * (2 * m + 1) / 24 - F.col("tie") / 48
    out = with_group(base, w, by).withColumns({"t": F.col("dz") * F.sqrt("n"), "z_wilcoxon": F.try_divide(F.col("w_plus") - m * (m + 1) / 4, F.sqrt(var))})
    out = out.withColumns({"p_t": p_value("t", F.col("t"), (F.col("n") - 1).cast("double")), "p_sign": p_value("binomial", F.col("n_up"), F.col("n_up") + F.col("n_down")), "p_wilcoxon": p_value("normal", F.col("z_wilcoxon"))})
    return out.drop("tie", "m")


def mcnemar(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Discordant pairs of two binary columns and the exact test."""
    got = df.groupBy(*by).agg(F.count_if((F.col(x) == 1) & (F.col(y) == 0)).alias("b"), F.count_if((F.col(x) == 0) & (F.col(y) == 1)).alias("c"))
    return got.withColumn("p", p_value("binomial", F.col("b"), F.col("b") + F.col("c")))


def two_groups(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Group 1 against group 0: mean and median difference, Welch t, Mann-Whitney U and Cliff's delta from ranks."""
    plain = df.where(F.col(value).isNotNull() & F.col(group).isin(0, 1)).select(*by, group, value)
    d = average_rank(plain, by, value, "__r")
    one, zero = F.col(group) == 1, F.col(group) == 0
    of = lambda which, c: F.when(which, F.col(c))
    got = d.groupBy(*by).agg(
        F.count_if(one).alias("n1"),
        F.count_if(zero).alias("n0"),
        (F.avg(of(one, value)) - F.avg(of(zero, value))).alias("mean_diff"),
        F.var_samp(of(one, value)).alias("v1"),
        F.var_samp(of(zero, value)).alias("v0"),
        F.sum(of(one, "__r")).alias("r1"),
    )
    middle = quantiles(plain, [*by, group], value, {"__m": 0.5})
    middle = middle.groupBy(*by).agg((F.max(of(one, "__m")) - F.max(of(zero, "__m"))).alias("median_diff"))
    got = with_group(got, middle, by)
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return got.withColumns(
        {
            "u": u,
            "cliffs_delta": F.try_divide(2 * u, F.col("n1") * F.col("n0")) - 1,
            "welch_t": F.try_divide(F.col("mean_diff"), F.sqrt(e1 + e0)),
            "df": F.try_divide((e1 + e0) ** 2, e1**2 / (F.col("n1") - 1) + e0**2 / (F.col("n0") - 1)),
        }
    ).drop("v1", "v0", "r1")


def two_by_two(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Counts, odds ratio, risk difference and Fisher's test of two binary columns."""
    n = lambda p, q: F.count_if((F.col(x) == p) & (F.col(y) == q))
    got = df.groupBy(*by).agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    a, b, c, d = (F.col(k) for k in "abcd")
    return got.withColumns({"odds_ratio": F.try_divide(a * d, b * c), "risk_difference": F.try_divide(a, a + b) - F.try_divide(c, c + d), "p_fisher": p_value("fisher", a, b, c, d)})


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, zz = k / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def normal_interval(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n)
    return F.when(n > 0, F.greatest(p - half, F.lit(0.0))), F.when(n > 0, F.least(p + half, F.lit(1.0)))
