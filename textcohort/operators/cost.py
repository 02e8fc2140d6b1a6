"""Token and cost accounting over usage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..sources.scratch import broadcast_upto


def totals(usage: DataFrame, by: list[str]) -> DataFrame:
    """Additive counters, so that totals of totals are totals."""
    return usage.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("fresh").alias("fresh"), F.sum("cached").alias("cached"), F.sum("output").alias("output"))


def priced(counted: DataFrame, model: str) -> DataFrame:
    """Cost with the cache, without it, and the difference."""
    p = C.PRICES[model]
    with_cache = T.cost(F.col("fresh"), F.col("cached"), F.col("output"), p)
    without = T.cost(F.col("fresh") + F.col("cached"), F.lit(0), F.col("output"), p)
    return counted.withColumns({"cost": with_cache, "cost_no_cache": without, "savings": without - with_cache})


def estimate(prompts: DataFrame, mode: str, order: str, text: str, output_tokens: int) -> DataFrame:
    """Planned usage per mode: all calls but a mode's first find its common prefix in the cache."""
    sized = prompts.select(mode, order, T.tokens_by_chars(F.col(text)).alias("n"), F.col(text).alias("__t"))
    edges = sized.groupBy(mode).agg(F.min("__t").alias("a"), F.max("__t").alias("z"), F.min(order).alias("first"))
    prefix = edges.select(mode, "first", F.ceil(T.common_prefix(F.col("a"), F.col("z")) / 4).cast("long").alias("prefix"))
    d = sized.join(broadcast_upto(prefix, 10_000), mode)
    hit = F.when(F.col(order) > F.col("first"), F.least("n", "prefix")).otherwise(0)
    return d.groupBy(mode).agg(F.count("*").alias("calls"), F.sum(F.col("n") - hit).alias("fresh"), F.sum(hit).alias("cached"), (F.count("*") * output_tokens).alias("output"))


def comparison(planned: DataFrame, actual: DataFrame, on: list[str], measures: list[str]) -> DataFrame:
    """on, measure, planned, actual, delta, percent."""
    long = lambda df, name: df.unpivot(on, [F.col(m).cast("double").alias(m) for m in measures], "measure", name)
    both = long(planned, "planned").join(long(actual, "actual"), [*on, "measure"], "full_outer")
    delta = F.col("actual") - F.col("planned")
    return both.withColumns({"delta": delta, "percent": F.try_divide(100 * delta, "planned")})
