"""Mixing sources to target weights by hierarchical budgeting.

A token budget is shared out along a tree domain - language - source.  At each node children
get shares in proportion to their weights, at most what they hold; what one can't take goes to
its siblings, and only what no sibling can take returns to the parent's siblings.  Each leaf
then takes whole seeded epochs and a token-prefix of one more, in the order of a seeded hash.
The prefix's cut is found by narrowing a hash range, so no leaf of many rows is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Scratch, broadcast_upto

SPLIT = 1024
FEW = 10_000
MAX_LEAVES = 20_000
NULL = "\0null"
ALIKE = "\0tokens "
LEVELS = ["__domain", "__lang", "__source"]
TOP = 1 << 62


@dataclass(frozen=True)
class Mixture:
    """weights: target weight of a path's node among its siblings, 1 where none is given.

    budget: tokens to select, or a share of all tokens if it is at most 1.
    """

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    budget: float = 1.0
    max_epochs: int = 1
    seed: int = 7


def share_out(budget: Fraction, holds: list[int], weights: list[float], times: list[int] | None = None) -> list[Fraction]:
    """Shares in proportion to the weights, none above what the child holds; shortages go to the others.

    times: how many children are alike; the share is that of each.
    """
    times = times or [1] * len(holds)
    weight = [Fraction(w).limit_denominator(10**9) for w in weights]
    out, left = [Fraction(0)] * len(holds), min(budget, Fraction(sum(h * k for h, k in zip(holds, times, strict=True))))
    # children without weight get what the others can't take, in equal shares
    for part in ([i for i, h in enumerate(holds) if h > 0 and weight[i] > 0], [i for i, h in enumerate(holds) if h > 0 and weight[i] <= 0]):
        own = {i: weight[i] if weight[i] > 0 else Fraction(1) for i in part}
        total = sum(own[i] * times[i] for i in part)
        for i in sorted(part, key=lambda i: holds[i] / own[i]):  # those that fill up first come first
            out[i] = min(Fraction(holds[i]), left * own[i] / total)
            left -= out[i] * times[i]
            total -= own[i] * times[i]
    return out


def budgets(leaves: dict[tuple[str, ...], int], mixture: Mixture, times: dict[tuple[str, ...], int] | None = None) -> dict[tuple[str, ...], int]:
    """Whole tokens for each leaf; leaves: tokens each one has in one epoch; times: how many leaves are alike."""
    times = times or dict.fromkeys(leaves, 1)
    total = sum(n * times[leaf] for leaf, n in leaves.items())
    budget = Fraction(mixture.budget).limit_denominator(10**9) * (total if mixture.budget <= 1 else 1)
    out: dict[tuple[str, ...], int] = {}

    def go(path: tuple[str, ...], below: dict[tuple[str, ...], int], share: Fraction) -> None:
        if len(path) == 3:
            out[path] = int(share)
            return
        children: dict[tuple[str, ...], dict[tuple[str, ...], int]] = {}
        for leaf, n in below.items():
            children.setdefault(leaf[: len(path) + 1], {})[leaf] = n
        names = sorted(children)
        alike = [times[c] if len(c) == 3 else 1 for c in names]
        holds = [mixture.max_epochs * sum(n * (times[x] if len(c) < 3 else 1) for x, n in children[c].items()) for c in names]
        for c, s in zip(names, share_out(share, holds, [mixture.weights.get(c, 1.0) for c in names], alike), strict=True):
            go(c, children[c], s)

    go((), leaves, budget)
    return out


def n_tokens(text: Column) -> Column:
    """Blank-separated words of a text: the mixture's unit of budget."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def mix(docs: DataFrame, mixture: Mixture, domain: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", extra: bool = True) -> DataFrame:
    """The selected rows with their own columns, and, with extra, __epoch and __tokens.

    A leaf's budget fills floor(budget / tokens) whole epochs; of the next one it takes the
    longest prefix of rows, in seeded order, that fits the rest, so a leaf never exceeds its
    budget.  Equal rows, which tie, are taken together or not at all within an epoch.  Null
    languages and sources are nodes of their own; rows without words (null, empty) count no tokens
    and come with the prefix they fall in; a very long text that doesn't fit ends its leaf's
    prefix; an empty table gives an empty table; columns of any names stay, but with extra an
    __epoch or __tokens of the input is replaced.  Every source is planned by itself: those
    without a weight of their own that hold as many tokens get the same budget, so the driver sees
    a row for each number of tokens in a domain and language.  Texts are read once more at the
    end, and shuffled only if there are more than MAX_LEAVES leaves to broadcast.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # the table's columns go by number, so that none clashes
    as_node = lambda c: F.coalesce(c.cast("string"), F.lit(NULL))
    node = {"__domain": as_node(domain) if domain is not None else F.lit("all"), "__lang": as_node(F.col(f"`{lang}`")), "__source": as_node(F.col(f"`{source}`"))}
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), *(c.alias(n) for n, c in node.items()))
    key, text = own[key], own[text]
    sized = scratch.write(docs.select(*LEVELS, F.xxhash64(F.col(key), F.col(text)).alias("row"), n_tokens(F.col(text)).alias("n")))
    named = spark.createDataFrame([(*p, True) for p in mixture.weights if len(p) == 3], "__domain string, __lang string, __source string, named boolean")
    kind = F.when(F.col("named"), F.col("__source")).otherwise(F.concat(F.lit(ALIKE), F.col("n").cast("string")))
    leaves = sized.groupBy(*LEVELS).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    leaves = scratch.write(leaves.join(F.broadcast(named), LEVELS, "left").withColumn("kind", kind).drop("named"))
    found = {tuple(r[:3]): (r.n, r.times) for r in leaves.groupBy("__domain", "__lang", "kind", "n").agg(F.count("*").alias("times")).collect()}
    plan = budgets({p: n for p, (n, _) in found.items()}, mixture, {p: k for p, (_, k) in found.items()})
    rows = []
    for leaf, (n, _) in found.items():
        epochs = plan[leaf] // n if n else min(1, mixture.max_epochs)
        rows.append((*leaf, epochs, plan[leaf] - epochs * n if n else 0))
    shares = spark.createDataFrame(rows, "__domain string, __lang string, kind string, full long, rest long")
    planned = scratch.write(leaves.join(broadcast_upto(shares, MAX_LEAVES), ["__domain", "__lang", "kind"]).select(*LEVELS, "rows", "full", "rest"))
    cut = planned.where("rest > 0")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(mixture.seed), F.col("full"), F.col("row")), 2)
    placed = scratch.write(sized.join(broadcast_upto(cut, MAX_LEAVES), LEVELS).select(*LEVELS, "rows", place.alias("place"), "n", "rest"))
    # A leaf of few rows is cut by a running sum.
    few = placed.where(F.col("rows") <= FEW).groupBy(*LEVELS, "place").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("place"))
    crossed = few.withColumn("upto", upto).where("upto > rest").groupBy(*LEVELS).agg(F.min("place").alias("cut"))
    # Narrow each other leaf's range of places until one place is left: (low, high, tokens before, cut).
    state = {tuple(r[:3]): (0, TOP, 0, r.rest) for r in cut.where(F.col("rows") > FEW).select(*LEVELS, "rest").collect()}  # at most rows / FEW
    placed = placed.where(F.col("rows") > FEW).select(*LEVELS, "place", "n")
    cuts: dict[tuple[str, ...], int] = {}
    while state:
        ranges = spark.createDataFrame([(*leaf, low, (high - low + SPLIT - 1) // SPLIT, high, before, rest) for leaf, (low, high, before, rest) in state.items()], "__domain string, __lang string, __source string, low long, step long, high long, before long, rest long")
        inside = placed.join(F.broadcast(ranges), LEVELS).where("place >= low AND place < high")
        part = F.expr("(place - low) div step")
        sums = inside.groupBy(*LEVELS, part.alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.first("low").alias("low"), F.first("step").alias("step"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("part"))  # at most SPLIT rows a leaf
        crossing = sums.withColumn("upto", upto).where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("part", "upto", "n", "rows", "low", "step")).alias("c"))
        met = {tuple(r[:3]): r.c for r in crossing.collect()}  # a row a leaf
        for leaf, (low, high, before, rest) in list(state.items()):
            c = met.get(leaf)
            if c is None:  # all that is left fits
                cuts[leaf] = high
                del state[leaf]
                continue
            start = c.low + c.part * c.step
            if c.step == 1:  # one place crosses the budget; its rows stay out
                cuts[leaf] = start
                del state[leaf]
            else:
                state[leaf] = (start, min(high, start + c.step), c.upto - c.n, rest)
    crossed = crossed.unionByName(spark.createDataFrame([(*leaf, place) for leaf, place in cuts.items()], "__domain string, __lang string, __source string, cut long"))
    until = F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(TOP))).otherwise(0)  # no place lies below 0
    chosen = scratch.write(planned.join(crossed, LEVELS, "left").select(*LEVELS, F.col("full").alias("__full"), until.alias("__cut")))
    at = F.shiftrightunsigned(F.xxhash64(F.lit(mixture.seed), F.col("__full"), F.xxhash64(F.col(key), F.col(text))), 2)
    times = F.col("__full") + F.when(at < F.col("__cut"), 1).otherwise(0)
    picked = docs.join(broadcast_upto(chosen, MAX_LEAVES), LEVELS).withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)))) if mixture.max_epochs > 1 else F.lit(1))
    picked = picked.where(times >= F.col("__epoch")).withColumn("__epoch", F.col("__epoch").cast("long") - 1)
    more = [F.col("__epoch"), n_tokens(F.col(text)).alias("__tokens")] if extra else []
    return picked.select(*(F.col(n).alias(c) for c, n in own.items() if not extra or c not in ("__epoch", "__tokens")), *more)
