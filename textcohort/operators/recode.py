"""Recoding texts with phrases and concept patterns in their context, and what is built on it.

Everything stays long: one row per case and feature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..sources.scratch import broadcast_upto

REACH = 80
#: Phrases that one automaton holds; a larger lexicon is searched in several passes.
MAX_PHRASES = 200_000
MAX_PATTERNS = 10_000


def ontology(spark: SparkSession) -> DataFrame:
    """concept, category, place, pattern: one row per pattern."""
    rows = [(k, cat, i, p) for k, (cat, ps) in C.ONTOLOGY.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "concept string, category string, place int, pattern string")


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Cues:
    """Whether cues of negation or uncertainty lie in parts of a text; each part is read as if it stood alone."""

    def __init__(self, cues: list[str]):
        self.regex = re.compile("|".join(f"(?:{c})" for c in cues))
        self.words = tuple(c.replace(r"\b", "") for c in cues)

    def within(self, text: str, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        found = []
        for w in self.words:  # each cue is plain words between word boundaries: searching for them is faster than the expression
            k = text.find(w)
            while k >= 0:
                e = k + len(w)
                if not (k and _in_word(text[k - 1])) and not (e < len(text) and _in_word(text[e])):
                    found.append((k, e))
                k = text.find(w, e)
        if found:
            at = np.array([*sorted(found), (len(text) + 1, len(text) + 1)])
            out = at[np.searchsorted(at[:, 0], start), 1] <= stop
        else:
            out = np.zeros(len(start), bool)
        # a cut through a word can leave a cue at an edge
        for k in np.flatnonzero(~out).tolist():
            a, b = int(start[k]), int(stop[k])
            if text.startswith(self.words, a, b) or text.endswith(self.words, a, b):
                out[k] = self.regex.search(text[a:b]) is not None
        return out


_NEGATED, _UNCERTAIN = Cues(C.NEGATION), Cues(C.UNCERTAINTY)


def statuses(text: str, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """0 present, 1 negated, 2 uncertain for places of a normalised text, by REACH characters on both sides; negated beats uncertain."""
    low, high = np.maximum(start - REACH, 0), np.minimum(stop + REACH, len(text))
    return np.where(_NEGATED.within(text, low, high), 1, np.where(_UNCERTAIN.within(text, low, high), 2, 0))


def needed(pattern: str) -> str:
    """A string that every match of a pattern has, or an empty one: the longest run of plain characters outside groups."""
    if "|" in pattern:
        return ""
    plain = re.sub(r"(\\[A-Za-z]|\[[^\]]*\]|\([^)]*\))(\{[^}]*\}|[*+?])*|.(\{[^}]*\}|[*+?])+", "\0", pattern)
    return max(re.split(r"[\0.^$\\]", plain), key=len)


def recode_patterns(cases: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """key, concept, present, negated, uncertain, matches: every match of every pattern, in its context.

    The lexicon (concept, pattern) is a fixed table of at most MAX_PATTERNS rows.  Each text is
    read once, in the task that has it, and gives a row for each concept it has; nothing is
    shuffled.  Patterns are regular expressions over the normalised text.
    """
    rows = lexicon.select("concept", "pattern").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"a lexicon has at most {MAX_PATTERNS} patterns")
    patterns = [(r.concept, r.pattern, needed(r.pattern)) for r in rows]
    kind = cases.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(c, re.compile(p), n) for c, p, n in patterns]
        for batch in batches:
            row, concept, count = [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                found: dict[str, list[tuple[int, int]]] = {}
                for c, p, n in compiled:
                    if n in t and (spans := [m.span() for m in p.finditer(t)]):
                        found.setdefault(c, []).extend(spans)
                if not found:
                    continue
                at = np.array([x for spans in found.values() for x in spans])
                status = statuses(t, at[:, 0], at[:, 1])
                done = 0
                for c, spans in found.items():
                    row.append(r)
                    concept.append(c)
                    count.append(np.bincount(status[done : done + len(spans)], minlength=3))
                    done += len(spans)
            n = np.array(count, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(concept, pa.string()), *(pa.array(n[:, k]) for k in range(3)), pa.array(n.sum(1))], names=["key", "concept", "present", "negated", "uncertain", "matches"])

    plain = cases.select(F.col(key).alias("key"), T.normalize_text(F.col(text)).alias("text"))
    found = plain.mapInArrow(run, f"key {kind}, concept string, present long, negated long, uncertain long, matches long")
    return found.withColumnRenamed("key", key)


def _first_places(cases: DataFrame, phrases: list[str], kind: str, with_status: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ahocorasick.Automaton()
        for p in phrases:
            search.add_word(p, p)
        search.make_automaton()
        for batch in batches:
            row, phrase, state = [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                first: dict[str, int] = {}
                for last, p in search.iter(t):
                    first.setdefault(p, last + 1)
                if not first:
                    continue
                row += [r] * len(first)
                phrase += first
                if with_status:
                    stop = np.array(list(first.values()))
                    state += statuses(t, stop - np.array([len(p) for p in first]), stop).tolist()
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(phrase, pa.string())]
            names = ["present", "negated", "uncertain"]
            yield pa.RecordBatch.from_arrays(out + [pa.array([names[s] for s in state], pa.string())] * with_status, names=["key", "phrase"] + ["status"] * with_status)

    return cases.mapInArrow(run, f"key {kind}, phrase string" + ", status string" * with_status)


def find_phrases(cases: DataFrame, phrases: DataFrame, key: str, text: str, with_status: bool = False) -> DataFrame:
    """key, phrase (and the status of its first place): the phrases that a text has, as they stand in it.

    Each pass searches a text for up to MAX_PHRASES phrases at once by an automaton, so the cost
    doesn't grow with texts times phrases, and what a task holds is bounded.
    """
    n = phrases.count()
    passes = -(-n // MAX_PHRASES)
    kind = cases.schema[key].dataType.simpleString()
    plain = cases.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = None
    for k in range(max(1, passes)):
        some = phrases if passes <= 1 else phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == k)
        own = [r.phrase for r in some.where("phrase <> ''").select("phrase").distinct().collect()]
        part = _first_places(plain, own, kind, with_status) if own else plain.sparkSession.createDataFrame([], f"key {kind}, phrase string" + ", status string" * with_status)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)


def recode_phrases(cases: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """key, phrase, status of the first place of each phrase that a normalised text has."""
    plain = cases.select(key, T.normalize_text(F.col(text)).alias("__t"))
    return find_phrases(plain, phrases, key, "__t", True)


def quoted(cases: DataFrame, quotes: DataFrame, key: str, text: str, name: str, quote: str) -> DataFrame:
    """key, name of the quotes that a text has, both with straight quotes and single blanks and lower-cased; a blank quote is in none."""
    plain = cases.select(key, T.straighten(F.col(text)).alias("__t"))
    told = quotes.select(name, T.straighten(F.col(quote)).alias("phrase")).where("phrase <> ''")
    return find_phrases(plain, told, key, "__t").join(told, "phrase").select(key, name)


def density(counts: DataFrame, cases: DataFrame, key: str, text: str) -> DataFrame:
    """Per case: words, and counts per word; texts without words have density 0."""
    words = cases.select(key, T.word_count(F.col(text)).alias("n_words"))
    total = counts.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("present", "negated", "uncertain")))
    filled = words.join(total, key, "left").fillna(0, ["present", "negated", "uncertain"])
    return filled.withColumns({f"{c}_density": F.coalesce(F.try_divide(c, "n_words"), F.lit(0.0)) for c in ("present", "negated", "uncertain")})


def reliability(hits: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Agreement of concepts of side a and side b over all cases: P(b), P(b|a), lift, odds ratio, mutual information.

    hits: key, side, concept, distinct.  Joint counts come from a join per case, so pairs that
    never meet in a case cost nothing until the grid of concepts is filled.
    """
    n = cases.agg(F.count("*").cast("double").alias("n"))
    own = hits.select(key, "side", "concept").distinct()
    a, b = own.where("side = 'a'").select(key, F.col("concept").alias("a")), own.where("side = 'b'").select(key, F.col("concept").alias("b"))
    na, nb = a.groupBy("a").agg(F.count("*").alias("na")), b.groupBy("b").agg(F.count("*").alias("nb"))
    both = a.join(b, key).groupBy("a", "b").agg(F.count("*").alias("nab"))
    grid = na.crossJoin(nb).join(both, ["a", "b"], "left").fillna(0, ["nab"]).crossJoin(F.broadcast(n))
    c11, c10, c01 = F.col("nab"), F.col("na") - F.col("nab"), F.col("nb") - F.col("nab")
    c00 = F.col("n") - F.col("na") - F.col("nb") + F.col("nab")
    p = lambda x, y: (x + 0.5) / (y + 1.0)
    cell = lambda c, x, y: F.when(c > 0, c / F.col("n") * F.ln(c * F.col("n") / (x * y))).otherwise(0.0)
    not_a, not_b = F.col("n") - F.col("na"), F.col("n") - F.col("nb")
    mi = cell(c11, F.col("na"), F.col("nb")) + cell(c10, F.col("na"), not_b) + cell(c01, not_a, F.col("nb")) + cell(c00, not_a, not_b)
    return grid.select(
        "a",
        "b",
        c11.alias("n_both"),
        p(F.col("nb"), F.col("n")).alias("p_b"),
        p(c11, F.col("na")).alias("p_b_given_a"),
        p(c11, F.col("nb")).alias("p_a_given_b"),
        p(c01, not_a).alias("p_b_given_not_a"),
        (p(c11, F.col("na")) - p(c01, not_a)).alias("delta"),
        (p(c11, F.col("na")) / p(F.col("nb"), F.col("n"))).alias("lift"),
        ((c11 + 0.5) * (c00 + 0.5) / ((c10 + 0.5) * (c01 + 0.5))).alias("odds_ratio"),
        mi.alias("mutual_information"),
    )


def weights(rel: DataFrame, stability: DataFrame, prevalence: DataFrame, association: DataFrame, least: float = 0.0, powers: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """A weight per concept of side a from its stability, its best partner, its association and its prevalence.

    Concepts below the least stability are dropped before the floor is applied.
    """
    by = Window.partitionBy("a").orderBy(F.desc("delta"), F.desc("lift"), F.desc("n_both"), "b")
    best = rel.withColumn("k", F.row_number().over(by)).where("k = 1")
    conc = 0.7 * F.greatest(F.col("delta"), F.lit(0.0)) + 0.2 * F.least(F.greatest(F.col("lift"), F.lit(0.0)), F.lit(5.0)) / 5 + 0.1 * F.greatest(F.col("mutual_information"), F.lit(0.0))
    eps = F.lit(1e-12)
    joined = prevalence.where("prevalence > 0").join(stability, "concept", "left").join(association, "concept", "left").join(best.select(F.col("a").alias("concept"), F.col("b").alias("partner"), conc.alias("concordance")), "concept", "left")
    kept = joined.fillna(0.0, ["frequency", "rho", "concordance"]).where(F.col("frequency") >= least)
    ambiguous = F.when(F.col("concept").isin(*C.AMBIGUITY), 0.55).otherwise(1.0)
    rare = F.least(F.lit(1.0), F.col("prevalence") / 0.05)
    raw = F.pow(F.greatest(F.col("frequency"), eps), powers[0]) * F.pow(F.greatest(F.col("concordance"), eps), powers[1]) * F.pow(1 + F.abs("rho"), powers[2]) * ambiguous * rare
    weighed = kept.withColumn("weight", raw)
    top = weighed.agg(F.max("weight").alias("__top"))
    return weighed.crossJoin(F.broadcast(top)).withColumn("normalized", F.coalesce(F.try_divide("weight", "__top"), F.lit(0.0))).drop("__top")


def weighted_scores(recoded: DataFrame, weight: DataFrame, key: str, uncertain: float = 0.5, negated: float = 0.0) -> DataFrame:
    """key, concept, score: weight times the value of the concept's status, beside the status itself."""
    value = (F.col("present") > 0).cast("double") + uncertain * (F.col("uncertain") > 0).cast("double") + negated * (F.col("negated") > 0).cast("double")
    return recoded.join(broadcast_upto(weight.select("concept", "normalized"), MAX_PHRASES), "concept").select(key, "concept", (value * F.col("normalized")).alias("score"), value.alias("status"))


def direction(rows: DataFrame, feature: str, value: str, target: str, given: str | None = None) -> DataFrame:
    """feature, direction: the sign of a supplied association, or else of the correlation of value and target; 0 where neither says."""
    own = F.signum(F.coalesce(F.corr(value, target), F.lit(0.0)))
    said = own if given is None else F.coalesce(F.signum(F.max(given)), own)
    return rows.groupBy(feature).agg(said.alias("direction"))


PHRASE_ITEM = "struct<quote:string,concept:string,normalized_phrase:string,candidate_concepts:string,polarity:string,certainty:string,laterality:string,section:string,mapping_confidence:double>"


def explode_phrases(records: DataFrame, key: str, seed: str = "seed", denovo: str = "denovo", missing: str = "missing") -> DataFrame:
    """One row per quoted phrase with reconciled polarity and certainty, its concepts and flags.

    Rules in order: unknown values count as affirmed and certain; a cue of negation makes an
    affirmed quote negated; a cue of uncertainty makes a certain one uncertain; what is then
    affirmed but uncertain has uncertain polarity.
    """
    tag = lambda c, name: F.transform(F.coalesce(F.col(c), F.array().cast(f"array<{PHRASE_ITEM}>")), lambda i: F.struct(F.lit(name).alias("source"), i.alias("item")))
    rows = records.where(F.coalesce(F.col(missing), F.lit(0)) != 1).select(key, F.explode(F.concat(tag(seed, "seed"), tag(denovo, "denovo"))).alias("x")).select(key, "x.source", "x.item.*")
    quote = T.squeeze(F.col("quote"))
    low = lambda c: F.lower(F.trim(T.safe_text(F.col(c))))
    given = F.when(low("polarity").isin("affirmed", "negated", "uncertain"), low("polarity")).otherwise("affirmed")
    sure = F.when(low("certainty").isin("certain", "uncertain"), low("certainty")).otherwise("certain")
    d = rows.withColumns({"quote": quote, "__p": given, "__c": sure}).where("quote <> ''")
    d = d.withColumn("__p", F.when((F.col("__p") == "affirmed") & T.negated(F.col("quote")), "negated").otherwise(F.col("__p")))
    d = d.withColumn("certainty", F.when((F.col("__c") == "certain") & T.uncertain(F.col("quote")), "uncertain").otherwise(F.col("__c")))
    d = d.withColumn("polarity", F.when((F.col("__p") == "affirmed") & (F.col("certainty") == "uncertain"), "uncertain").otherwise(F.col("__p")))
    concepts = T.infer_concepts(F.col("concept"), F.col("quote"), T.concept_list(F.col("candidate_concepts")))
    d = d.withColumns({"concepts": concepts, "slug": T.slug_key(F.col("quote")), "quote_norm": T.normalize_text(F.col("quote"))})
    return d.select(
        key,
        "source",
        "quote",
        "quote_norm",
        "slug",
        F.array_join("concepts", ";").alias("mapped_concepts"),
        F.element_at("concepts", 1).alias("canonical_group"),
        "polarity",
        "certainty",
        "mapping_confidence",
        ((F.col("polarity") == "affirmed") & (F.col("certainty") == "certain")).cast("int").alias("is_affirmed"),
        (F.col("polarity") == "negated").cast("int").alias("is_negated"),
        ((F.col("certainty") == "uncertain") | (F.col("polarity") == "uncertain")).cast("int").alias("is_uncertain"),
        (F.col("source") == "seed").cast("int").alias("is_seed"),
        (F.col("source") == "denovo").cast("int").alias("is_denovo"),
    )


def stable_lexicon(rows: DataFrame, members: DataFrame, case: str, feature: str, n_resamples: int, support: int, least: float, most: int | None = None) -> DataFrame:
    """Features that enough cases have in enough resamples: frequency, mean support, stable; the best `most` of them.

    members: resample, case.  Cases are few per feature or many: the distinct count is formed in
    two steps, so no feature's cases meet in one row.
    """
    seen = rows.select(case, feature).distinct().join(members, case)
    s = seen.groupBy("resample", feature).agg(F.count("*").alias("support"))
    n = F.count_if(F.col("support") >= support) / F.lit(n_resamples)
    out = s.groupBy(feature).agg(n.alias("frequency"), (F.sum("support") / F.lit(n_resamples)).alias("mean_support")).withColumn("stable", F.col("frequency") >= least)
    return out if most is None else out.where("stable").orderBy(F.desc("frequency"), F.desc("mean_support"), feature).limit(most)
