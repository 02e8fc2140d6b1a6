"""Queries of the recode, lexicon, calibration, hypothesis and resampling inventories (Q, H, X, R01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import hypothesis as H
from ..operators import metrics as M
from ..operators import recode as Q
from ..operators import split as X
from ..sources import files as S
from ..operators.ranks import thresholds
from ..sources.scratch import broadcast_upto, kept, new_path
from .registry import NORM, SPACE, query, wordy

#: A small lexicon for invented prose beside the shared ontology: concept and pattern.
PROSE = [("article", "the"), ("article", "an"), ("linking", "and"), ("linking", "with"), ("motion", "from"), ("motion", "into"), ("ending", "tion[a-z]*"), ("ending", "ment[a-z]*"), ("short", "\\b(?:de|la|le|un)\\b")]
LEXICON = PROSE + [(k, p) for k, (_, ps) in C.ONTOLOGY.items() for p in ps]
VALUES = ", ".join(f"('{c}', '{p}')" for c, p in LEXICON)
neg, unc = (T.any_of(p).replace("'", "''") for p in (C.NEGATION, C.UNCERTAINTY))
r = lambda c, k=6: F.round(c, k).alias(c)


def _lexicon(t):
    prose = t.spark.createDataFrame(PROSE, "concept string, pattern string")
    return prose.unionByName(Q.ontology(t.spark).select("concept", "pattern"))


def _status(context: str) -> str:
    return f"CASE WHEN regexp_matches({context}, '{neg}') THEN 'negated' WHEN regexp_matches({context}, '{unc}') THEN 'uncertain' ELSE 'present' END"


CTX = "substr(t, greatest(p - 80, 1), p + length(phrase) + 80 - greatest(p - 80, 1))"
PHRASES = ["the", "with", "this", "not of", "is that", "de la", "zzz"]
PHRASE_VALUES = ", ".join(f"('{p}')" for p in PHRASES)


@query("Q01", f"SELECT doc_id, phrase, {_status(CTX)} AS status FROM (SELECT doc_id, phrase, t, strpos(t, phrase) AS p FROM (SELECT doc_id, {wordy(NORM)} AS t FROM documents), (VALUES {PHRASE_VALUES}) v(phrase)) WHERE p > 0")
def q01(t):
    phrases = t.spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    return Q.recode_phrases(t.documents, phrases, "doc_id", "text")


RECODE = f"""n AS (SELECT doc_id, {wordy(NORM)} AS t FROM documents), h AS (SELECT doc_id, concept, t, regexp_split_to_array(t, pattern) AS b, regexp_extract_all(t, pattern) AS f FROM n, (VALUES {VALUES}) v(concept, pattern) WHERE regexp_matches(t, pattern)),
 e AS (SELECT doc_id, concept, t, length(f[i]) AS l, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) + 1 AS p FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM h)),
 k AS (SELECT doc_id, concept, {_status('substr(t, CAST(greatest(p - 80, 1) AS BIGINT), CAST(p + l + 80 - greatest(p - 80, 1) AS BIGINT))')} AS s FROM e),
 rc AS (SELECT doc_id, concept, count(*) FILTER (s = 'present') AS present, count(*) FILTER (s = 'negated') AS negated, count(*) FILTER (s = 'uncertain') AS uncertain, count(*) AS matches FROM k GROUP BY 1, 2)"""


def _recoded(t):
    return Q.recode_patterns(t.documents, _lexicon(t), "doc_id", "text")


@query("Q02", f"WITH {RECODE} SELECT * FROM rc")
def q02(t):
    return _recoded(t)


@query("Q03", f"WITH {RECODE} SELECT doc_id, concept AS feature, 'group' AS kind, CAST(present > 0 AS INT) AS present, present AS count, negated AS negated_count, uncertain AS uncertain_count FROM rc UNION ALL SELECT doc_id, phrase, 'phrase', 1, 1, 0, 0 FROM (SELECT doc_id, phrase, t, strpos(t, phrase) AS p FROM n, (VALUES {PHRASE_VALUES}) v(phrase)) WHERE p > 0 AND {_status(CTX)} = 'present'")
def q03(t):
    groups = _recoded(t).select("doc_id", F.col("concept").alias("feature"), F.lit("group").alias("kind"), (F.col("present") > 0).cast("int").alias("present"), F.col("present").alias("count"), F.col("negated").alias("negated_count"), F.col("uncertain").alias("uncertain_count"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    phrases = q01(t).where("status = 'present'").select("doc_id", F.col("phrase").alias("feature"), F.lit("phrase").alias("kind"), F.lit(1).alias("present"), one.alias("count"), zero.alias("negated_count"), zero.alias("uncertain_count"))
    return groups.unionByName(phrases)


@query("Q04", f"WITH {RECODE} SELECT doc_id, n_words, round(coalesce(present / nullif(n_words, 0), 0), 6) AS present_density, round(coalesce(negated / nullif(n_words, 0), 0), 6) AS negated_density FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_words FROM documents) LEFT JOIN (SELECT doc_id, sum(present) AS present, sum(negated) AS negated FROM rc GROUP BY 1) USING (doc_id)".replace("coalesce(present / ", "coalesce(coalesce(present, 0) / "))
def q04(t):
    return Q.density(_recoded(t), t.documents, "doc_id", "text").select("doc_id", "n_words", r("present_density"), r("negated_density"))


@query("Q05", f"WITH {RECODE} SELECT source, concept, CAST(sum(present) AS BIGINT) AS present, count(*) AS n_docs FROM rc JOIN documents USING (doc_id) GROUP BY 1, 2")
def q05(t):
    return _recoded(t).join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source", "concept").agg(F.sum("present").alias("present"), F.count("*").alias("n_docs"))


Q06_SQL = f"""WITH {RECODE}, m AS (SELECT doc_id, concept, x.r FROM rc, range(5) x(r) WHERE present > 0 AND (doc_id * 31 + r * 17) % 10 < 5), s AS (SELECT r, concept, count(*) AS support FROM m GROUP BY 1, 2)
 SELECT concept, round(count(*) FILTER (support >= 20) / 5.0, 6) AS frequency, round(sum(support) / 5.0, 6) AS mean_support, count(*) FILTER (support >= 20) / 5.0 >= 0.6 AS stable FROM s GROUP BY 1"""


def _members(t):
    which = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: F.pmod(F.col("doc_id") * 31 + k * 17, F.lit(10)) < 5)
    return t.documents.select("doc_id", F.explode(which).alias("resample"))


@query("Q06", Q06_SQL)
def q06(t):
    got = Q.stable_lexicon(_recoded(t).where("present > 0"), _members(t), "doc_id", "concept", 5, 20, 0.6)
    return got.select("concept", r("frequency"), r("mean_support"), "stable")


REL = """d AS (SELECT doc_id, text, lang FROM documents), n AS (SELECT count(*) AS n FROM d),
 a AS (SELECT doc_id, c AS a FROM d, (VALUES ('the'), ('que'), ('der')) v(c) WHERE contains(lower(text), c)), b AS (SELECT doc_id, c AS b FROM d, (VALUES ('and'), ('les'), ('ung')) v(c) WHERE contains(lower(text), c)),
 na AS (SELECT a, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT b, count(*) AS nb FROM b GROUP BY 1), ab AS (SELECT a, b, count(*) AS nab FROM a JOIN b USING (doc_id) GROUP BY 1, 2),
 g AS (SELECT a, b, CAST(coalesce(nab, 0) AS DOUBLE) AS c11, na - coalesce(nab, 0) AS c10, nb - coalesce(nab, 0) AS c01, n - na - nb + coalesce(nab, 0) AS c00, na, nb, n FROM na CROSS JOIN nb LEFT JOIN ab USING (a, b), n),
 rel AS (SELECT a, b, CAST(c11 AS BIGINT) AS n_both, (nb + 0.5) / (n + 1) AS p_b, (c11 + 0.5) / (na + 1) AS p_b_given_a, (c11 + 0.5) / (nb + 1) AS p_a_given_b, (c01 + 0.5) / (n - na + 1) AS p_b_given_not_a, (c11 + 0.5) / (na + 1) - (c01 + 0.5) / (n - na + 1) AS delta, ((c11 + 0.5) / (na + 1)) / ((nb + 0.5) / (n + 1)) AS lift,
  (c11 + 0.5) * (c00 + 0.5) / ((c10 + 0.5) * (c01 + 0.5)) AS odds_ratio, CASE WHEN c11 > 0 THEN c11 / n * ln(c11 * n / (na * nb)) ELSE 0 END + CASE WHEN c10 > 0 THEN c10 / n * ln(c10 * n / (CAST(na AS DOUBLE) * (n - nb))) ELSE 0 END + CASE WHEN c01 > 0 THEN c01 / n * ln(c01 * n / (CAST(n - na AS DOUBLE) * nb)) ELSE 0 END + CASE WHEN c00 > 0 THEN c00 / n * ln(c00 * n / (CAST(n - na AS DOUBLE) * (n - nb))) ELSE 0 END AS mutual_information FROM g)"""
REL_COLS = ["p_b", "p_b_given_a", "p_a_given_b", "p_b_given_not_a", "delta", "lift", "odds_ratio", "mutual_information"]


def _reliability(t):
    sides = {"a": ["the", "que", "der"], "b": ["and", "les", "ung"]}
    words = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(w).alias("concept")) for s, ws in sides.items() for w in ws))
    hits = t.documents.select("doc_id", F.lower("text").alias("text"), F.explode(words).alias("w")).where(F.contains("text", F.col("w.concept"))).select("doc_id", "w.side", "w.concept")
    return Q.reliability(hits, t.documents, "doc_id"), hits


@query("H11", f"WITH {REL} SELECT a, b, n_both, {', '.join(f'round({c}, 6) AS {c}' for c in REL_COLS)} FROM rel")
def h11(t):
    return _reliability(t)[0].select("a", "b", "n_both", *(r(c) for c in REL_COLS))


Q07_SQL = f"""WITH {REL}, best AS (SELECT a, b, 0.7 * greatest(delta, 0) + 0.2 * least(greatest(lift, 0), 5) / 5 + 0.1 * greatest(mutual_information, 0) AS conc FROM rel QUALIFY row_number() OVER (PARTITION BY a ORDER BY delta DESC, lift DESC, n_both DESC, b) = 1),
 w AS (SELECT best.a AS concept, b AS partner, (na / CAST(n AS DOUBLE)) * greatest(conc, 1e-12) * least(1.0, na / CAST(n AS DOUBLE) / 0.05) AS weight FROM best JOIN na ON best.a = na.a, n)
 SELECT concept, partner, round(weight, 6) AS weight, round(weight / max(weight) OVER (), 6) AS normalized FROM w"""


def _weights(t):
    rel, hits = _reliability(t)
    n = t.documents.agg(F.count("*").alias("n"))
    share = hits.where("side = 'a'").groupBy("concept").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).select("concept", (F.col("k") / F.col("n")).alias("prevalence"))
    return Q.weights(rel, share.select("concept", F.col("prevalence").alias("frequency")), share, share.select("concept", F.lit(0.0).alias("rho")))


@query("Q07", Q07_SQL)
def q07(t):
    return _weights(t).select("concept", "partner", r("weight"), r("normalized"))


@query("Q08")
def q08(t):
    hits = _reliability(t)[1].where("side = 'a'").select("doc_id", "concept", F.lit(1).alias("present"), F.lit(0).alias("uncertain"), F.lit(0).alias("negated"))
    return Q.weighted_scores(hits, _weights(t), "doc_id").select("doc_id", "concept", r("score"), "status")


@query("Q09", "SELECT row_id, concat_ws(';', CASE WHEN y_value > 250000 THEN 'score out of range' END, CASE WHEN y_prob NOT BETWEEN 0.01 AND 0.99 THEN 'probability out of range' END, CASE WHEN (y_prob >= 0.5) <> (y_bin = 1) THEN 'label disagrees' END) AS violations FROM pred_v")
def q09(t):
    rules = F.array(F.when(F.col("y_value") > 250000, "score out of range"), F.when(~F.col("y_prob").between(0.01, 0.99), "probability out of range"), F.when((F.col("y_prob") >= 0.5) != (F.col("y_bin") == 1), "label disagrees"))
    return t.pred_v.select("row_id", F.array_join(F.array_compact(rules), ";").alias("violations"))


@query("Q10", "SELECT row_id, row_id % 2 = 0 AND role = 'test' AS valid FROM pred_v WHERE case_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def q10(t):
    plan = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("case_id"))
    return t.pred_v.join(plan, "case_id", "left_semi").select("row_id", ((F.col("row_id") % 2 == 0) & (F.col("role") == "test")).alias("valid"))


def _records(t):
    quote = F.element_at(F.split("text", r"\.\s*|\n"), 1)
    item = F.struct(quote.alias("quote"), F.col("source").alias("concept"), F.lit("").alias("normalized_phrase"), F.lit("multiplicity; x").alias("candidate_concepts"), F.when(F.col("doc_id") % 3 == 0, "negated").when(F.col("doc_id") % 3 == 1, "affirmed").otherwise("?").alias("polarity"), F.when(F.col("doc_id") % 5 == 0, "uncertain").otherwise("").alias("certainty"), F.lit("left").alias("laterality"), F.lit("findings").alias("section"), F.lit(0.5).alias("mapping_confidence"))
    return t.documents.select("doc_id", F.array(item).cast(f"array<{Q.PHRASE_ITEM}>").alias("seed"), F.when(F.col("doc_id") % 7 == 0, F.array(item)).cast(f"array<{Q.PHRASE_ITEM}>").alias("denovo"), F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0).alias("missing"))


R01_SQL = f"""WITH q AS (SELECT doc_id, trim(regexp_replace(regexp_split_to_array(text, '\\.\\s*|\\n')[1], '{SPACE}', ' ', 'g')) AS quote FROM documents WHERE doc_id % 11 <> 0),
 s AS (SELECT *, 'seed' AS source FROM q UNION ALL SELECT *, 'denovo' FROM q WHERE doc_id % 7 = 0),
 p AS (SELECT *, CASE WHEN doc_id % 3 <> 0 AND regexp_matches({wordy('lower(quote)')}, '{neg}') THEN 'negated' WHEN doc_id % 3 = 0 THEN 'negated' ELSE 'affirmed' END AS p0, CASE WHEN doc_id % 5 = 0 OR regexp_matches({wordy('lower(quote)')}, '{unc}') THEN 'uncertain' ELSE 'certain' END AS certainty FROM s WHERE quote <> '')
 SELECT doc_id, source, quote, CASE WHEN p0 = 'affirmed' AND certainty = 'uncertain' THEN 'uncertain' ELSE p0 END AS polarity, certainty FROM p"""


@query("R01", R01_SQL)
def r01(t):
    return Q.explode_phrases(_records(t), "doc_id").select("doc_id", "source", "quote", "polarity", "certainty")


@query("Q11")
def q11(t):
    got = Q.explode_phrases(_records(t), "doc_id")
    return got.select("doc_id", "source", "slug", "canonical_group", "mapped_concepts", "is_affirmed", "is_negated", "is_uncertain")


@query("Q13", "SELECT l_returnflag AS concept, CAST(sign(corr(l_quantity, l_discount)) AS DOUBLE) AS direction FROM lineitem GROUP BY 1")
def q13(t):
    return Q.direction(t.lineitem.withColumnRenamed("l_returnflag", "concept"), "concept", "l_quantity", "l_discount")


@query("Q14", "SELECT mode, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN k > 1 THEN least(tokens, 20) ELSE 0 END) AS BIGINT) AS cached FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY seq) AS k FROM usage_v) GROUP BY 1")
def q14(t):
    first = t.usage_v.groupBy("mode").agg(F.min("seq").alias("first"))
    d = t.usage_v.join(broadcast_upto(first, 10_000), "mode")
    return d.groupBy("mode").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("seq") > F.col("first"), F.least("tokens", F.lit(20))).otherwise(0)).alias("cached"))


@query("Q15", "SELECT run_id, 'headline' AS kind, max(value) AS value FROM metric_v WHERE raw_metric = 'AUROC' AND modality IN ('m0', 'm1') GROUP BY 1")
def q15(t):
    return t.metric_v.where("raw_metric = 'AUROC' AND modality IN ('m0', 'm1')").groupBy("run_id").agg(F.max("value").alias("value")).withColumn("kind", F.lit("headline"))


@query("Q16", "SELECT case_id, sha256('Case ' || case_id || chr(10) || 'Language: ' || lang || chr(10) || text_b) AS h FROM cases_v")
def q16(t):
    return t.cases_v.select("case_id", F.sha2(F.concat_ws("\n", F.concat(F.lit("Case "), "case_id"), F.concat(F.lit("Language: "), "lang"), "text_b"), 256).alias("h"))


@query("Q17", "SELECT mode, count(*) AS calls, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 9) AS BIGINT) AS tokens FROM documents, (VALUES ('a'), ('b')) m(mode) WHERE NOT (mode = 'a' AND doc_id % 6 = 0) AND doc_id % 13 <> 0 GROUP BY 1")
def q17(t):
    planned = t.documents.withColumn("mode", F.explode(F.array(F.lit("a"), F.lit("b"))))
    done = t.documents.where("doc_id % 13 = 0").select("doc_id")
    skipped = t.documents.where("doc_id % 6 = 0").select("doc_id", F.lit("a").alias("mode"))
    left = planned.join(done, "doc_id", "left_anti").join(skipped, ["doc_id", "mode"], "left_anti")
    return left.groupBy("mode").agg(F.count("*").alias("calls"), F.sum(T.tokens_by_chars(F.col("text")) + 9).alias("tokens"))


@query("Q18", f"WITH {RECODE} SELECT toxic, round(avg(coalesce(present, 0)), 6) AS mean_present, count(*) AS n FROM documents d JOIN labels USING (doc_id) LEFT JOIN (SELECT doc_id, sum(present) AS present FROM rc GROUP BY 1) USING (doc_id) GROUP BY 1")
def q18(t):
    """The flagship composition: recode, join to labels, audit by label."""
    present = _recoded(t).groupBy("doc_id").agg(F.sum("present").alias("present"))
    return t.documents.select("doc_id").join(t.labels, "doc_id").join(present, "doc_id", "left").groupBy("toxic").agg(F.round(F.avg(F.coalesce("present", F.lit(0))), 6).alias("mean_present"), F.count("*").alias("n"))


# ----- tests


PAIRED = "round(avg(y - x), 6) AS mean_diff, median(y - x) AS median_diff, round(avg(y - x) / stddev_samp(y - x), 6) AS dz, count(*) FILTER (y > x) AS n_up, count(*) FILTER (y < x) AS n_down, count(*) AS n"


@query("H01", f"SELECT g, {PAIRED} FROM pairs_v GROUP BY 1")
def h01(t):
    return H.paired(t.pairs_v, ["g"], "x", "y").select("g", r("mean_diff"), "median_diff", r("dz"), "n_up", "n_down", "n")


@query("H01p")
def h01p(t):
    return H.paired(t.pairs_v, ["g"], "x", "y").select("g", "t", "z_wilcoxon", "p_t", "p_sign", "p_wilcoxon")


@query("H02", "WITH p AS (SELECT g, s, count(*) FILTER (bx = 1 AND bz = 0) AS b, count(*) FILTER (bx = 0 AND bz = 1) AS c FROM pairs_v GROUP BY 1, 2) SELECT g, s, b, c FROM p")
def h02(t):
    return H.mcnemar(t.pairs_v, ["g", "s"], "bx", "bz").select("g", "s", "b", "c")


@query("H02p")
def h02p(t):
    return H.mcnemar(t.pairs_v, ["g", "s"], "bx", "bz")


@query("H03", "SELECT g, bool_and(bx IN (0, 1)) AS binary_x, bool_and(x IN (0, 1)) AS binary_q FROM pairs_v GROUP BY 1")
def h03(t):
    return t.pairs_v.groupBy("g").agg(F.bool_and(F.col("bx").isin(0, 1)).alias("binary_x"), F.bool_and(F.col("x").isin(0.0, 1.0)).alias("binary_q"))


@query("H04", f"SELECT 'all' AS stratum, {PAIRED} FROM pairs_v UNION ALL SELECT s, {PAIRED} FROM pairs_v GROUP BY 1")
def h04(t):
    both = t.pairs_v.withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("s"))))
    return H.paired(both, ["stratum"], "x", "y").select("stratum", r("mean_diff"), "median_diff", r("dz"), "n_up", "n_down", "n")


@query("H05", "SELECT g, s, k, p, round(least(min(p * m / i) OVER (PARTITION BY g ORDER BY p DESC), 1.0), 8) AS q FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m, rank() OVER (PARTITION BY g ORDER BY p) + count(*) OVER (PARTITION BY g, p) - 1 AS i FROM (SELECT g, s, CAST(y AS BIGINT) AS k, round(avg(bx) / 4, 6) AS p FROM pairs_v GROUP BY ALL))")
def h05(t):
    from ..operators.ranks import benjamini_hochberg

    p = t.pairs_v.groupBy("g", "s", F.col("y").cast("long").alias("k")).agg(F.round(F.avg("bx") / 4, 6).alias("p"))
    return benjamini_hochberg(p, ["g"], "p").select("g", "s", "k", "p", F.round("q", 8).alias("q"))


U_SQL = "k AS (SELECT g, bx, x, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx FROM pairs_v), u AS (SELECT g, count(*) FILTER (bx = 1) AS n1, count(*) FILTER (bx = 0) AS n0, sum(rx) FILTER (bx = 1) - count(*) FILTER (bx = 1) * (count(*) FILTER (bx = 1) + 1) / 2.0 AS u, avg(x) FILTER (bx = 1) - avg(x) FILTER (bx = 0) AS mean_diff, var_samp(x) FILTER (bx = 1) / count(*) FILTER (bx = 1) AS e1, var_samp(x) FILTER (bx = 0) / count(*) FILTER (bx = 0) AS e0 FROM k GROUP BY 1)"


@query("H06", f"WITH {U_SQL} SELECT g, n1, n0, CAST(u AS DOUBLE) AS u, round(mean_diff, 6) AS mean_diff, round(mean_diff / sqrt(e1 + e0), 6) AS welch_t FROM u")
def h06(t):
    return H.two_groups(t.pairs_v, ["g"], "bx", "x").select("g", "n1", "n0", F.col("u").cast("double").alias("u"), r("mean_diff"), r("welch_t"))


@query("H07", f"WITH {U_SQL} SELECT g, round(2 * u / (n1 * n0) - 1, 6) AS cliffs_delta FROM u")
def h07(t):
    return H.two_groups(t.pairs_v, ["g"], "bx", "x").select("g", r("cliffs_delta"))


@query("H08", "SELECT g, a, b, c, d, round(a * d / CAST(b * c AS DOUBLE), 6) AS odds_ratio, round(a / CAST(a + b AS DOUBLE) - c / CAST(c + d AS DOUBLE), 6) AS risk_difference FROM (SELECT g, count(*) FILTER (bx = 1 AND bz = 1) AS a, count(*) FILTER (bx = 1 AND bz = 0) AS b, count(*) FILTER (bx = 0 AND bz = 1) AS c, count(*) FILTER (bx = 0 AND bz = 0) AS d FROM pairs_v GROUP BY 1)")
def h08(t):
    return H.two_by_two(t.pairs_v, ["g"], "bx", "bz").select("g", "a", "b", "c", "d", r("odds_ratio"), r("risk_difference"))


@query("H08p")
def h08p(t):
    return H.two_by_two(t.pairs_v, ["g"], "bx", "bz")


WILSON = "(p + 1.959963984540054 ** 2 / (2 * n) {} 1.959963984540054 * sqrt(p * (1 - p) / n + 1.959963984540054 ** 2 / (4 * n * n))) / (1 + 1.959963984540054 ** 2 / n)"


@query("H09", f"SELECT g, round({WILSON.format('-')}, 6) AS low, round({WILSON.format('+')}, 6) AS high, round(greatest(p - 1.959963984540054 * sqrt(p * (1 - p) / n), 0), 6) AS normal_low FROM (SELECT g, CAST(count(*) AS DOUBLE) AS n, avg(bx) AS p FROM pairs_v GROUP BY 1)")
def h09(t):
    got = t.pairs_v.groupBy("g").agg(F.sum("bx").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = H.wilson(F.col("k"), F.col("n"))
    return got.select("g", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(H.normal_interval(F.col("k"), F.col("n"))[0], 6).alias("normal_low"))


@query("H10", "SELECT g || ': ' || printf('%.2f', abs(avg(y - x))) || CASE WHEN avg(y - x) > 0 THEN ' higher' ELSE ' lower' END AS finding FROM pairs_v GROUP BY g")
def h10(t):
    d = F.avg(F.col("y") - F.col("x"))
    return t.pairs_v.groupBy("g").agg(F.abs(d).alias("a"), F.when(d > 0, "higher").otherwise("lower").alias("w")).select(F.format_string("%s: %.2f %s", "g", "a", "w").alias("finding"))


# ----- splits and resamples


def _cases(t):
    return t.cases_v.where("relapse IS NOT NULL").select("case_id", F.col("relapse").cast("long").alias("y"))


@query("X01")
def x01(t):
    return X.monte_carlo(_cases(t), "case_id", "y", 3, 0.2, 17)


@query("X01k")
def x01k(t):
    return X.k_fold(_cases(t), "case_id", "y", 5, 17)


@query("X02")
def x02(t):
    return X.resamples(_cases(t), "case_id", 25, 0.8, 17)


@query("X03")
def x03(t):
    splits = X.monte_carlo(_cases(t), "case_id", "y", 3, 0.2, 17).withColumnRenamed("repeat", "split")
    return X.violations(splits, _cases(t), "case_id")


@query("X04", "SELECT split_id, role, count(*) AS n, CAST(sum(y_bin) AS BIGINT) AS positives FROM pred_v GROUP BY 1, 2")
def x04(t):
    return X.balance(t.pred_v, ["split_id", "role"], "y_bin")


@query("X05", "SELECT split_id, CASE WHEN (case_id + split_id) % 3 = 0 THEN 'test' ELSE 'train' END AS role, case_id, count(*) AS n FROM pred_v GROUP BY ALL")
def x05(t):
    """Splits rebuilt by case name from saved manifests, which are long: a row for each split, role and case."""
    path = new_path(t.spark)
    role = F.when((F.col("case_id") + F.col("split_id")) % 3 == 0, "test").otherwise("train")
    S.replace(t.pred_v.select("split_id", role.alias("role"), "case_id").distinct(), path, ["split_id"])
    manifest = t.spark.read.parquet(path).withColumn("split_id", F.col("split_id").cast("long"))
    return X.rebuilt(t.pred_v.drop("role"), manifest, ["split_id", "case_id"]).groupBy("split_id", "role", "case_id").agg(F.count("*").alias("n"))


def _boot(t, values=200):
    weighed = X.poisson_bootstrap(t.pred_v.select("row_id", "model_key", "y_true", "y_value", "y_prob", "y_bin"), "row_id", values, 42)
    w = F.col("weight")
    d = F.abs(F.col("y_value") - F.col("y_true"))
    hit = ((F.col("y_prob") >= 0.5).cast("int") == F.col("y_bin")).cast("int")
    return weighed.groupBy("model_key", "replicate").agg((F.sum(w * d) / F.sum(w)).alias("mae"), (F.sum(w * hit) / F.sum(w)).alias("accuracy"), F.sqrt(F.sum(w * d * d) / F.sum(w)).alias("rmse"))


@query("X06")
def x06(t):
    return X.intervals(_boot(t), ["model_key"], ["mae", "accuracy"])


@query("X07")
def x07(t):
    return X.intervals(_boot(t).withColumn("config", F.col("model_key")), ["config"], ["mae", "rmse", "accuracy"])


@query("X08")
def x08(t):
    point = M.regression(t.pred_v, ["model_key"], "y_true", "y_value").select("model_key", "mae", "rmse")
    return point.join(X.intervals(_boot(t), ["model_key"], ["mae", "rmse"]), "model_key")


@query("X09")
def x09(t):
    weighed = X.poisson_bootstrap(t.pairs_v.select("id", "g", "x", "bx"), "id", 200, 5)
    mean = lambda k: F.sum(F.when(F.col("bx") == k, F.col("weight") * F.col("x"))) / F.sum(F.when(F.col("bx") == k, F.col("weight")))
    return X.intervals(weighed.groupBy("g", "replicate").agg((mean(1) - mean(0)).alias("difference")), ["g"], ["difference"])


@query("X10")
def x10(t):
    """Each model's AUROC in each dataset, over all splits, against its labels permuted."""
    by = ["dataset_key", "model_key"]
    # each row is read 50 times: in many files, which small tables would otherwise not have
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.spark.sparkContext.defaultParallelism)
    p = kept(t.pred_v.select(*by, "row_id", "y_prob", "y_bin").repartition(tasks, "row_id"))
    mixed = X.permuted_counts(p, by, "row_id", "y_prob", "y_bin", 50)
    null = M.areas(thresholds(mixed, [*by, "replicate"], "y_prob"), [*by, "replicate"]).select(*by, "auroc")
    seen = M.auroc_auprc(p, by, "y_prob", "y_bin").select(*by, F.col("auroc").alias("observed"))
    return null.join(seen, by).groupBy(*by, "observed").agg(((1 + F.count_if(F.col("auroc") >= F.col("observed"))) / (1 + F.count("auroc"))).alias("p"))


@query("X11")
def x11(t):
    return X.shuffled(t.pairs_v.select("id", "g", "x"), ["g"], "x", 3, "x_shuffled")


@query("X12", "SELECT id, x, y FROM pairs_v WHERE id % 100 = 3 ORDER BY id, x, y LIMIT 200")
def x12(t):
    """A bounded plot sample."""
    return t.pairs_v.where("id % 100 = 3").select("id", "x", "y").orderBy("id", "x", "y").limit(200)


@query("X13")
def x13(t):
    weighed = X.poisson_bootstrap(t.pred_v.where("role = 'test'").select("row_id", "model_key", "y_true", "y_bin"), "row_id", 100, 9)
    cut = (F.col("y_true") >= 150000).cast("int") == F.col("y_bin")
    stat = weighed.groupBy("model_key", "replicate").agg((F.sum(F.col("weight") * cut.cast("int")) / F.sum("weight")).alias("mediated"))
    return X.intervals(stat, ["model_key"], ["mediated"])


@query("X14")
def x14(t):
    point = M.classification(t.pred_v, ["model_key"], "y_bin", "y_prob").select("model_key", "accuracy", "f1")
    return point.join(X.intervals(_boot(t, 100), ["model_key"], ["accuracy"]), "model_key")


@query("X15")
def x15(t):
    wide = X.intervals(_boot(t, 100), ["model_key"], ["mae", "accuracy"])
    return wide.select("model_key", F.expr("stack(2, 'mae', mae_ci_low, mae_ci_high, mae_n, 'accuracy', accuracy_ci_low, accuracy_ci_high, accuracy_n) AS (metric, low, high, n)"))
