"""Queries of the scalar-function and cohort inventories (T, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions import udfs
from ..operators import recode as Q
from .registry import NORM, query, wordy

ASCII = r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s\-/]', ' ', 'g'), '\s+', ' ', 'g'))"
SLUG = rf"CASE WHEN regexp_replace(regexp_replace({NORM}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'empty' ELSE left(regexp_replace(regexp_replace({NORM}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 120) END"
lit_list = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
pattern = lambda ps: T.any_of(ps).replace("'", "''")
MISSING_B = rf"(trim(regexp_replace(lower(coalesce(text_a, '')), '\s+', ' ', 'g')) IN ({lit_list(C.MISSING_B)}))"
MISSING_A = rf"(trim(regexp_replace(lower(coalesce(text_a, '')), '\s+', ' ', 'g')) IN ('', {lit_list(C.MISSING_A)}))"


@query("T01", f"SELECT doc_id, md5({NORM}) AS h FROM documents")
def t01(t):
    return t.documents.select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("h"))


@query("T02", f"SELECT doc_id, md5({ASCII}) AS h FROM documents")
def t02(t):
    return t.documents.select("doc_id", F.md5(T.normalize_ascii(F.col("text"))).alias("h"))


@query("T03", f"SELECT doc_id, {SLUG} AS slug FROM documents")
def t03(t):
    return t.documents.select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("T04", f"SELECT doc_id, regexp_matches({wordy('lower(text)')}, '{pattern(C.NEGATION)}') AS negated, regexp_matches({wordy('lower(text)')}, '{pattern(C.UNCERTAINTY)}') AS uncertain FROM documents")
def t04(t):
    return t.documents.select("doc_id", T.negated(F.col("text")).alias("negated"), T.uncertain(F.col("text")).alias("uncertain"))


@query("T05", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words FROM documents")
def t05(t):
    return t.documents.select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("T06")
def t06(t):
    return t.documents.select("doc_id", udfs.fold_udf("text").alias("folded"))


@query("T07", "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text))")
def t07(t):
    return Q.quoted(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")


JACCARD = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query("T08", f"SELECT conv_id, turn, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS j FROM (SELECT u.conv_id, u.turn, {JACCARD.format('u.text')} AS a, {JACCARD.format('v.text')} AS b FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1)")
def t08(t):
    u, v = t.conversations.alias("u"), t.conversations.alias("v")
    return u.join(v, (F.col("u.conv_id") == F.col("v.conv_id")) & (F.col("v.turn") == F.col("u.turn") + 1)).select("u.conv_id", "u.turn", F.round(T.token_jaccard(F.col("u.text"), F.col("v.text")), 6).alias("j"))


def _misquoted(t):
    """Quotes of early words of each document, one letter exchanged."""
    return t.documents.select("doc_id", "text", F.translate(F.regexp_extract("text", r"(?:\S+\s+){3}((?:\S+\s+){5}\S+)", 1), "x", "y").alias("quote"))


@query("T09")
def t09(t):
    return t.documents.select("doc_id", udfs.n_windows_udf("text").alias("n_windows"))


@query("T10")
def t10(t):
    return _misquoted(t).where("quote <> ''").select("doc_id", udfs.repair_udf("text", F.concat(F.lit("x"), "quote")).alias("span"))


TOKENS = f"list_filter(string_split({ASCII}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({lit_list(C.STOPWORDS)}))"


@query("T11", f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n, md5(array_to_string({TOKENS}, ' ')) AS h FROM documents")
def t11(t):
    told = T.bound(T.evidence_tokens(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("h")))
    return t.documents.select("doc_id", F.explode(F.array(told)).alias("t")).select("doc_id", "t.*")


GRAMS = f"(SELECT doc_id, w FROM (SELECT doc_id, {TOKENS} AS w FROM documents))"


@query("T12", f"SELECT doc_id, count(DISTINCT x) AS n_terms FROM (SELECT doc_id, unnest(w) AS x FROM {GRAMS} UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {GRAMS}) GROUP BY 1")
def t12(t):
    n = T.bound(T.evidence_tokens(F.col("text")), lambda w: F.size(T.uni_and_bigrams(w)).cast("long"))
    # exploded, so that the filter isn't pushed below and the tokens worked out again
    return t.documents.select("doc_id", F.explode(F.array(n)).alias("n_terms")).where("n_terms > 0")


W12_SQL = f"SELECT x AS term, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM {GRAMS}) GROUP BY 1 ORDER BY n DESC, term LIMIT 50"


@query("W12", W12_SQL)
def w12(t):
    pairs = T.bound(T.evidence_tokens(F.col("text")), T.neighbours)
    return t.documents.select(F.explode(pairs).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query("T13", f"SELECT doc_id, {', '.join(f'''CAST(regexp_matches({wordy(NORM)}, '{p}') AS INT) AS {k}''' for k, p in C.SECTION_FLAGS.items())} FROM documents")
def t13(t):
    return t.documents.select("doc_id", *(c.alias(k) for k, c in T.flags(F.col("text"), C.SECTION_FLAGS).items()))


@query("T14", r"""SELECT page_id, md5(string_agg(s, chr(10) || chr(10) ORDER BY i)) AS h, count(*) AS n FROM (SELECT page_id, i, trim(sections[i], chr(10) || ' ' || chr(9)) AS s FROM (SELECT page_id, sections, unnest(range(1, len(sections) + 1)) AS i FROM (SELECT page_id, string_split_regex(regexp_replace(html, '[ \t]+\n', chr(10), 'g'), '\n[ \t]*\n+') AS sections FROM pages)))
 WHERE s <> '' AND NOT starts_with(upper(trim(string_split(string_split(s, chr(10))[1], ':')[1])), '<SCRIPT') GROUP BY 1""")
def t14(t):
    kept = F.filter(T.sections(F.col("html")), lambda s: ~F.startswith(F.upper(F.trim(F.substring_index(F.substring_index(s, "\n", 1), ":", 1))), F.lit("<SCRIPT")))
    return t.pages.select("page_id", F.md5(F.array_join(kept, "\n\n")).alias("h"), F.size(kept).cast("long").alias("n")).where("n > 0")


@query("T15", "SELECT case_id, upper(left(sha256(case_id || '|' || row_index || '|' || lang), 10)) AS token FROM cases_v")
def t15(t):
    return t.cases_v.select("case_id", T.case_token(F.col("case_id"), F.col("row_index").cast("string"), F.col("lang")).alias("token"))


@query("T16", "SELECT source, row_index // 1000 AS block, left(sha256(string_agg(case_id, chr(10) ORDER BY row_index)), 16) AS ordered, left(sha1(string_agg(case_id, '|' ORDER BY case_id)), 16) AS sorted FROM cases_v GROUP BY ALL")
def t16(t):
    """Hashes of id lists, one for each thousand of the table, so that no list grows with it."""
    ids = t.cases_v.groupBy("source", F.floor(F.col("row_index") / 1000).alias("block")).agg(F.sort_array(F.collect_list(F.struct("row_index", "case_id"))).alias("x"))
    ordered = F.transform("x", lambda s: s["case_id"])
    return ids.select("source", "block", T.list_hash(ordered).alias("ordered"), T.set_hash(ordered).alias("sorted"))


@query("T17")
def t17(t):
    return t.events.select("event_id", F.from_json(udfs.literal_udf("props"), "map<string,string>").alias("parsed"))


@query("T18", "SELECT event_id, props AS object FROM events")
def t18(t):
    noisy = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Answer: "), "props", F.lit(" end"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return t.events.select("event_id", T.json_in_text(noisy).alias("object"))


@query("T19", r"SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda x: trim(x) <> ''), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g')), ';') AS concepts FROM part")
def t19(t):
    return t.part.select("p_partkey", F.array_join(T.concept_list(F.replace("p_name", F.lit(" "), F.lit(";"))), ";").alias("concepts"))


T20_SQL = ", ".join(f"CASE WHEN regexp_matches(x, '{pattern(p)}') THEN '{k}' END" for k, (_, p) in C.ONTOLOGY.items())
PHRASES = "(SELECT doc_id, (['patchy residual', 'segmental extent 3 cm', 'no lvi', 'clear margin', 'fibrosis', 'stable'])[1 + doc_id % 6] || ' || ' || lang AS x FROM documents)"


@query("T20", f"SELECT doc_id, CASE WHEN c = '' THEN '{C.DEFAULT_CONCEPT}' ELSE c END AS concepts FROM (SELECT doc_id, concat_ws(';', {T20_SQL}) AS c FROM {PHRASES})")
def t20(t):
    raw = F.element_at(F.array(*(F.lit(x) for x in ["patchy residual", "segmental extent 3 cm", "no lvi", "clear margin", "fibrosis", "stable"])), (1 + F.col("doc_id") % 6).cast("int"))
    return t.documents.select("doc_id", F.array_join(T.infer_concepts(raw, F.col("lang"), F.array().cast("array<string>")), ";").alias("concepts"))


@query("T21", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def t21(t):
    return t.pages.select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("T22", r"SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS by_chars, CAST(greatest(1, floor(greatest(length(text) / 4.0, len(regexp_extract_all(text, '\S+')) * CAST(1.33 AS DOUBLE)))) AS BIGINT) AS rough FROM conversations")
def t22(t):
    return t.conversations.select("conv_id", "turn", T.tokens_by_chars(F.col("text")).alias("by_chars"), T.tokens_rough(F.col("text")).alias("rough"))


@query("T23", "WITH RECURSIVE b AS (SELECT mode, min(text) AS a, max(text) AS z FROM usage_v WHERE role = 'user' GROUP BY 1) SELECT mode, CAST(coalesce(list_min(list_filter(range(1, least(length(a), length(z)) + 1), lambda i: a[i] <> z[i])) - 1, least(length(a), length(z))) AS BIGINT) AS prefix FROM b")
def t23(t):
    b = t.usage_v.where("role = 'user'").groupBy("mode").agg(F.min("text").alias("a"), F.max("text").alias("z"))
    return b.select("mode", T.common_prefix(F.col("a"), F.col("z")).alias("prefix"))


@query("T24", "SELECT seq, round((tokens * CAST(0.05 AS DOUBLE) + (tokens // 2) * CAST(0.01 AS DOUBLE) + 100 * CAST(0.40 AS DOUBLE)) / 1000000, 9) AS cost FROM usage_v")
def t24(t):
    return t.usage_v.select("seq", F.round(T.cost(F.col("tokens"), F.floor(F.col("tokens") / 2), F.lit(100), C.PRICES["small"]), 9).alias("cost"))


@query("T27", "SELECT row_id, round(ln(greatest(least(y_prob, 1 - 1e-6), 1e-6) / (1 - greatest(least(y_prob, 1 - 1e-6), 1e-6))), 5) AS logit, CAST(sign(y_value - y_true) AS DOUBLE) AS s FROM pred_v")
def t27(t):
    return t.pred_v.select("row_id", F.round(T.log_odds(F.col("y_prob")), 5).alias("logit"), F.signum(F.col("y_value") - F.col("y_true")).alias("s"))


@query("T28", "SELECT id, round(CASE WHEN hi > lo THEN least(greatest((price - lo) / (hi - lo), 0), 1) ELSE 0 END, 6) AS scaled FROM pairs_v JOIN (SELECT g, quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi FROM pairs_v GROUP BY 1) USING (g)")
def t28(t):
    q = t.pairs_v.groupBy("g").agg(F.percentile("price", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    scaled = F.when(hi > lo, F.least(F.greatest((F.col("price") - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return t.pairs_v.join(q, "g").select("id", F.round(scaled, 6).alias("scaled"))


@query("T29", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'yes' WHEN event_id % 4 = 1 THEN 'no' END AS answer FROM events")
def t29(t):
    said = F.element_at(F.array(F.lit(" YES "), F.lit("n"), F.lit("maybe"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", T.yes_no(said).alias("answer"))


@query("T30", "SELECT row_id, 'split_' || split_id AS split FROM pred_v")
def t30(t):
    return t.pred_v.select("row_id", T.split_id_in(F.concat(F.lit("out/split_"), "split_id", F.lit("/recode.csv"))).alias("split"))


# ----- cohorts


@query("P01", "SELECT case_id, row_index, score, CAST(score >= 85 AS INT) AS high, relapse FROM cases_v WHERE score IS NOT NULL")
def p01(t):
    return t.cases_v.where("score IS NOT NULL").select("case_id", "row_index", "score", T.high_low(F.col("score")).alias("high"), "relapse")


@query("P02", "SELECT case_id, CASE WHEN score >= 85 THEN 1 WHEN score < 85 THEN 0 END AS high FROM cases_v")
def p02(t):
    return t.cases_v.select("case_id", T.high_low(F.col("score")).alias("high"))


@query("P03", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS x FROM events")
def p03(t):
    return t.events.select("event_id", T.number(F.when(F.col("event_id") % 5 == 0, "bad").when(F.col("event_id") % 5 == 9, "NaN").otherwise(F.col("event_id").cast("string"))).alias("x"))


@query("P04", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(event_id % 4 AS INT) END AS x FROM events")
def p04(t):
    return t.events.select("event_id", T.zero_one((F.col("event_id") % 4).cast("string")).alias("x"))


@query("P05", "SELECT row_id, CAST(y_true >= 85 AS INT) AS high, CAST(y_prob >= 0.5 AS INT) AS pred, y_bin AS relapse FROM pred_v WHERE role = 'test'")
def p05(t):
    return t.pred_v.where("role = 'test'").select("row_id", T.high_low(F.col("y_true")).alias("high"), (F.col("y_prob") >= 0.5).cast("int").alias("pred"), F.col("y_bin").alias("relapse"))


@query("P06", f"SELECT case_id, {MISSING_A} AS a, {MISSING_B} AS b FROM cases_v")
def p06(t):
    return t.cases_v.select("case_id", T.is_missing(F.col("text_a"), "a").alias("a"), T.is_missing(F.col("text_a"), "b").alias("b"))


@query("P07", f"SELECT case_id, mode, NOT (mode <> 'b' AND {MISSING_B}) AS usable FROM cases_v, (VALUES ('a'), ('b'), ('both')) m(mode)")
def p07(t):
    modes = F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("both"))).alias("mode")
    return t.cases_v.select("case_id", modes, T.is_missing(F.col("text_a")).alias("m")).select("case_id", "mode", (~((F.col("mode") != "b") & F.col("m"))).alias("usable"))


@query("P08", f"SELECT source, count(*) AS before, count(*) FILTER ({MISSING_B}) AS skipped, count(*) FILTER (NOT {MISSING_B}) AS after FROM cases_v GROUP BY 1")
def p08(t):
    m = T.is_missing(F.col("text_a"))
    return t.cases_v.groupBy("source").agg(F.count("*").alias("before"), F.count_if(m).alias("skipped"), F.count_if(~m).alias("after"))


@query("P09", f"SELECT count(*) AS n, count(*) FILTER (NOT {MISSING_B}) AS n_a, count(*) FILTER (text_b <> '') AS n_b, count(*) FILTER (NOT {MISSING_B} AND text_b <> '') AS n_both FROM cases_v")
def p09(t):
    a, b = ~T.is_missing(F.col("text_a")), ~T.is_missing(F.col("text_b"))
    return t.cases_v.agg(F.count("*").alias("n"), F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("n_both"))


@query("P10", f"SELECT row_index, NOT {MISSING_B} AS usable FROM cases_v WHERE row_index % 20 = 0")
def p10(t):
    """Usable reports looked up by row, here for every row whose number 20 divides."""
    wanted = t.documents.where("doc_id % 20 = 0").select(F.col("doc_id").alias("row_index"))
    return t.cases_v.join(wanted, "row_index", "left_semi").select("row_index", (~T.is_missing(F.col("text_a"))).alias("usable"))


CONFIGS = "(VALUES ('s1', 'a', [1, 2, 3, 4]), ('s1', 'b', [1, 2, 3, 4]), ('s2', 'a', [5, 7, 9, 11])) k(shots, tier, rows)"


def _configs(t):
    return t.spark.createDataFrame([("s1", "a", [1, 2, 3, 4]), ("s1", "b", [1, 2, 3, 4]), ("s2", "a", [5, 7, 9, 11])], "shots string, tier string, rows array<long>")


@query("P11", f"SELECT shots, tier, count(*) AS n, CAST(sum(row_index) AS BIGINT) AS s FROM cases_v, {CONFIGS} WHERE NOT list_contains(rows, row_index) AND NOT (tier = 'a' AND {MISSING_B}) GROUP BY 1, 2")
def p11(t):
    cases = t.cases_v.select("row_index", T.is_missing(F.col("text_a")).alias("m"))
    got = cases.crossJoin(F.broadcast(_configs(t))).where(~F.array_contains("rows", F.col("row_index")) & ~((F.col("tier") == "a") & F.col("m")))
    return got.groupBy("shots", "tier").agg(F.count("*").alias("n"), F.sum("row_index").alias("s"))


@query("P12", f"SELECT shots, tier, len(list_distinct(rows)) = 4 AND list_min(rows) >= 0 AND list_max(rows) < (SELECT count(*) FROM cases_v) AS valid FROM {CONFIGS}")
def p12(t):
    n = t.cases_v.agg(F.count("*").alias("n"))
    return _configs(t).crossJoin(F.broadcast(n)).select("shots", "tier", ((F.size(F.array_distinct("rows")) == 4) & (F.array_min("rows") >= 0) & (F.array_max("rows") < F.col("n"))).alias("valid"))


@query("P14", "SELECT row_id, y_true AS target, y_prob AS x1, CAST(site AS DOUBLE) AS x2 FROM pred_v WHERE y_true IS NOT NULL AND role = 'train'")
def p14(t):
    return t.pred_v.where("y_true IS NOT NULL AND role = 'train'").select("row_id", F.col("y_true").alias("target"), F.col("y_prob").alias("x1"), F.col("site").cast("double").alias("x2"))


@query("P15", "SELECT case_id, CASE WHEN count(*) = 0 THEN 'empty' WHEN max(y_bin) = min(y_bin) THEN 'one class' WHEN least(sum(y_bin), count(*) - sum(y_bin)) < 2 THEN 'rare class' ELSE 'fit' END AS status FROM pred_v GROUP BY 1")
def p15(t):
    rare = F.least(F.sum("y_bin"), F.count("*") - F.sum("y_bin"))
    return t.pred_v.groupBy("case_id").agg(F.when(F.count("*") == 0, "empty").when(F.max("y_bin") == F.min("y_bin"), "one class").when(rare < 2, "rare class").otherwise("fit").alias("status"))


@query("P16", "SELECT feature, n, n_nonzero, n_values, n >= 2 AND n_nonzero >= 1 AND n_values >= 2 AS kept FROM (SELECT l_returnflag || l_suppkey % 100 AS feature, count(l_quantity) AS n, count(*) FILTER (l_discount <> 0) AS n_nonzero, count(DISTINCT l_discount) AS n_values FROM lineitem GROUP BY 1)")
def p16(t):
    got = t.lineitem.groupBy(F.concat("l_returnflag", F.col("l_suppkey") % 100).alias("feature")).agg(F.count("l_quantity").alias("n"), F.count_if(F.col("l_discount") != 0).alias("n_nonzero"), F.count_distinct("l_discount").alias("n_values"))
    return got.withColumn("kept", (F.col("n") >= 2) & (F.col("n_nonzero") >= 1) & (F.col("n_values") >= 2))


@query("P17", "SELECT p_brand, p_type, count(*) AS support FROM part GROUP BY 1, 2 HAVING count(*) >= 5 AND max(p_size) > min(p_size)")
def p17(t):
    got = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("support"), F.max("p_size").alias("hi"), F.min("p_size").alias("lo"))
    return got.where("support >= 5 AND hi > lo").drop("hi", "lo")


@query("P19", "SELECT row_index, coalesce(CASE WHEN row_index % 2 = 0 THEN relapse END, CASE WHEN row_index % 3 = 0 THEN relapse END, -1) AS label FROM cases_v")
def p19(t):
    return t.cases_v.select("row_index", F.coalesce(F.when(F.col("row_index") % 2 == 0, F.col("relapse")), F.when(F.col("row_index") % 3 == 0, F.col("relapse")), F.lit(-1)).alias("label"))


@query("P20", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label FROM orders")
def p20(t):
    said = F.when(F.col("o_orderstatus") == "F", " High").when(F.col("o_orderstatus") == "O", "0.0").otherwise("?")
    return t.orders.select("o_orderkey", T.parse_label(said).alias("label"))


@query("P21", "SELECT run_id, modality, target, CASE lower(raw_metric) WHEN 'auroc' THEN 'roc_auc' WHEN 'mae' THEN 'mean_absolute_error' ELSE lower(raw_metric) END AS metric, value FROM metric_v")
def p21(t):
    alias = F.create_map(F.lit("auroc"), F.lit("roc_auc"), F.lit("mae"), F.lit("mean_absolute_error"))
    name = F.lower("raw_metric")
    return t.metric_v.select("run_id", "modality", "target", F.coalesce(F.try_element_at(alias, name), name).alias("metric"), "value")


@query("P23", "SELECT DISTINCT model_key, target FROM pred_v, (VALUES ('score', false), ('relapse', true), ('high', true)) s(target, binary_) WHERE (split_part(model_key, '-', 1) IN ('1', '2')) = binary_")
def p23(t):
    spec = t.spark.createDataFrame([("score", False), ("relapse", True), ("high", True)], "target string, binary_ boolean")
    models = t.pred_v.select("model_key").distinct().withColumn("binary_", F.split("model_key", "-")[0].isin("1", "2"))
    return models.join(F.broadcast(spec), "binary_").select("model_key", "target")


@query("P24", "SELECT feature, CASE WHEN starts_with(feature, 'grp__') THEN 'group' WHEN starts_with(feature, 'phr__') THEN 'phrase' ELSE 'weighted' END AS kind, round(prevalence, 6) AS prevalence, CASE WHEN c > 1e-8 THEN 'positive' WHEN c < -1e-8 THEN 'negative' ELSE 'zero' END AS sign FROM (SELECT (['grp__', 'phr__', 'wgrp__'])[1 + p_partkey % 3] || p_brand AS feature, avg(CAST(p_size > 25 AS INT)) AS prevalence, avg(p_size) - 25 AS c FROM part GROUP BY 1)")
def p24(t):
    name = F.concat(F.element_at(F.array(F.lit("grp__"), F.lit("phr__"), F.lit("wgrp__")), (F.col("p_partkey") % 3 + 1).cast("int")), "p_brand")
    got = t.part.groupBy(name.alias("feature")).agg(F.round(F.avg((F.col("p_size") > 25).cast("int")), 6).alias("prevalence"), (F.avg("p_size") - 25).alias("c"))
    kind = F.when(F.startswith("feature", F.lit("grp__")), "group").when(F.startswith("feature", F.lit("phr__")), "phrase").otherwise("weighted")
    return got.select("feature", kind.alias("kind"), "prevalence", F.when(F.col("c") > 1e-8, "positive").when(F.col("c") < -1e-8, "negative").otherwise("zero").alias("sign"))


@query("P25", "SELECT DISTINCT p_type, CASE WHEN starts_with(p_type, 'PROMO') THEN 'promo' ELSE 'other' END || ': ' || replace(lower(p_type), ' ', '_') AS label FROM part")
def p25(t):
    return t.part.select("p_type", F.concat(F.when(F.startswith("p_type", F.lit("PROMO")), "promo").otherwise("other"), F.lit(": "), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))).alias("label")).distinct()


@query("P26", f"SELECT coalesce(CASE WHEN row_index % 4 <> 0 THEN case_id END, 'row_' || row_index) AS case_id, row_index, {MISSING_B} AS a_missing, text_b <> '' AS b_usable FROM cases_v")
def p26(t):
    return t.cases_v.select(F.coalesce(F.when(F.col("row_index") % 4 != 0, F.col("case_id")), F.concat(F.lit("row_"), "row_index")).alias("case_id"), "row_index", T.is_missing(F.col("text_a")).alias("a_missing"), (~T.is_missing(F.col("text_b"))).alias("b_usable"))


@query("P27", "SELECT case_id, mode, md5(CASE mode WHEN 'a' THEN text_a WHEN 'b' THEN text_b ELSE text_a || chr(10) || text_b END) AS h FROM cases_v, (VALUES ('a'), ('b'), ('both')) m(mode)")
def p27(t):
    text = F.when(F.col("mode") == "a", F.col("text_a")).when(F.col("mode") == "b", F.col("text_b")).otherwise(F.concat_ws("\n", "text_a", "text_b"))
    return t.cases_v.withColumn("mode", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("both")))).select("case_id", "mode", F.md5(text).alias("h"))


@query("P29", "SELECT case_id, CASE WHEN y_bin = 1 THEN 1 ELSE 0 END AS label, round(avg(y_prob), 6) AS value FROM pred_v WHERE role = 'test' GROUP BY 1, 2")
def p29(t):
    said = F.when(F.col("y_bin") == 1, "yes").otherwise("no")
    return t.pred_v.where("role = 'test'").groupBy("case_id", T.parse_label(said).alias("label")).agg(F.round(F.avg("y_prob"), 6).alias("value"))


@query("P30", "SELECT event_id, CAST(round(value) AS INT) AS v FROM events")
def p30(t):
    return t.events.select("event_id", F.round(F.col("value").cast("string").try_cast("double")).cast("int").alias("v"))


@query("P31", f"SELECT row_index, tier, CASE WHEN list_contains(rows, row_index) THEN 'exemplar' ELSE 'text missing' END AS reason FROM cases_v, {CONFIGS} WHERE shots = 's1' AND (list_contains(rows, row_index) OR (tier = 'a' AND {MISSING_B}))")
def p31(t):
    cases = t.cases_v.select("row_index", T.is_missing(F.col("text_a")).alias("m"))
    shot = F.array_contains("rows", F.col("row_index"))
    got = cases.crossJoin(F.broadcast(_configs(t).where("shots = 's1'"))).where(shot | ((F.col("tier") == "a") & F.col("m")))
    return got.select("row_index", "tier", F.when(shot, "exemplar").otherwise("text missing").alias("reason"))


@query("P33", "SELECT row_index, coalesce(y_prob, -1) AS y_prob FROM (SELECT row_index FROM cases_v) LEFT JOIN (SELECT row_id, y_prob FROM pred_v) ON row_id = row_index")
def p33(t):
    return t.cases_v.select("row_index").join(t.pred_v.select(F.col("row_id").alias("row_index"), "y_prob"), "row_index", "left").select("row_index", F.coalesce("y_prob", F.lit(-1.0)).alias("y_prob"))


@query("P34", "SELECT run_id, value FROM metric_v QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY CASE raw_metric WHEN 'n' THEN 0 WHEN 'mae' THEN 1 ELSE 2 END, value DESC) = 1")
def p34(t):
    order = F.when(F.col("raw_metric") == "n", 0).when(F.col("raw_metric") == "mae", 1).otherwise(2)
    return t.metric_v.groupBy("run_id").agg(F.min(F.struct(order.alias("o"), (-F.col("value")).alias("v"))).alias("b")).select("run_id", (-F.col("b.v")).alias("value"))
