"""Text, regex, hash and JSON expressions; all run inside Spark's own operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: White space as Unicode and Python see it; Java's own classes lack the separators 1C-1F.
WS = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def safe_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column, space: str = WS) -> Column:
    """White space collapsed to one blank and stripped."""
    return F.trim(F.regexp_replace(safe_text(c), space, " "))


def normalize_text(c: Column) -> Column:
    """Lower case with white space collapsed."""
    return squeeze(F.lower(safe_text(c)))


def normalize_ascii(c: Column) -> Column:
    """Lower case, only a-z, 0-9, white space, - and / kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(safe_text(c)), r"[^a-z0-9\s\-/]", " "), r"\s+", " "))


def slug(c: Column, most: int = 120) -> Column:
    plain = F.regexp_replace(F.regexp_replace(normalize_text(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(plain == "", "empty").otherwise(F.substring(plain, 1, most))


def slug_key(c: Column) -> Column:
    """A slug with a hash of the normalised text, so that folding and cutting don't make texts collide."""
    return F.concat(slug(c), F.lit("#"), F.substring(F.sha2(normalize_text(c), 256), 1, 12))


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def negated(c: Column) -> Column:
    return F.lower(safe_text(c)).rlike(any_of(C.NEGATION))


def uncertain(c: Column) -> Column:
    return F.lower(safe_text(c)).rlike(any_of(C.UNCERTAINTY))


def words(c: Column) -> Column:
    return F.filter(F.split(safe_text(c), WS), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def is_missing(c: Column, rule: str = "b") -> Column:
    """Whether a text is null, blank or a placeholder of rule a or b."""
    plain = F.lower(F.regexp_replace(safe_text(c), f"^{WS}|{WS}$", ""))
    return (plain == "") | plain.isin(C.MISSING_A if rule == "a" else C.MISSING_B)


def straighten(c: Column) -> Column:
    """Curly quotes, long dashes and hard blanks as plain ones, lower-cased; compatibility folding is a UDF."""
    return squeeze(F.lower(F.translate(safe_text(c), "‘’“”–— ", "''\"\"-- ")))


def quote_in(report: Column, quote: Column) -> Column:
    """Whether the report has the quote, as it is or with both straightened; a blank quote is in none."""
    found = F.contains(F.lower(safe_text(report)), F.lower(safe_text(quote))) | F.contains(straighten(report), straighten(quote))
    return found & (F.trim(safe_text(quote)) != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(safe_text(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def evidence_tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_ascii(c), " "), lambda w: (F.length(w) >= 3) & ~w.isin(C.STOPWORDS))


def bound(c: Column, of) -> Column:
    """of(c), where c is worked out once however often `of` names it."""
    return F.element_at(F.transform(F.array(c), of), 1)


def uni_and_bigrams(tokens: Column) -> Column:
    """Distinct tokens and neighbouring pairs."""
    return bound(tokens, lambda w: F.array_distinct(F.concat(w, neighbours(w))))


def neighbours(w: Column) -> Column:
    """Pairs of neighbouring tokens, joined by a blank."""
    less = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), less), F.slice(w, F.lit(2), less), lambda a, b: F.concat(a, F.lit(" "), b))


def flags(c: Column, patterns: dict[str, str]) -> dict[str, Column]:
    plain = normalize_text(c)
    return {k: plain.rlike(p).cast("int") for k, p in patterns.items()}


def sections(c: Column) -> Column:
    """Sections of a text: parts between blank lines, stripped, without empty ones."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(safe_text(c), "\r\n", "\n"), "\r", "\n"), "[ \t]+\n", "\n")
    return F.filter(F.transform(F.split(plain, "\n[ \t]*\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def header(section: Column) -> Column:
    """The first line up to a colon, a spaced dash or a tab, upper-cased; null if longer than 80."""
    head = F.trim(F.substring_index(F.substring_index(section, "\n", 1), ":", 1))
    head = F.trim(F.substring_index(F.substring_index(head, " - ", 1), "\t", 1))
    head = F.upper(F.regexp_replace(head, r"[\s.,;]+$", ""))
    return F.when((F.length(head) > 0) & (F.length(head) <= 80), head)


def trim_sections(c: Column, prefixes: list[str]) -> Column:
    """The text without sections whose header begins with one of the prefixes."""
    drop = lambda s: F.exists(F.array(*(F.lit(p) for p in prefixes)), lambda p: F.coalesce(F.startswith(header(s), p), F.lit(False)))
    return F.array_join(F.filter(sections(c), lambda s: ~drop(s)), "\n\n")


def side(c: Column) -> Column:
    plain = F.lower(F.trim(safe_text(c)))
    return F.when(plain.isin("left", "right"), plain).otherwise("unknown")


def case_token(*parts: Column) -> Column:
    """Ten upper-case hex digits that name a case."""
    return F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 10))


def list_hash(items: Column) -> Column:
    """Hash of an ordered list of names."""
    return F.substring(F.sha2(F.array_join(items, "\n"), 256), 1, 16)


def set_hash(items: Column) -> Column:
    return F.substring(F.sha1(F.array_join(F.sort_array(items), "|")), 1, 16)


def json_in_text(c: Column) -> Column:
    """The JSON object in a text: the text itself, or what a code fence holds, or the widest braces; null if none parses."""
    fenced = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    ok = lambda x: F.when(F.get_json_object(x, "$").isNotNull() & F.startswith(F.trim(x), F.lit("{")), x)
    return F.coalesce(ok(c), ok(fenced), ok(braces))


def concept_list(c: Column) -> Column:
    """Slugs of a list written with commas, semicolons or bars."""
    return F.transform(F.filter(F.split(safe_text(c), "[,;|]"), lambda x: F.trim(x) != ""), lambda x: slug(x))


def infer_concepts(raw: Column, quote: Column, candidates: Column) -> Column:
    """Known candidates first, then concepts with a matching pattern in their fixed order, or the default."""
    text = normalize_text(F.concat_ws(" || ", safe_text(raw), safe_text(quote)))
    known = F.filter(candidates, lambda x: x.isin(*C.ONTOLOGY))
    found = F.array_compact(F.array(*(F.when(text.rlike(any_of(p)), k) for k, (_, p) in C.ONTOLOGY.items())))
    all_ = F.array_distinct(F.concat(known, found))
    return F.when(F.size(all_) > 0, all_).otherwise(F.array(F.lit(C.DEFAULT_CONCEPT)))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(safe_text(c), r"[^A-Za-z0-9._-]+", "_")


def tokens_by_chars(c: Column) -> Column:
    return F.ceil(F.length(safe_text(c)) / 4).cast("long")


def tokens_rough(c: Column) -> Column:
    plain = F.size(F.filter(F.split(safe_text(c), r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(F.greatest(F.length(safe_text(c)) / 4, plain * 1.33))).cast("long")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)), i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(same) - 1, n)).cast("long")


def cost(fresh: Column, cached: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    return (fresh * prices[0] + cached * prices[1] + output * prices[2]) / 1_000_000


def log_odds(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def number(c: Column) -> Column:
    """A double, null where the text is none or isn't finite."""
    x = F.expr("1") * 0 + c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def zero_one(c: Column) -> Column:
    x = number(c)
    return F.when(x.isin(0.0, 1.0), x.cast("int"))


def high_low(c: Column, least: float = C.HIGH_SCORE) -> Column:
    x = number(c)
    return F.when(x >= least, 1).when(x < least, 0)


def parse_label(c: Column) -> Column:
    x = F.lower(F.trim(safe_text(c)))
    return F.when(x.isin("1", "1.0", "high", "yes", "true", "y"), 1).when(x.isin("0", "0.0", "low", "no", "false", "n"), 0)


def yes_no(c: Column) -> Column:
    x = F.lower(F.trim(safe_text(c)))
    return F.when(x.isin("y", "yes"), "yes").when(x.isin("n", "no"), "no")


def split_id_in(c: Column) -> Column:
    found = F.regexp_extract(c, r"(split_[0-9]+|rep[0-9]+_fold[0-9]+|mc_[0-9]+)", 1)
    return F.when(found != "", found)


def finite(c: Column) -> Column:
    """Non-finite numbers as null, as JSON needs it."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
