"""Quality rules whose cut-offs are learned from quantile sketches per language and source.

A sketch is a histogram over integer bins that keep eight significant bits, so sketches
merge by adding counts, in any order and with the same result, and a quantile is off by
less than one part in 128.  Small groups use the merged sketch of their language, then of all.

A fence lies SPREADS spreads and a fixed slack beyond a quartile.  The spread is that between the
quartiles, or, if larger, that from the median to the outer tenth, so that a fence also adapts to
features that most of a group's documents don't have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import Scratch, broadcast_upto, numbered, renamed

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines"]
WINDOW = 8
#: Feature: its numerator, scale and denominator, and the slack added to its fences.
FEATURES = {
    "word_length": ("word_chars", 100, "n_words", 100),
    "symbols": ("n_symbols", 1000, "n_words", 60),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 600),
    "repeats": ("n_repeat_words", 1000, "n_words", 100),
}
TWO_SIDED = {"word_length"}
SPREADS = 6
MIN_GROUP = 50
MAX_BROADCAST_ROWS = 200_000
NULL = "\0null"


def _set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SPACE, _SYMBOL = _set(b" \t\n\v\f\r"), _set(b"#*$%&|<>")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[offsets])


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each row of UTF-8 texts."""
    rows = len(offsets) - 1
    inside = ~_SPACE[data]
    starts, ends = _text.runs(inside, offsets)
    own = _text.owners(starts, offsets)
    out = {"n_words": np.bincount(own, minlength=rows).astype(np.int64), "word_chars": _per_row(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_row(_SYMBOL[data], offsets)}
    hasher = _text.Hasher(data)
    breaks = np.flatnonzero(data == 10)
    line = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1, [len(data)]])).astype(np.int64)
    line, stop = line[:-1], line[1:]
    stop = np.where(data[stop - 1] == 10, stop - 1, stop) if len(stop) else stop
    worded = np.diff(np.searchsorted(starts, np.append(line, len(data)))) > 0
    line, stop = line[worded], stop[worded]
    row = _text.owners(line, offsets)
    key = _text.mix64(hasher(line, stop) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(row, minlength=rows).astype(np.int64)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[first], minlength=rows)
    window = _text.windows(hasher(starts, ends), WINDOW)
    at = np.flatnonzero(own[: len(window)] == own[WINDOW - 1 :]) if len(window) else np.zeros(0, np.int64)
    key = _text.mix64(window[at] + own[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(starts) + WINDOW, np.int64)
    change[at[twice]] += 1
    change[at[twice] + WINDOW] -= 1
    covered = np.cumsum(change)[: len(starts)] > 0
    out["n_repeat_words"] = np.bincount(own[covered], minlength=rows).astype(np.int64)
    return out


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """All columns of the table and the counts of each whole text, as prefixed columns; no shuffle."""
    at = docs.columns.index(text)

    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(at))
            for i, j in _text.chunks(offsets):
                got = counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([c[i:j] if isinstance(c, pa.Array) else c.slice(i, j - i) for c in batch.columns] + [pa.array(got[c]) for c in COUNTS], names=[*batch.schema.names, *(prefix + c for c in COUNTS)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(prefix + c, T.LongType()) for c in COUNTS)]))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _feature(name: str, prefix: str) -> Column:
    over, scale, under, _ = FEATURES[name]
    return F.floor(F.lit(scale) * F.col(prefix + over) / F.greatest(F.col(prefix + under), F.lit(1))).cast("long")


def _bin(value: Column) -> Column:
    drop = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "__q_") -> DataFrame:
    """Fences per language and source from merged sketches: __lang, __source, low and high of each feature."""
    passed = counted.where(~base_failed(F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), _bin(_feature(f, prefix)).alias("bin")) for f in FEATURES))).alias("s")
    group = [F.coalesce(F.col(c).cast("string"), F.lit(NULL)).alias(f"__{k}") for c, k in ((lang, "lang"), (source, "source"))]
    sketch = passed.select(*group, pairs).groupBy("__lang", "__source", "s.feature", "s.bin").agg(F.count("*").alias("n"))
    levels = F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("__lang").alias("l"), F.col("__source").alias("s")), F.struct(F.lit(1).alias("level"), F.col("__lang").alias("l"), F.lit("").alias("s")), F.struct(F.lit(2).alias("level"), F.lit("").alias("l"), F.lit("").alias("s"))))
    merged = sketch.select(levels.alias("g"), "feature", "bin", "n").groupBy("g", "feature", "bin").agg(F.sum("n").alias("n"))
    key = Window.partitionBy("g", "feature")
    seen = merged.select("g", "feature", "bin", F.sum("n").over(key.orderBy("bin")).alias("upto"), F.sum("n").over(key).alias("total"))
    quantile = lambda k: F.min(F.when(100 * F.col("upto") >= k * F.col("total"), F.col("bin"))).alias(f"q{k}")
    q = seen.groupBy("g", "feature").agg(F.max("total").alias("total"), *(quantile(k) for k in (10, 25, 50, 75, 90)))
    middle = F.col("q75") - F.col("q25")
    slack = F.coalesce(*(F.when(F.col("feature") == f, F.lit(v[3])) for f, v in FEATURES.items()))
    two = F.col("feature").isin(*TWO_SIDED)
    fences = q.select("g", "feature", "total", F.when(two, F.col("q25") - SPREADS * F.greatest(middle, F.col("q50") - F.col("q10")) - slack).alias("low"), (F.col("q75") + SPREADS * F.greatest(middle, F.col("q90") - F.col("q50")) + slack).alias("high"))
    own = fences.where("g.level = 0").select(F.col("g.l").alias("l0"), F.col("g.s").alias("s0"), "feature", F.struct("total", "low", "high").alias("a"))
    lang_ = fences.where("g.level = 1").select(F.col("g.l").alias("l0"), "feature", F.struct("total", "low", "high").alias("b"))
    all_ = fences.where("g.level = 2").select("feature", F.struct("total", "low", "high").alias("c"))
    best = own.join(lang_, ["l0", "feature"]).join(all_, "feature").select("l0", "s0", "feature", F.when(F.col("a.total") >= MIN_GROUP, F.col("a")).when(F.col("b.total") >= MIN_GROUP, F.col("b")).otherwise(F.col("c")).alias("f"))
    pick = lambda f, side: F.max(F.when(F.col("feature") == f, F.col(f"f.{side}"))).alias(f"__{side}_{f}")
    return best.groupBy(F.col("l0").alias("__lang"), F.col("s0").alias("__source")).agg(*(pick(f, side) for f in FEATURES for side in ("low", "high")))


def judge(counted: DataFrame, fences: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "__q_") -> DataFrame:
    """counted with __base_failed and __kept."""
    on = [F.coalesce(F.col(lang).cast("string"), F.lit(NULL)) == F.col("__lang"), F.coalesce(F.col(source).cast("string"), F.lit(NULL)) == F.col("__source")]
    failed = base_failed(F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words"))
    odd = F.lit(False)
    for f in FEATURES:
        value = _feature(f, prefix)
        odd = odd | F.coalesce(value > F.col(f"__high_{f}"), F.lit(False)) | F.coalesce(value < F.col(f"__low_{f}"), F.lit(False))
    joined = counted.join(broadcast_upto(fences, MAX_BROADCAST_ROWS), on, "left")
    return joined.withColumns({"__base_failed": failed, "__kept": ~failed & ~odd}).drop(*(c for c in fences.columns))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: key, the counts of BASE, base_failed, kept.

    Null and empty texts have no words and fail; null languages and sources are groups of their
    own; rows without a key and repeated rows are judged each; a value equal to its fence passes;
    very long texts are counted whole; an empty table gives an empty table; other columns aren't
    read, whatever their names.  Only histogram counts are shuffled, partly added up before; the fences, one row
    per language and source, are broadcast up to MAX_BROADCAST_ROWS rows, else joined by shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.write(with_counts(docs.select(key, lang, source, text), text).drop(text))
    fences = scratch.write(thresholds(counted, lang, source))
    return judge(counted, fences, lang, source).select(key, *(F.col("__q_" + c).alias(c) for c in BASE), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that pass, with their own columns, of any names.  Texts are read twice and not shuffled."""
    scratch = Scratch(docs.sparkSession)
    own, names = numbered(docs)
    text, lang, source = names[text], names[lang], names[source]
    counted = scratch.write(with_counts(own.select(lang, source, text), text).drop(text))
    fences = scratch.write(thresholds(counted, lang, source))
    scratch.drop(counted)
    return judge(with_counts(own, text), fences, lang, source).where("__kept").select(*renamed(names))


def oracle() -> str:
    """The whole rule in SQL over the table documents."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    values = {f: f"CAST(floor({scale} * {a} / greatest({b}, 1)) AS BIGINT)" for f, (a, scale, b, _) in FEATURES.items()}
    odd = " OR ".join([f"coalesce({values[f]} > (SELECT max(high) FROM best t WHERE t.l = v.l AND t.s = v.s AND t.feature = '{f}'), false)" for f in FEATURES] + [f"coalesce({values[f]} < (SELECT max(low) FROM best t WHERE t.l = v.l AND t.s = v.s AND t.feature = '{f}'), false)" for f in TWO_SIDED])
    bins = " UNION ALL ".join(f"SELECT l, s, '{f}' AS feature, {e} AS x FROM counted WHERE NOT base_failed" for f, e in values.items())
    slack = "CASE feature " + " ".join(f"WHEN '{f}' THEN {v[3]}" for f, v in FEATURES.items()) + " END"
    quantiles = ", ".join(f"min(bin) FILTER (WHERE 100 * upto >= {k} * total) AS q{k}" for k in (10, 25, 50, 75, 90))
    two = "feature IN (" + ", ".join(f"'{f}'" for f in TWO_SIDED) + ")"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '{NULL[1:]}0') AS l, coalesce(source, '{NULL[1:]}0') AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{word}') AS words FROM d),
windows AS (SELECT r, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS x FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
twice AS (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT j) AS n FROM twice GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{word}') GROUP BY r),
counted AS (SELECT d.r, doc_id, l, s, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(lines.n, 0) AS n_lines, len(words) < 20 OR 100 * coalesce(repeats.n, 0) > 30 * len(words) AS base_failed
  FROM d JOIN w USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)),
x AS ({bins}),
b AS (SELECT l, s, feature, (x >> greatest(length(bin(x)) - 8, 0)) << greatest(length(bin(x)) - 8, 0) AS bin FROM x),
levels AS (SELECT 0 AS level, * FROM b UNION ALL SELECT 1, l, '', feature, bin FROM b UNION ALL SELECT 2, '', '', feature, bin FROM b),
upto AS (SELECT level, l, s, feature, bin, sum(n) OVER (PARTITION BY level, l, s, feature ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, l, s, feature) AS total FROM (SELECT level, l, s, feature, bin, count(*) AS n FROM levels GROUP BY ALL)),
q AS (SELECT level, l, s, feature, max(total) AS total, {quantiles} FROM upto GROUP BY ALL),
f AS (SELECT level, l, s, feature, total, CASE WHEN {two} THEN q25 - {SPREADS} * greatest(q75 - q25, q50 - q10) - {slack} END AS low, q75 + {SPREADS} * greatest(q75 - q25, q90 - q50) + {slack} AS high FROM q),
best AS (SELECT a.l, a.s, feature, CASE WHEN a.total >= {MIN_GROUP} THEN a.low WHEN b.total >= {MIN_GROUP} THEN b.low ELSE c.low END AS low, CASE WHEN a.total >= {MIN_GROUP} THEN a.high WHEN b.total >= {MIN_GROUP} THEN b.high ELSE c.high END AS high
  FROM (SELECT * FROM f WHERE level = 0) a JOIN (SELECT l, feature, total, low, high FROM f WHERE level = 1) b USING (l, feature) JOIN (SELECT feature, low, high FROM f WHERE level = 2) c USING (feature))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({odd}) AS kept FROM counted v
"""
