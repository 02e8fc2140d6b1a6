"""Language identification by interpolated Kneser-Ney character models.

For each language the n-grams of its training texts are counted in Spark.  The model keeps,
for every order, one sorted array of n-gram hashes over all languages and the log-probability
of each n-gram in each language, with backing-off already worked in; contexts have their own
arrays of interpolation weights for n-grams that no language has seen.  A text gets the
language of least cross-entropy per character.

The models are fitted on all rows of a language, or, beyond TRAIN_ROWS, on a uniform sample of
about that many, drawn by a hash; this bounds what the driver holds and broadcasts.  Of the
sampled rows all n-grams count.  Limits of rejection come from labelled rows that no model saw.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import Scratch, broadcast_upto
from .bpe import code_points

ORDER = 4
MAX_LANGUAGES = 500
TRAIN_ROWS = 200_000
CALIBRATE_ONE_IN = 8
REJECTED_SHARE = 0.001
SHARPNESS = 5.0
U64 = np.uint64


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Each code point's lower-case letter, or 0 for what isn't a letter."""
    table = np.zeros(sys.maxunicode + 1, np.int32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of all rows; a row is led by 32, and each run of other characters is one 32."""
    points, at = code_points(data)
    rows = len(offsets) - 1
    edge = np.searchsorted(at, offsets)
    stream = np.insert(folding()[points], edge[:-1], 0)
    whose = np.repeat(np.arange(rows), np.diff(edge) + 1)
    keep = np.ones(len(stream), bool)
    keep[1:] = (stream[1:] != 0) | (stream[:-1] != 0) | (whose[1:] != whose[:-1])
    stream, whose = np.where(stream == 0, 32, stream)[keep], whose[keep]
    return stream.astype(np.int64), np.searchsorted(whose, np.arange(rows + 1))


def gram_hashes(chars: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie within a row, and the positions of their last characters."""
    if len(chars) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    last = np.arange(n - 1, len(chars))
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = own[last] == own[last - n + 1]
    return _hash(chars, n)[inside], last[inside]


def _hash(chars: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(chars) - n + 1, n, U64)
    for k in range(n):
        out = out * U64(0x100000001B3) + chars[k : len(chars) - n + 1 + k].astype(U64) * U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(31)
    return _text.mix64(out)


def ngram_counts(docs: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, n over whole texts, added up per batch before the shuffle."""

    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.utf8(batch.column(1))
            names = batch.column(0).to_pylist()
            index = {x: k for k, x in enumerate(dict.fromkeys(names))}
            code = np.array([index[x] for x in names], np.int64)
            total: dict[tuple[int, bytes], int] = {}
            for i, j in _text.chunks(offsets):
                chars, edge = letters(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes, last = gram_hashes(chars, edge, order)
                whose = code[i:j][np.searchsorted(edge, last, "right") - 1]
                key = _text.mix64(hashes + whose.astype(U64) * U64(0x9E3779B97F4A7C15))
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                grams = np.stack([chars[last[first] - order + 1 + k] for k in range(order)], 1).astype("<u4")
                for w, g, c in zip(whose[first].tolist(), grams, n.tolist(), strict=True):
                    k = (w, g.tobytes())
                    total[k] = total.get(k, 0) + c
            back = list(index)
            yield pa.RecordBatch.from_arrays([pa.array([back[w] for w, _ in total], pa.string()), pa.array([g for _, g in total], pa.binary()), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])

    parts = docs.select(F.col(lang).cast("string").alias("lang"), text).where(F.col("lang").isNotNull()).mapInArrow(run, "lang string, gram binary, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Models of all languages over one set of n-grams."""

    def __init__(self, langs: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray, order: int = ORDER):
        """lang: index per row; grams: code points, rows x order; counts: per row."""
        self.langs, self.order = langs, order
        size = len(langs)
        n_chars = len(np.unique(grams)) + 1 if len(grams) else 1
        self.floor = -math.log(n_chars)
        tables = []  # highest order first: grams, lang, count (continuation counts below the highest)
        g, which, c = grams, lang, counts.astype(np.float64)
        for n in range(order, 0, -1):
            tables.append((g, which, c))
            if n > 1:
                rows = np.concatenate([which[:, None], g[:, 1:]], 1)
                uniq, number = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
                which, g = uniq[:, 0], uniq[:, 1:]
                c = np.bincount(number.ravel(), minlength=len(uniq)).astype(np.float64)
        self.hashes: dict[int, np.ndarray] = {}
        self.logp: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.weights: dict[int, np.ndarray] = {}
        lower = None  # probabilities of the next lower order, by table
        for n, (g, which, c) in zip(range(1, order + 1), reversed(tables), strict=True):
            ones, twos = np.bincount(which, c == 1, size), np.bincount(which, c == 2, size)
            discount = np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
            discount = np.clip(discount, 0.1, 0.9)
            ctx_rows = np.concatenate([which[:, None], g[:, :-1]], 1)
            ctx, of = np.unique(ctx_rows, axis=0, return_inverse=True) if len(g) else (ctx_rows, np.zeros(0, np.int64))
            of = of.ravel()
            total, kinds = np.bincount(of, c, len(ctx)), np.bincount(of, minlength=len(ctx))
            ctx_hash = self._hash(ctx[:, 1:], n - 1)
            self.contexts[n] = np.unique(ctx_hash)
            weight = np.zeros((len(self.contexts[n]), size))  # log of what a context gives to the lower order; 0 if unseen
            weight[np.searchsorted(self.contexts[n], ctx_hash), ctx[:, 0]] = np.log(discount[ctx[:, 0]] * kinds / np.maximum(total, 1e-300))
            self.weights[n] = weight
            h = self._hash(g, n)
            keys, first = np.unique(h, return_index=True)
            some = g[first]
            own = np.zeros((len(keys), size))
            own[np.searchsorted(keys, h), which] = np.maximum(c - discount[which], 0) / np.maximum(total[of], 1e-300)
            at, known = self._find(self.contexts[n], self._hash(some[:, :-1], n - 1))
            back = np.where(known[:, None], np.exp(weight[at]), 1.0)
            base = np.exp(self.floor) if lower is None else np.exp(self._lookup(n - 1, some[:, 1:]))
            self.hashes[n], self.logp[n] = keys, np.log(np.maximum(own + back * base, 1e-30))
            lower = n
        self.logp = {n: x.astype(np.float32) for n, x in self.logp.items()}
        self.weights = {n: x.astype(np.float32) for n, x in self.weights.items()}

    @staticmethod
    def _hash(grams: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.zeros(len(grams), U64)
        out = np.full(len(grams), n, U64)
        for k in range(n):
            out = out * U64(0x100000001B3) + grams[:, k].astype(U64) * U64(0x9E3779B97F4A7C15)
            out ^= out >> U64(31)
        return _text.mix64(out)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _lookup(self, n: int, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities of n-grams given as code points, backing off where unseen."""
        if n == 0:
            return np.full((len(grams), len(self.langs)), self.floor)
        at, known = self._find(self.hashes[n], self._hash(grams, n))
        out = self.logp[n][at].astype(np.float64) if len(self.hashes[n]) else np.zeros((len(grams), len(self.langs)))
        miss = np.flatnonzero(~known)
        if len(miss):
            at, known = self._find(self.contexts[n], self._hash(grams[miss, :-1], n - 1))
            gap = np.where(known[:, None], self.weights[n][at], 0.0) if len(self.contexts[n]) else 0.0
            out[miss] = gap + self._lookup(n - 1, grams[miss, 1:])
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (rows x languages) and number of letters of each row."""
        chars, edge = letters(data, offsets)
        n = self.order
        rows = len(edge) - 1
        out = np.zeros((rows, len(self.langs)))
        seen = np.zeros(rows, np.int64)
        is_letter = np.append(0, np.cumsum(chars != 32))
        n_letters = np.diff(is_letter[edge])
        hashes, last = gram_hashes(chars, edge, n)
        if len(last):
            # a gram recurs many times in a chunk: look up each one once
            uniq, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            grams = np.stack([chars[last[first] - n + 1 + k] for k in range(n)], 1)
            score = self._lookup(n, grams)
            begin = np.searchsorted(last, edge)
            full = np.flatnonzero(np.diff(begin) > 0)
            out[full] = np.add.reduceat(score[back], begin[:-1][full], axis=0)
            seen = np.diff(begin)
        short = np.flatnonzero((seen == 0) & (n_letters > 0))
        for r in short.tolist():  # fewer characters than the order
            text = chars[edge[r] : edge[r + 1]]
            m = min(len(text), n - 1)
            out[r], seen[r] = self._lookup(m, text[-m:][None, :])[0], 1
        return -out / np.maximum(seen, 1)[:, None], n_letters


def train(docs: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> KneserNey:
    """Models from all n-grams of at most about `rows` texts a language; the driver holds grams x languages numbers."""
    docs = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("lang IS NOT NULL")
    many = docs.groupBy("lang").count().where(F.col("count") > rows).collect()
    draw = F.pmod(F.xxhash64("text", F.lit("train")), F.lit(1 << 30)) / F.lit(1 << 30)
    for r in many:  # languages with more
        docs = docs.where((F.col("lang") != r["lang"]) | (draw < rows / r["count"]))
    top = ngram_counts(docs, order).toPandas()
    langs = sorted(top.lang.unique())
    grams = np.frombuffer(b"".join(map(bytes, top.gram)), "<u4").reshape(-1, order).astype(np.int64)
    index = {x: k for k, x in enumerate(langs)}
    return KneserNey(langs, top.lang.map(index).to_numpy(np.int64) if len(top) else np.zeros(0, np.int64), grams, top.n.to_numpy(np.int64) if len(top) else np.zeros(0, np.int64), order)


def identify(docs: DataFrame, model: KneserNey, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score, entropy.

    score is the share of the best language in the softmax of the languages' log-likelihoods of
    SHARPNESS characters.  lang_pred is `und` and score 0 for texts without a letter, and if no
    language was learned; of languages that tie the first by name is taken.  Very long texts are
    scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the n-grams of TRAIN_ROWS texts a language

    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = _text.utf8(batch.column(1))
            names, scores, least = [], [], []
            for i, j in _text.chunks(offsets):
                entropy, n = own.entropies(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not own.langs:
                    names += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    least += [None] * (j - i)
                    continue
                best = entropy.argmin(1)
                low = entropy.min(1)
                p = 1 / np.exp(-SHARPNESS * (entropy - low[:, None])).sum(1)
                for k, b, s, h in zip(n.tolist(), best.tolist(), p.tolist(), low.tolist(), strict=True):
                    names.append(own.langs[b] if k else "und")
                    scores.append(s if k else 0.0)
                    least.append(h if k else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(least, pa.float64())], names=[key, "lang_pred", "score", "entropy"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, entropy double")


def detect(docs: DataFrame, order: int = ORDER, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """Predictions for all rows, learned from rows with crc32(key) mod 3 other than 1.

    Adds held_out and rejected, which marks texts whose cross-entropy exceeds that of all but
    REJECTED_SHARE of the labelled texts predicted alike that were put aside for this, one in
    CALIBRATE_ONE_IN.  Null texts are predicted `und` and teach nothing; null languages teach
    nothing; rows without a key are learned from; repeated rows count each; an empty table gives
    an empty table; columns other than these three aren't read, whatever their names.
    """
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    fold = F.pmod(F.crc32(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), F.lit(3))
    aside = F.pmod(F.xxhash64("text", F.lit("calibrate")), F.lit(CALIBRATE_ONE_IN)) == 0
    labelled = (fold != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    model = train(own.where(labelled & ~aside), order, rows=rows)
    flagged = own.select(F.struct("key", fold.alias("fold"), (labelled & aside).alias("aside")).alias("about"), "text")
    scored = Scratch(docs.sparkSession).write(identify(flagged, model, "about").select("about.*", "lang_pred", "score", "entropy"))
    limits = scored.where("aside AND entropy IS NOT NULL").groupBy("lang_pred").agg(F.percentile_approx("entropy", 1 - REJECTED_SHARE, 10_000).alias("limit"))
    out = scored.join(broadcast_upto(limits, MAX_LANGUAGES), "lang_pred", "left")
    return out.select(F.col("key").alias(key), (F.col("fold") == 1).alias("held_out"), "lang_pred", "score", "entropy", F.coalesce(F.col("entropy") > F.col("limit"), F.lit(False)).alias("rejected"))
