"""Near-duplicate documents by weighted Jaccard similarity of word shingles (BagMinHash).

A text is a bag of word 5-grams.  For every shingle a Poisson process over (time, weight
level) is defined by the shingle's hash; a bag sees the points whose level is at most the
shingle's count.  Levels are discretised to integers and grouped in a dyadic hierarchy
(0,1], (1,2], (2,4], ...; a block's points are drawn at the block's rate and placed among its
levels by the binary digits of a hash, so only blocks that a count reaches are drawn.  Each
point belongs to one signature component, whose value is the time of the first point; two
bags agree in a component with the probability of their weighted Jaccard similarity.  Points
later than the slowest component can't matter, which bounds the work per document.

Equal bags are one class.  Classes that agree in a band are candidates; links are decided by
the exact overlap of the bags.  Within a bucket all are compared with its most central member;
what is not connected then is compared with the bucket's members of other components, as far as
sketches of their symmetric difference allow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._components import components
from ._spark import Scratch, numbered, renamed
from ._text import U64, mix64

SHINGLE = 5
MAX_TURNS = 2
MISSED = 1e-5
PARITY_BITS = 2048
_GOLD = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Bands:
    """bands x rows signature components; at similarity 0.8 a pair misses all with probability 7e-5."""

    bands: int = 24
    rows: int = 5
    least: float = 0.8

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def fewest(self) -> int:
        """Components that a pair at the least similarity shares but with probability MISSED."""
        total, k = 0.0, 0
        while True:
            total += math.comb(self.size, k) * self.least**k * (1 - self.least) ** (self.size - k)
            if total > MISSED:
                return k
            k += 1


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def bags(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For row ranges of a text column: start, stop, and the shingles' row, key and count.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII,
    lower-cased; a text of one to four words is one shingle.
    """
    data, offsets = _text.utf8(pc.utf8_lower(column))
    for i, j in _text.chunks(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = _text.runs(_WORD[part], own)
        row = _text.owners(starts, own)
        word = _text.Hasher(part)(starts, ends) if len(starts) else np.zeros(0, U64)
        keys, whose = [], []
        window = _text.windows(word, SHINGLE)
        at = np.flatnonzero(row[: len(window)] == row[SHINGLE - 1 :]) if len(window) else np.zeros(0, np.int64)
        keys.append(window[at])
        whose.append(row[at])
        n = np.bincount(row, minlength=j - i)
        first = np.searchsorted(row, np.arange(j - i))
        for k in range(1, SHINGLE):
            short = np.flatnonzero(n == k)
            if len(short):
                at = first[short]
                keys.append(_text.windows(word, k)[at] ^ U64(k))
                whose.append(short)
        key, who = np.concatenate(keys), np.concatenate(whose)
        _, one, count = np.unique(mix64(key + who.astype(U64) * _GOLD), return_index=True, return_counts=True)
        yield i, j, who[one], key[one], count


def signatures(rows: int, row: np.ndarray, key: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Times of the first points, rows x size; infinite for empty bags."""
    out = np.full(rows * size, np.inf)
    total = np.bincount(row, count, minlength=rows)
    limit = np.where(total > 0, (math.log(size) + 4) * size / np.maximum(total, 1), 0.0)
    todo = total > 0
    while todo.any():
        mine = todo[row]
        _draw(out, limit, row[mine], key[mine], count[mine], size)
        worst = out.reshape(rows, size).max(1)
        todo &= np.isinf(worst)
        limit[todo] *= 2
        out.reshape(rows, size)[todo] = np.inf
    return out.reshape(rows, size)


def _draw(out: np.ndarray, limit: np.ndarray, row: np.ndarray, key: np.ndarray, count: np.ndarray, size: int) -> None:
    """Let all processes run until their row's limit, which falls to the row's slowest component."""
    who, seed, reach, below = [row], [mix64(key)], [count], [np.zeros(len(row), np.int64)]
    low = 1
    while (some := np.flatnonzero(count > low)).size:
        who.append(row[some])
        seed.append(mix64(key[some] ^ mix64(np.full(1, low, U64))))
        reach.append(count[some])
        below.append(np.full(len(some), low, np.int64))
        low *= 2
    row, seed, reach, below = (np.concatenate(x) for x in (who, seed, reach, below))
    limit = limit.copy()
    time = np.zeros(len(row))
    step, rounds = 0, 1
    while len(row):
        for _ in range(rounds):
            step += 1
            h = mix64(seed + U64(step * int(_GOLD) & (1 << 64) - 1))
            time = time - np.log(((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / np.maximum(below, 1)
            go = np.flatnonzero(time < limit[row])
            if len(go) < len(row):
                row, seed, reach, below, time, h = row[go], seed[go], reach[go], below[go], time[go], h[go]
            if not len(row):
                return
            h = mix64(h ^ U64(0xD6E8FEB86659FD93))
            part = ((h >> U64(32)) % U64(size)).astype(np.int64)
            level = below + 1 + ((h & U64(0xFFFFFFFF)) * np.maximum(below, 1).astype(U64) >> U64(32)).astype(np.int64)
            seen = np.flatnonzero(level <= reach) if below.any() else slice(None)
            np.minimum.at(out, row[seen] * size + part[seen], time[seen])
        slowest = out.reshape(-1, size)[row].max(1) if len(row) * size < 4_000_000 else None
        if slowest is not None:
            np.minimum.at(limit, row, slowest)
        rounds = min(rounds * 2, 64)


def _sign(bands: Bands):
    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, key, count in bags(batch.column(1)):
                n = j - i
                h1, h2, weight = np.zeros(n, U64), np.zeros(n, U64), np.bincount(row, count, minlength=n).astype(np.int64)
                np.add.at(h1, row, mix64(key) * count.astype(U64))
                np.add.at(h2, row, mix64(key ^ U64(0xA0761D6478BD642F)) * count.astype(U64))
                times = signatures(n, row, key, count, bands.size).view(U64).reshape(n * bands.bands, bands.rows)
                small = mix64(times.ravel()).astype(np.int8)  # a byte a component, for estimates
                brief = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands.size + 1, bands.size, dtype=np.int32)), pa.array(small))
                mark = np.zeros(n * bands.bands, U64)
                for k in range(bands.rows):
                    mark = mix64(mark * _GOLD + times[:, k])
                marks = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands.bands + 1, bands.bands, dtype=np.int32)), pa.array(mark.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(weight), marks, brief], names=["id", "t", "h1", "h2", "weight", "marks", "brief"])

    return run


def similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the bags of two text columns, row by row."""
    got = []
    for column in (a, b):
        keys, counts, rows, weight = [], [], [], np.zeros(len(column), np.int64)
        for i, j, row, key, count in bags(column):
            keys.append(mix64(key + (row + i).astype(U64) * _GOLD))
            rows.append(row + i)
            counts.append(count)
            weight[i:j] = np.bincount(row, count, minlength=j - i)
        got.append((np.concatenate(keys) if keys else np.zeros(0, U64), np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(counts) if counts else np.zeros(0, np.int64), weight))
    (ka, ra, ca, wa), (kb, _, cb, wb) = got
    _, x, y = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    common = np.bincount(ra[x], np.minimum(ca[x], cb[y]), minlength=len(a))
    return np.where(wa + wb > 0, common / np.maximum(wa + wb - common, 1), 0.0)


def _verify(least: float):
    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                good = pa.array(similarity(part.column(2), part.column(3)) >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])

    return run


@_text.released
def _lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the classes in a batch: key, a class that has it, its count there, and whether several here have it."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, _, row, key, count in bags(batch.column(1)):
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
            owner = ids[i + row[order]]
            several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(first) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ranked[first].view(np.int64)), pa.array(owner[first]), pa.array(count[order][first].astype(np.int64)), pa.array(several)], names=["key", "c", "n", "several"])


@_text.released
def _parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Odd sketches of bags: each occurrence of a shingle flips one of PARITY_BITS bits.

    Where two sketches differ in d bits, the bags differ in at least d occurrences.
    """
    for batch in batches:
        for i, j, row, key, count in bags(batch.column(1)):
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            h = mix64(np.repeat(mix64(key), count) + nth.astype(U64) * _GOLD)
            bit, times = np.unique(np.repeat(row, count) * PARITY_BITS + (h % U64(PARITY_BITS)).astype(np.int64), return_counts=True)
            bit = bit[times % 2 == 1]
            flags = np.zeros((j - i) * PARITY_BITS // 8, np.uint8)
            np.bitwise_or.at(flags, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
            size = PARITY_BITS // 64
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * size + 1, size, dtype=np.int32)), pa.array(flags.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], listed], names=["c", "parity"])


def near_copies(docs: DataFrame, bands: Bands = Bands(), key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """Per row: key, class_id, kept.

    class_id is the least key among the documents that links of similarity `least` or more
    reach; kept marks rows whose key it is.  Null texts and texts without a word link with
    nothing and are kept, as are rows without a key, whose class_id is null; equal texts are one
    class, also as repeated rows; a very long text is worked on by itself; ties of similarity or
    weight are decided by hashes, and never change the classes; an empty table gives an empty
    table; other columns aren't read, whatever their names.

    A bucket's members are first compared with its most central one, that with the least share
    of shingles which no other candidate has.  Those shingles also bound a pair's overlap.  While
    much is still apart, one odd member per bucket and turn is compared with all others, so that
    crowds of copies of copies join up; of the rest all pairs are compared whose signatures agree
    in `fewest` components, which a pair at the least similarity misses with probability 1e-5.
    In both, odd sketches rule out pairs that differ in more shingles than the similarity allows:
    a certain bound, which loses nothing.
    """
    scratch = Scratch(docs.sparkSession)
    whole = F.col(f"`{text}`")
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), whole.alias("text"), F.xxhash64(whole).alias("t"))
    signed = scratch.write(plain.mapInArrow(_sign(bands), "id long, t long, h1 long, h2 long, weight long, marks array<long>, brief array<tinyint>"))
    usable = (F.col("weight") > 0) & F.col("id").isNotNull()
    classes = scratch.write(signed.where(usable).groupBy("h1", "h2").agg(F.min(F.struct("id", "t")).alias("name"), F.first("weight").alias("weight"), F.first("marks").alias("marks"), F.first("brief").alias("brief")).withColumns({"t": F.col("name.t"), "name": F.col("name.id")}))
    bucket = ["band", "mark"]
    told = classes.select(F.col("h1").alias("c"), "weight", F.posexplode("marks").alias("band", "mark"))
    crowded = told.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = scratch.write(told.join(crowded, bucket))
    names = classes.select(F.col("h1").alias("c"), F.col("name").alias("id"), "t").join(met.select("c").distinct(), "c", "left_semi")
    # one text a class: a repeated key may come with several texts, and a row several times
    texts = scratch.write(plain.join(names, ["id", "t"]).groupBy("id", "t", "c").agg(F.first("text").alias("text")).select("c", "text"))
    sketches = scratch.write(texts.mapInArrow(_parity, "c long, parity array<long>"))
    keys = texts.mapInArrow(_lone, "key long, c long, n long, several boolean").groupBy("key").agg(F.count("*").alias("k"), F.bool_or("several").alias("several"), F.min("c").alias("low"), F.max("c").alias("high"), F.sum("n").alias("n"))
    lone = keys.where("NOT several AND low = high").groupBy(F.col("low").alias("c")).agg(F.sum("n").alias("lone"))
    every = met
    met = scratch.write(every.join(lone, "c", "left").select(*bucket, "c", "weight", F.greatest(F.col("weight") - F.coalesce("lone", F.lit(0)), F.lit(0)).alias("shared")))
    scratch.drop(every)
    central = F.struct((-F.floor(1000 * F.col("shared") / F.col("weight"))).alias("order"), "c", "weight", "shared")
    first = met.groupBy(*bucket).agg(F.min(central).alias("f"))
    least = F.lit(bands.least)

    def may(wx: str, sx: str, wy: str, sy: str) -> Column:
        """Whether the weights and the shared shingles allow the similarity."""
        return (F.least(wx, wy) >= least * F.greatest(wx, wy) - 1e-9) & ((1 + least) * F.least(sx, sy) >= least * (F.col(wx) + F.col(wy)) - 1e-9)

    def near(wx: str, px: str, wy: str, py: str) -> Column:
        """Whether the sketches allow the similarity: the bags may differ in (1 - s) / (1 + s) of their weights."""
        apart_in = F.aggregate(F.zip_with(px, py, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, e: n + e)
        return apart_in <= (F.col(wx) + F.col(wy)) * ((1 - bands.least) / (1 + bands.least)) + 1e-9

    ordered = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    star = met.join(first, bucket).select(F.col("c").alias("x"), F.col("weight").alias("wx"), F.col("shared").alias("sx"), F.col("f.c").alias("y"), F.col("f.weight").alias("wy"), F.col("f.shared").alias("sy"))
    tested = scratch.write(star.where((F.col("x") != F.col("y")) & may("wx", "sx", "wy", "sy")).select(*ordered).distinct())

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = texts.select(F.col("c").alias("a"), F.col("text").alias("s")), texts.select(F.col("c").alias("b"), F.col("text").alias("t"))
        return scratch.write(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(_verify(bands.least), "a long, b long"))

    links = verify(tested)
    reach = scratch.write(components(links, scratch))

    def apart() -> DataFrame:
        """Members of buckets with several components, those of the largest one marked; others only if they may link at all."""
        label = reach.select(F.col("id").alias("c"), "component")
        now = met.join(label, "c", "left").select(*bucket, "c", "weight", "shared", F.coalesce("component", "c").alias("component"))
        parts = now.groupBy(*bucket, "component").agg(F.count("*").alias("n")).groupBy(*bucket)
        main = parts.agg(F.count("*").alias("parts"), F.max(F.struct("n", "component"))["component"].alias("main")).where("parts > 1").drop("parts")
        live = (F.col("component") == F.col("main")) | (F.col("shared") >= least * F.col("weight") - 1e-9)
        return scratch.write(now.join(main, bucket).where(live).join(sketches, "c"))

    for turn in range(MAX_TURNS):
        rest = apart()
        size = rest.groupBy(*bucket).agg(F.count("*").alias("n"), F.count_if(F.col("component") != F.col("main")).alias("odd"))
        work = size.agg(F.sum(F.col("n") * F.col("odd")).alias("pairs"), F.sum("n").alias("n")).first()
        if (work.pairs or 0) <= 4 * (work.n or 0):
            break
        # one of the odd members of each bucket, another one in each turn and band, against all others
        pick = F.struct(F.xxhash64("c", "band", F.lit(turn)).alias("order"), "c", "weight", "shared", "component", "parity")
        odd = rest.where("component <> main").groupBy(*bucket).agg(F.min(pick).alias("f"))
        other = odd.select(*bucket, F.col("f.c").alias("y"), F.col("f.weight").alias("wy"), F.col("f.shared").alias("sy"), F.col("f.component").alias("cy"), F.col("f.parity").alias("py"))
        pairs = rest.select(*bucket, F.col("c").alias("x"), F.col("weight").alias("wx"), F.col("shared").alias("sx"), F.col("component").alias("cx"), F.col("parity").alias("px")).join(other, bucket)
        fresh = scratch.write(pairs.where((F.col("cx") != F.col("cy")) & may("wx", "sx", "wy", "sy") & near("wx", "px", "wy", "py")).select(*ordered).distinct().join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(fresh)
        links = links.unionByName(verify(fresh))
        reach = scratch.write(components(links, scratch))
    rest = apart().join(classes.select(F.col("h1").alias("c"), "marks", "brief"), "c")
    odd = rest.where("component <> main").select(*bucket, F.col("c").alias("x"), F.col("weight").alias("wx"), F.col("shared").alias("sx"), F.col("component").alias("cx"), F.col("marks").alias("mx"), F.col("brief").alias("bx"), F.col("parity").alias("px"))
    other = rest.select(*bucket, F.col("c").alias("y"), F.col("weight").alias("wy"), F.col("shared").alias("sy"), F.col("component").alias("cy"), "main", F.col("marks").alias("my"), F.col("brief").alias("by"), F.col("parity").alias("py"))
    # a pair that shares several bands is made in the first of them only
    once = F.array_position(F.zip_with("mx", "my", lambda p, q: p == q), True) == F.col("band") + 1
    alike = F.aggregate(F.zip_with("bx", "by", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, e: n + e) >= bands.fewest
    more = odd.join(other, bucket).where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))) & may("wx", "sx", "wy", "sy") & alike & near("wx", "px", "wy", "py") & once)
    # in the first band a pair's roles may differ from those in others, so both orders can come
    more = scratch.write(more.select(*ordered).distinct().join(tested, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        links = links.unionByName(verify(more))
        reach = scratch.write(components(links, scratch))
    scratch.drop(texts, sketches, met)
    label = reach.select(F.col("id").alias("h1"), F.col("component"))
    joined = scratch.write(classes.select("h1", "h2", "name").join(label, "h1", "left").select("h1", "h2", "name", F.coalesce("component", "h1").alias("component")))
    low = joined.groupBy("component").agg(F.min("name").alias("class_id"))
    named = joined.join(low, "component").select("h1", "h2", "class_id")
    out = signed.select("id", F.when(usable, F.col("h1")).alias("h1"), F.when(usable, F.col("h2")).alias("h2")).join(named, ["h1", "h2"], "left")
    name = F.coalesce("class_id", "id")
    return out.select(F.col("id").alias(key), name.alias("class_id"), F.coalesce(F.col("id") == name, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, bands: Bands = Bands(), key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """The rows whose key is the least of their class, with their own columns, of any names.

    Rows without a key stay, as do all rows of a repeated key that is the least of its class.
    """
    own, names = numbered(docs)
    gone = near_copies(docs, bands, key, text).where("NOT kept").select(F.col(key).alias("gone")).distinct()
    return own.join(gone, F.col(names[key]).cast("long") == F.col("gone"), "left_anti").select(*renamed(names))
