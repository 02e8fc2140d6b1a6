"""The corpus operators against brute force, round trips and held-out accuracy, with odd inputs."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from textcohort.llm import _text, bagmin, bpe, chat, langid, lattice, licenses, mixing, packing, quality, queries, suffixes, tokens
from textcohort.llm._components import components
from textcohort.llm._spark import Scratch

from ..conftest import DATA
from ..oracle import assert_same, database

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, 0),
    (2, "", "en", "a", 0),
    (3, "word", "en", "a", 4),
    (3, "word", "en", "a", 4),
    (4, " \n\t ", "de", None, 4),
    (5, "naïve café — ünïcode 中文 🙂 " * 60, "fr", "b", 1),
    (6, "the quick brown fox jumps over the lazy dog and runs away again " * 5, "en", "b", 1),
    (7, "the quick brown fox jumps over the lazy dog and runs away again " * 5, "en", "b", 1),
    (8, "x" * 70_000, "en", "c", 70_000),
    (None, "a row without a key that has some words in it", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("n_words", F.lit("clash")).withColumn("row", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), database(DATA), queries.ORACLES[name])


# ----- tokens


def test_bpe_equals_the_library(library):
    pool = ["'s", "'re", "'ll", " ", "  ", "\n", "a", "é", "ab", "1", "²", "!", "'", "the", "中", "🙂", "\x1c", "x" * 60, "=-" * 40, " don't", "<|endoftext|>"]
    rng = random.Random(1)
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(400)]
    data, offsets = _text.utf8(pa.array(texts))
    model = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    _, _, number = model.encode(data, offsets)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert model.token_ids_of(number).tolist() == [i for ids in want for i in ids]


def test_prefix_counts_are_exact(library):
    text = "Hello worlds, the naïve 123 we'll  antidisestablishmentarianism\n\nok \n"
    counts, raw = tokens.prefix_counts(text), text.encode()
    for i in range(len(text) + 1):
        part = text[:i]
        assert counts[len(part.encode())] == len(library.encode(part).ids), part
    assert counts[len(raw)] == len(library.encode(text).ids)


def test_token_counts_of_odd_rows(spark, odd, none, library):
    got = tokens.count_tokens(odd, 20).toPandas()
    want = sorted(len(library.encode(t or "").ids) for _, t, *_ in ODD)
    assert sorted(got.n_tokens) == want and len(got) == len(ODD)
    assert tokens.count_tokens(none).count() == 0
    for r in got[got.over_limit].itertuples():
        text = next(t for i, t, *_ in ODD if t and len(t.encode()) == r.n_bytes)
        assert len(library.encode(text.encode()[: r.fit_bytes].decode()).ids) <= 20


# ----- packing


def served(lengths, weights, late, quantum):
    """Deficit round-robin step by step: the queues in the order in which they get whole quanta."""
    out = []
    for names in ([q for q in lengths if q not in late], [q for q in lengths if q in late]):
        left = {q: lengths[q] // quantum for q in names}
        had = dict.fromkeys(names, 0)
        while any(left.values()):
            # the time until each deficit has grown to a quantum
            q = min((q for q in names if left[q]), key=lambda q: ((had[q] + quantum) / weights[q], q))
            had[q] += quantum
            left[q] -= 1
            out.append(q)
    return out


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 3.0, "c": 0.5}])
def test_packing_equals_round_robin(spark, odd, library, weights):
    rng = random.Random(8)
    more = [(1000 + i, " ".join(rng.choice(["alpha", "beta", "naïve", "x1"]) for _ in range(rng.randint(0, 60))), "en", rng.choice("aabcd"), 1) for i in range(300)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, SCHEMA))
    got = packing.pack(docs.repartition(5), 64, weights, keep_ids=True, quantum=8).toPandas()
    rows = [*ODD, *more]
    # every row once: pieces of one document (rows of one key) cover all its copies' tokens
    ids = {}
    for d, t, *_ in rows:
        ids.setdefault(d, []).append(library.encode(t or "").ids + [0])
    got["doc_id"] = got.doc_id.astype(object).where(got.doc_id.notna(), None)
    assert all(zlib.crc32(x) == c and len(x) == 4 * n for x, c, n in zip(got.ids, got.ids_crc32, got.length, strict=True))
    for d, copies in ids.items():
        g = got[got.doc_id == d] if d is not None else got[got.doc_id.isna()]
        want = copies[0]
        assert all(c == want for c in copies) and (g.doc_tokens == len(want)).all()
        held = np.zeros(len(want), int)
        for x, a, n in zip(g.ids, g.start, g.length, strict=True):
            assert np.frombuffer(x, "<u4").tolist() == want[a : a + n]
            held[a : a + n] += 1
        assert (held == len(copies)).all()
    got = got.sort_values(["sequence_id", "offset"])
    for _, g in got.groupby("sequence_id"):
        n = g.length.sum()
        assert (g.offset == g.length.cumsum() - g.length).all() and (n == 64 or n & (n - 1) == 0)
    assert (got.groupby("sequence_id").length.sum().sort_index().iloc[:-6] == 64).all()
    # the quanta of the windows are those of a round-robin done step by step
    queue = {d: s for d, _, _, s, _ in rows}
    name = [queue[d] or "\0null" for d in got.doc_id]
    lengths = Counter()
    for d, _, _, s, _ in rows:
        lengths[s or "\0null"] += len(ids[d][0])
    late = set(lengths) - set(weights or lengths)
    want = served(lengths, {q: (weights or {}).get(q, lengths[q]) for q in lengths}, late, 8)
    flat = np.repeat(name, got.length)
    whole = [flat[8 * k : 8 * k + 8] for k in range(len(want))]
    assert all(len(set(x)) == 1 for x in whole) and [x[0] for x in whole] == want
    if weights:  # while all named queues last, each has its share but for a quantum
        n = np.cumsum([w == "b" for w in want]) * 8
        lasts = int(min(lengths[q] / w for q, w in weights.items()) * sum(weights.values()) / 8) - 3
        share = 3 / 4.5 * 8 * np.arange(1, lasts + 1)
        assert lasts > 10 and (abs(n[:lasts] - share) <= 16).all()
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_has_no_limit_of_sources(spark):
    """Every source keeps a queue of its own beyond thousands of them, with and without targets."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "repeat('w ', 20) AS text", "concat('host', id % 4500) AS source")
    for weights, share in ((None, 1 / 4500), ({f"host{i}": 3.0 if i == 7 else 1.0 for i in range(4500)}, 3 / 4502)):
        got = packing.pack(docs, 64, weights, quantum=8).withColumn("host", F.expr("doc_id % 4500")).where("host = 7").toPandas()
        n, first = got.length.sum(), got.sequence_id.min() * 64
        assert n == got.groupby("doc_id").doc_tokens.first().sum()
        # its quanta come one by one at the distance that its share asks for
        place = (got.sequence_id * 64 + got.offset).sort_values()
        assert abs((place.iloc[4] - first) / 32 - 1 / share / 1) < 0.3 / share or place.iloc[-1] - first > 3 / share


def test_cuts_cover_intervals():
    rng = np.random.default_rng(6)
    for _ in range(50):
        length = rng.integers(0, 40, 12)
        place = np.cumsum(length) - length
        row, start, size, quantum = packing.cuts(place, length, np.full(12, length.sum()), 8)
        at = place[row] + start
        assert (at == np.cumsum(size) - size).all() and size.sum() == length.sum()
        assert (at // quantum == (at + size - 1) // quantum).all() and (quantum[at < length.sum() // 8 * 8] == 8).all()


# ----- quality, licences, chat


def test_quality_of_odd_rows(odd, none):
    got = quality.quality(odd).toPandas()
    assert len(got) == len(ODD) and quality.quality(none).count() == 0
    assert got[got.doc_id == 1][quality.BASE].to_numpy().sum() == 0 and not got[got.doc_id == 1].kept.any()
    assert got[got.doc_id == 6].n_repeat_words.item() == 65 and got[got.doc_id == 6].base_failed.item()
    kept = quality.filter_quality(odd)
    assert kept.columns == odd.columns


def test_licences(spark, odd, none):
    rows = [(1, "See the MIT License and MIT-license. mit  license"), (2, "GNU General Public\nLicense v3"), (3, "permission is hereby granted free of any charge to any person obtaining a copy of this software and the associated documentation files"), (4, "mit licenses")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 2, 7, "mit")
    assert got[2].base_labels == "gpl" and got[3].n_base == 0 and got[3].labels == "mit-text" and got[4].n_base == 0 and got[4].first_word is None
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b\\z\\e[IN", "<", "<<SYS>>[ROLE]x[AS]", "", None, "\\", "é🙂<s", "[[INST]"]
    roles = ["system", "user", "assistant", "tool[AS]", None, ""]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(df)
    back = {r.conv_id: [(x.role, x.text) for x in r.t] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    for c in range(40):
        assert back[c] == [(r or "", t or "") for k, _, r, t in rows if k == c]
    assert chat.format_chats(df.limit(0)).count() == 0
    order = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.valid_order for r in chat.format_chats(order).collect()} == {1: True, 2: False, 3: False}


# ----- language


def test_language_held_out(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.detect(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert langid.detect(none).count() == 0


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    chars = rng.integers(97, 103, 3000)
    grams = np.stack([chars[k : 2997 + k] for k in range(4)], 1).astype(np.int64)
    uniq, n = np.unique(grams, axis=0, return_counts=True)
    model = langid.KneserNey(["x"], np.zeros(len(uniq), np.int64), uniq, n)
    some = np.array([[97, 98, 99], [102, 102, 97]])
    for ctx in some:
        every = np.array([[*ctx, c] for c in range(97, 103)])
        assert np.exp(model._lookup(4, every)).sum() == pytest.approx(1, abs=0.02)


def test_language_of_odd_rows(odd):
    got = {r.doc_id: r for r in langid.detect(odd).collect()}
    assert got[1].lang_pred == "und" and got[2].lang_pred == "und" and got[4].lang_pred == "und" and got[2].score == 0


# ----- near copies


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    a, b = [], []
    for _ in range(30):
        x = rng.choice([f"w{i}" for i in range(60)], 80).tolist()
        y = list(x)
        for k in rng.choice(80, rng.integers(1, 12), replace=False):
            y[k] = "z"
        a.append(" ".join(x * 3))
        b.append(" ".join(y * 2))
    (_, n, row, key, count) = next(iter(bagmin.bags(pa.array(a + b))))
    s = bagmin.signatures(n, row, key, count, 1500)
    exact = bagmin.similarity(pa.array(a), pa.array(b))
    assert abs(((s[:30] == s[30:]).mean(1) - exact).mean()) < 0.01

    def brute(p, q):
        bag = lambda t: Counter(tuple(t[i : i + 5]) for i in range(len(t) - 4))
        u, v = bag(p.split()), bag(q.split())
        return sum((u & v).values()) / sum((u | v).values())

    assert np.allclose(exact, [brute(p, q) for p, q in zip(a, b, strict=True)])


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(50)}"
        rows.append((i, " ".join(t)))
    rows += [(200 + i, x) for i, x in enumerate(["", None, "one", "one", "One!", "two words"])]
    got = {r.doc_id: r for r in bagmin.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [t or "" for _, t in rows]
    parent = {d: d for d, _ in rows}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(rows)):
        s = bagmin.similarity(pa.array([texts[i]] * i), pa.array(texts[:i])) if i else []
        for j in np.flatnonzero(np.array(s) >= 0.8):
            x, y = root(rows[i][0]), root(rows[j][0])
            parent[max(x, y)] = min(x, y)
    assert {d: r.class_id for d, r in got.items()} == {d: root(d) for d in parent}
    assert all(r.kept == (r.class_id == d) for d, r in got.items())


def test_near_copies_of_odd_rows(odd, none):
    got = bagmin.near_copies(odd).toPandas()
    assert len(got) == len(ODD) and got[got.doc_id == 7].class_id.item() == 6 and bagmin.near_copies(none).count() == 0
    assert bagmin.drop_near_copies(odd).columns == odd.columns


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 100] + [(500, 501)], "a long, b long")
    got = {r.id: r.component for r in components(links, Scratch(spark)).collect()}
    assert got == {i: 0 if i <= 100 else 101 for i in range(n + 1)} | {500: 500, 501: 500}


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 32))
    x = centre[rng.integers(0, 20, 300)] + rng.normal(size=(300, 32)) * rng.choice([0.0, 0.1, 0.25], (300, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, rows[5][1]), (1003, rows[5][1]), (1004, [1.0, 2.0]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = lattice.near_vectors(df).toPandas()
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 32 and np.isfinite(v).all() and any(v)]
    m = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = m @ m.T >= 0.95
    want = Counter({i: 0 for i, _ in ok})
    for k, (i, _) in enumerate(ok):
        want[i] = int(near[k].sum()) - 1
    real = got[got.vec_id.isin([i for i, _ in ok])].drop_duplicates()
    found = sum(real.n_links)
    assert found >= 0.99 * sum(want.values()) and all(r.n_links <= want[r.vec_id] for r in real.itertuples())
    assert len(got) == len(rows) and (got[got.vec_id.isin([1000, 1001, 1002, 1004])].n_links == 0).all()


def test_e8_decoder_finds_the_nearest_point():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    p = lattice.decode(x)
    d = ((x - p) ** 2).sum(1)
    around = ((x[:, None] - p[:, None] - lattice.roots()[None]) ** 2).sum(2).min(1)
    assert (d <= around + 1e-9).all() and (d <= 1 + 1e-9).all()


# ----- repeated passages


def brute_cut(docs, least=50):
    seen = {}
    for d, t in sorted((d, t or "") for d, t in docs if d is not None):
        b = t.encode()
        for i in range(len(b) - least + 1):
            seen.setdefault(b[i : i + least], d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if d is not None and seen[b[i : i + least]] < d:
                gone[i : i + least] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((-1 if d is None else d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("plan", [suffixes.Plan(), suffixes.Plan(chunk_bytes=3000, buckets=8, hot=2)])
def test_repeated_passages_equal_brute_force(spark, plan):
    rng = random.Random(9)
    passage = ["".join(rng.choice("abcd é") for _ in range(rng.randint(45, 200))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(passage) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a" * 500), (105, "a" * 300), (3, rows[4][1]), (None, passage[0] * 2)]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), plan).toPandas().fillna({"doc_id": -1})
    assert sorted((int(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()) == brute_cut(rows)


def test_repeated_passages_of_odd_rows(odd, none):
    out = suffixes.drop_repeated_passages(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert {r.doc_id: r.text for r in out.collect()}[7] == ""
    assert suffixes.repeated_passages(none).count() == 0


@pytest.mark.parametrize("letters,seed", [(2, 4), (3, 5), (1, 6), (26, 7)])
def test_suffix_order_and_prefixes(letters, seed):
    """Kasai's prefixes equal those compared byte by byte, also where not every position is wanted."""
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
    data[1500:1800] = data[200:500]
    for wanted in (np.arange(2950), np.flatnonzero(np.arange(2950) % 300 < 170)):
        order, group = suffixes.suffix_order(data, wanted, 50)
        raw = data.tobytes()
        assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in wanted)
        lcp = suffixes.common_prefixes(data, order, group, 50)
        assert lcp[0] == 0
        for a, b, n in zip(order[:-1], order[1:], lcp[1:], strict=True):
            assert n == next((k for k in range(50) if raw[a + k] != raw[b + k]), 50)


def test_anchors_take_little_memory_and_cover_each_string_once():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 123, 2_000_000).astype(np.uint8)
    offsets = np.concatenate([[0, 0], np.sort(rng.integers(0, len(data), 300)), [len(data), len(data)]]).astype(np.int64)
    suffixes.anchors(data[:100], np.array([0, 100]), suffixes.Plan())  # powers are kept
    tracemalloc.start()
    first, last, _ = suffixes.anchors(data, offsets, suffixes.Plan())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = np.flatnonzero(row[:-49] == row[49:])
    assert np.array_equal(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]), whole)


def test_a_shard_sorts_parts_and_equal_contents_once(monkeypatch):
    """However large a shard and however many copies it has, what is sorted at a time stays small."""
    rng = random.Random(3)
    contents = ["".join(rng.choice("ab") for _ in range(80)).encode() for _ in range(200)]
    contents += [c[:55] + b"x" * 30 for c in contents]  # the first strings are shared
    part = [k % 200 for k in range(400)]
    chunks = [sorted(rng.sample(range(400), 300), key=lambda k: part[k]) for _ in range(20)]
    keys = [[rng.randint(0, 50) for _ in c] for c in chunks]
    pack = lambda x, kind: suffixes._pack(np.array(x, kind))
    binary = {
        "sizes": [pack([len(contents[k]) for k in c], "<u4") for c in chunks],
        "parts": [pack([part[k] for k in c], "u1") for c in chunks],
        "keys": [pack(k, "<i8") for k in keys],
        "blob": [suffixes._pack(np.frombuffer(b"".join(contents[k] for k in c), np.uint8)) for c in chunks],
    }
    table = pa.table({"uid": pa.array(range(20), pa.int64()), "first": pa.array([7] * 20, pa.int64()), **{k: pa.array(v, pa.binary()) for k, v in binary.items()}})
    monkeypatch.setattr(suffixes, "PART_BYTES", 20_000, raising=False)
    sizes, order = [], suffixes.suffix_order
    monkeypatch.setattr(suffixes, "suffix_order", lambda data, *a: sizes.append(len(data)) or order(data, *a))
    got = suffixes._solve(suffixes.Plan())(table)
    assert max(sizes) <= 20_000 and sum(sizes) <= sum(map(len, contents))
    least = {}
    for c, own in zip(chunks, keys, strict=True):
        for k, key in zip(c, own, strict=True):
            for i in range(len(contents[k]) - 49):
                s = part[k], contents[k][i : i + 50]
                least[s] = min(key, least.get(s, key))
    told = {}
    for uid, raw in zip(got.column("uid").to_pylist(), got.column("answer").to_pylist(), strict=True):
        for c, start, n, key in zip(*suffixes._unpack(raw, "<i8").reshape(4, -1).tolist(), strict=True):
            told.update({(uid, c - 7, start + i): key for i in range(n)})
    want = {(u, j, i): low for u, c in enumerate(chunks) for j, k in enumerate(c) for i in range(len(contents[k]) - 49) if (low := least[part[k], contents[k][i : i + 50]]) < keys[u][j]}
    assert told == want


# ----- mixing


def test_shortages_go_to_siblings_first():
    leaves = {("d", "en", "s1"): 100, ("d", "en", "s2"): 1000, ("d", "de", "s1"): 1000, ("e", "en", "s1"): 1000}
    got = mixing.budgets(leaves, mixing.Mixture(budget=1600))
    # d gets 800, en 400: s1 holds 100 only, and its sibling takes the rest
    assert got == {("d", "en", "s1"): 100, ("d", "en", "s2"): 300, ("d", "de", "s1"): 400, ("e", "en", "s1"): 800}
    assert sum(mixing.budgets(leaves, mixing.Mixture(budget=5000, max_epochs=1)).values()) == 3100


def test_mixing_takes_the_longest_prefix(spark, odd, none):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else "de", f"s{i % 2}", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.Mixture(budget=0.5, max_epochs=2, weights={("all", "en"): 3.0, ("all", "en", "s1"): 9.0})
    got = mixing.mix(docs, plan).toPandas()
    size = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n"]).assign(n=lambda d: 1 + d.doc_id % 7)
    leaves = {("all", *k): int(v) for k, v in size.groupby(["lang", "source"]).n.sum().items()}
    want = mixing.budgets(leaves, plan)
    for (lang, source), g in got.groupby(["lang", "source"]):
        b = want["all", lang, source]
        assert b - 7 < g["__tokens"].sum() <= b
    assert got.equals(mixing.mix(docs.repartition(5), plan).toPandas().set_index(["doc_id", "__epoch"]).loc[list(zip(got.doc_id, got["__epoch"], strict=True))].reset_index()[got.columns])
    assert mixing.mix(none, plan).count() == 0
    assert mixing.mix(odd, mixing.Mixture(budget=1.0)).where("__tokens > 0").count() == sum(bool((t or "").split()) for _, t, *_ in ODD)


def test_pipeline_runs_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark).write(stage(spark, docs, DATA))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 0
    left = docs.toPandas()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert set(packed.doc_id) == set(left.doc_id) and packed.length.sum() == packed.groupby("doc_id").doc_tokens.first().sum()


def test_odd_sketches_bound_the_difference():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    got = np.concatenate([np.stack([np.array(x, np.int64) for x in b.column(1).to_pylist()]) for b in bagmin._parity(iter([pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["c", "text"])]))])
    bag = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)]) for w in (t.split() for t in texts)]
    close = 0
    for i in range(59):
        d = sum(((bag[i] - bag[i + 1]) + (bag[i + 1] - bag[i])).values())
        bits = int(np.bitwise_count((got[i] ^ got[i + 1]).view(np.uint64)).sum())
        assert bits <= d and (d - bits) % 2 == 0
        close += bits > 0.7 * d
    assert close > 50
