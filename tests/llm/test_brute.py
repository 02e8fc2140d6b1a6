"""Language models, mixing and the whole pipeline against step-by-step computations in plain Python."""

import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from textcohort.llm import _text, bagmin, langid, mixing, quality, queries, tokens

from ..conftest import DATA
from ..oracle import database
from .test_llm import served


# ----- language


def letters_of(text):
    out = " "
    for c in text:
        low = c.lower()
        x = (low if len(low) == 1 else c) if unicodedata.category(c)[0] == "L" else " "
        out += "" if x == " " and out[-1] == " " else x
    return out


class Counted:
    """Interpolated Kneser-Ney of one language, with dictionaries."""

    def __init__(self, texts, order, n_chars):
        self.order, self.n_chars = order, n_chars
        grams = Counter(s[i : i + order] for s in map(letters_of, texts) for i in range(len(s) - order + 1))
        self.count = {order: grams}
        for n in range(order - 1, 0, -1):
            self.count[n] = Counter(g[1:] for g in self.count[n + 1])  # how many characters come before
        self.discount, self.total, self.kinds = {}, {}, {}
        for n, c in self.count.items():
            ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
            self.discount[n] = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
            self.total[n], self.kinds[n] = Counter(), Counter()
            for g, v in c.items():
                self.total[n][g[:-1]] += v
                self.kinds[n][g[:-1]] += 1

    def p(self, g):
        n = len(g)
        if not n:
            return 1 / self.n_chars
        total = self.total[n][g[:-1]]
        if not total:
            return self.p(g[1:])
        d = self.discount[n]
        return (max(self.count[n][g] - d, 0) + d * self.kinds[n][g[:-1]] * self.p(g[1:])) / total

    def entropy(self, text):
        s = letters_of(text)
        at = range(len(s) - self.order + 1)
        return -sum(math.log(self.p(s[i : i + self.order])) for i in at) / len(at)


def test_language_models_equal_dictionaries(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL AND n_chars < 3000").limit(90).collect()]
    rows += [("Ünïcode ΣΑΣ наука 中文字 x", "zz"), ("İstanbul ǅ 1 2 3", "zz")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(docs)
    chars = {c for t, _ in rows for s in [letters_of(t)] if len(s) >= 4 for c in s}
    own = {x: Counted([t for t, k in rows if k == x], 4, len(chars) + 1) for x in model.langs}
    texts = [rows[3][0], rows[40][0], rows[-1][0], "never seen qqq zzzz ßßß 語", "the and of", "Que los de la"]
    got, n = model.entropies(*_text.utf8(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        assert row == pytest.approx([own[x].entropy(t) for x in model.langs], rel=1e-4)
    assert n.tolist() == [sum(unicodedata.category(c)[0] == "L" for c in t) for t in texts]
    best = [min(model.langs, key=lambda x, t=t: own[x].entropy(t)) for t in texts]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(asked, model).orderBy("doc_id").collect()] == best


def test_training_rows_are_bounded_by_language(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('a', id) AS text", "CASE WHEN id < 2900 THEN 'aa' ELSE 'bb' END AS lang")
    few = langid.train(docs.selectExpr("concat(repeat('xyz', 3), text) AS text", "lang"), rows=200)
    assert few.langs == ["aa", "bb"]
    # a uniform sample of the larger language, all of the smaller
    counts = {}
    original = langid.ngram_counts
    try:
        langid.ngram_counts = lambda d, *a: (counts.update({r.lang: r["count"] for r in d.groupBy("lang").count().collect()}), original(d, *a))[1]
        langid.train(docs, rows=200)
    finally:
        langid.ngram_counts = original
    assert counts["bb"] == 100 and 140 < counts["aa"] < 260


def test_rejection_limits_come_from_texts_put_aside(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.range(40).selectExpr("1000000 + id AS doc_id", "concat('zxq vwk jjx qqz ', id, ' xkcd wqx zzv kjq') AS text", "CAST(NULL AS STRING) AS lang")
    got = langid.detect(docs.unionByName(odd)).withColumn("strange", F.col("doc_id") >= 1_000_000).where("held_out").groupBy("strange").agg(F.avg(F.col("rejected").cast("int")).alias("r")).collect()
    share = {r.strange: r.r for r in got}
    assert share[False] < 0.05 and share[True] > 0.9


# ----- mixing


def fill(budget, holds, weights):
    """Shares min(hold, level * weight) whose sum is the budget, the level found by halving; those without weight come last."""
    out = [0.0] * len(holds)
    first = [i for i, w in enumerate(weights) if w > 0]
    for part, of in ((first, weights), ([i for i in range(len(holds)) if i not in first], [1.0] * len(holds))):
        have = min(budget, sum(holds[i] for i in part))
        low, high = 0.0, max([holds[i] / of[i] for i in part], default=0.0)
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(holds[i], level * of[i]) for i in part) < have else (low, level)
        for i in part:
            out[i] = min(holds[i], high * of[i])
        budget -= have
    return out


def tree(leaves, plan):
    out = {}

    def go(path, below, share):
        if len(path) == 3:
            out[path] = share
            return
        names = sorted({x[: len(path) + 1] for x in below})
        parts = {c: {x: n for x, n in below.items() if x[: len(c)] == c} for c in names}
        for c, s in zip(names, fill(share, [plan.max_epochs * sum(parts[c].values()) for c in names], [plan.weights.get(c, 1.0) for c in names]), strict=True):
            go(c, parts[c], s)

    total = sum(leaves.values())
    go((), leaves, min(plan.budget * total if plan.budget <= 1 else plan.budget, plan.max_epochs * total))
    return out


def chosen(spark, docs, plan, domain=None):
    """doc_id and epoch of the rows that the mixture should take, and its leaves' budgets."""
    node = lambda c: F.coalesce(c, F.lit("\0null"))
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    epochs = F.array(*(F.shiftrightunsigned(F.xxhash64(F.lit(plan.seed), F.lit(e).cast("long"), F.xxhash64("doc_id", "text")), 2) for e in range(plan.max_epochs + 1)))
    d = docs.select("doc_id", (domain if domain is not None else F.lit("all")).alias("d"), node(F.col("lang")).alias("l"), node(F.col("source")).alias("s"), count.alias("n"), epochs.alias("place")).toPandas()
    leaves = {k: int(g.n.sum()) for k, g in d.groupby(["d", "l", "s"])}
    want = tree(leaves, plan)
    out = []
    for leaf, g in d.groupby(["d", "l", "s"]):
        budget, whole = want[leaf], leaves[leaf]
        full = int((budget + 1e-6) // whole) if whole else 1
        out += [(i, e) for i in g.doc_id for e in range(full)]
        rest, order = budget - full * whole, g.assign(p=[p[full] for p in g.place]).sort_values("p")
        upto = order.n.cumsum()
        out += [(i, full) for i, u in zip(order.doc_id, upto, strict=True) if rest + 1e-6 >= 1 and u <= rest + 1e-6]
    return sorted(out), want


@pytest.mark.parametrize("plan", [mixing.Mixture(budget=0.4, seed=3), mixing.Mixture(budget=1.3e5, max_epochs=3, weights={("all", "en"): 4.0, ("all", "de"): 0.0, ("all", "en", "src0"): 9.0}), queries.MIXTURE, corpus_pipeline.MIXTURE])
def test_mixing_equals_water_filling(spark, plan):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    domain = queries.domain() if any(p[0] == "web" for p in plan.weights) else None
    rows, budgets = chosen(spark, docs, plan, domain)
    got = mixing.mix(docs, plan, domain).toPandas()
    assert sorted(zip(got.doc_id, got["__epoch"], strict=True)) == rows and len(rows) > 20
    held = {k: int(v) for k, v in budgets.items()}
    sums = defaultdict(int)
    for d, n in got.groupby(["lang", "source"])["__tokens"].sum().items():
        sums[d] += n
    assert sum(sums.values()) <= sum(held.values()) + len(held)


def test_mixing_narrows_like_it_sums(spark, monkeypatch):
    """Leaves too large for one task give the rows that a running sum gives."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", F.lit("one").alias("source"), "n_chars")
    plan = mixing.Mixture(budget=0.55)
    monkeypatch.setattr(mixing, "FEW", 10)
    monkeypatch.setattr(mixing, "SPLIT", 4)
    rows, _ = chosen(spark, docs, plan)
    got = mixing.mix(docs, plan).toPandas()
    assert sorted(zip(got.doc_id, got["__epoch"], strict=True)) == rows


# ----- tokens


def test_longest_prefix_within_the_limit(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars BETWEEN 200 AND 1500").limit(40).collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(9001, "naïve café 中文🙂 " * 20), (9002, "x" * 300), (9003, "we'll " * 30), (9004, " \n " * 60)]
    for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect():
        text = dict(rows)[r.doc_id]
        cut = len(text.encode()[: r.fit_bytes].decode())
        n = lambda k, t=text: len(library.encode(t[:k]).ids)
        assert n(cut) <= 25
        if cut < len(text):  # no longer prefix that ends outside a cut contraction or run of blanks fits
            assert all(n(k) > 25 for k in range(cut + 8, min(len(text), cut + 120)) if text[k - 1].isalnum() and not text[k : k + 1].isalnum())


# ----- pipeline


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # quality rules: their SQL
    kept = {d for d, k in database(DATA).sql(f"SELECT doc_id, kept FROM ({quality.oracle()})").fetchall() if k}
    # near copies: all pairs
    ids = sorted(kept)
    parent = {d: d for d in ids}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    bags = {}
    for d in ids:
        w = _words(rows[d].text)
        bags[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n, m = bags[a].total(), bags[b].total()
            if min(n, m) >= 0.8 * max(n, m) > 0:
                common = (bags[a] & bags[b]).total()
                if common >= 0.8 * (n + m - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    ids = [d for d in ids if root(d) == d]
    assert len(ids) < len(kept) < len(rows)
    # repeated passages: the first document of every 50 bytes
    seen, text = {}, {}
    for d in ids:
        b = rows[d].text.encode()
        for i in range(len(b) - 49):
            seen.setdefault(b[i : i + 50], d)
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        text[d] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    assert any(text[d] != rows[d].text for d in ids)
    cut = spark.createDataFrame([(d, text[d], rows[d].lang, rows[d].source, len(text[d])) for d in ids], docs.schema)
    # mixing
    mixed = [d for d, _ in chosen(spark, cut, corpus_pipeline.MIXTURE, queries.domain())[0]]
    # packing
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {d: len(library.encode(text[d]).ids) + 1 for d in mixed}
    got = corpus_pipeline.run(spark, DATA).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == n and (got.doc_tokens == got.doc_id.map(n)).all()
    total = sum(n.values())
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.tolist() == [1024] * (total // 1024) + [1 << b for b in reversed(range(10)) if total % 1024 >> b & 1]
    lengths = Counter()
    for d in mixed:
        lengths[rows[d].source or "\0null"] += n[d]
    target = queries.PROPORTIONS
    order = served(lengths, {q: target.get(q, lengths[q]) for q in lengths}, {q for q in lengths if q not in target}, 64)
    got = got.sort_values(["sequence_id", "offset"])
    flat = np.repeat([rows[d].source or "\0null" for d in got.doc_id], got.length)
    assert [flat[64 * k] for k in range(len(order))] == order


def _words(text):
    out, word = [], ""
    for c in text.lower():
        if ord(c) > 127 or c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def test_near_copies_lose_no_link_of_a_table(spark):
    """Recall over a whole table: the classes equal those of an exact join of all shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text]
    key, of, weight = [], [], {}
    (texts,) = [pa.array([t for _, t in rows])]
    for i, j, row, k, c in bagmin.bags(texts):
        weight |= {rows[i + r][0]: int(n) for r, n in enumerate(np.bincount(row, c, j - i))}
        key += [(int(x), rows[i + int(r)][0], int(n)) for x, r, n in zip(k, row, c, strict=True)]
    shingle = defaultdict(list)
    for x, d, n in key:
        shingle[x].append((d, n))
    common = Counter()
    for who in shingle.values():
        for i, (a, n) in enumerate(who):
            for b, m in who[:i]:
                common[max(a, b), min(a, b)] += min(n, m)
    parent = {d: d for d, _ in rows}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    links = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (weight[a] + weight[b] - n)]
    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in bagmin.near_copies(docs).collect()}
    assert len(links) > 50 and all(got[d] == root(d) for d in parent)
