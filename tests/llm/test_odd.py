"""Every operator and pipeline stage on odd rows, with columns named as the operators' own, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textcohort.llm import bagmin, chat, langid, lattice, licenses, mixing, packing, quality, suffixes, tokens
from textcohort.llm._spark import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = "a passage of more than fifty words that " + " ".join(f"says thing number {i} and then" for i in range(20))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "src0", 0),
    (3, "word", "en", "src0", 4),
    (3, "word", "en", "src0", 4),
    (4, " \n\t ", "de", None, 4),
    (5, "naïve café — ünïcode 中文 🙂 " * 60, "fr", "src12", 1),
    (6, PASSAGE, "en", "src1", 1),
    (7, PASSAGE, "en", "src1", 1),
    (7, PASSAGE, "en", "src1", 1),
    (8, "something else before. " + PASSAGE[:-9] + " and some more words after it to end with", None, "src1", 1),
    (9, LONG, "en", "src3", 200_000),
    (10, LONG + " and an end", "en", "src3", 200_000),
    (None, "a row without a key that has some words in it and " + PASSAGE, "en", "src3", 1),
]
#: Names that operators use inside, or return.
NAMES = (
    "__gone gone __id id t uid ids sizes d1 extra blob key row rows queue part before place due late rest task within total weight length start offset sequence_id __lang __source __domain __leaf __full __cut "
    "__epoch __tokens __q_n_words __q_n_lines __kept __base_failed kept class_id n_words c0 c1 c2 c9 c words pos hash marks brief band mark component parity shared lang_pred entropy score held_out limit about fold aside "
    "n_tokens n_bytes n_removed n_spans kept_sha256 segments formatted valid_order turns label labels n_links component_id rep vec name cell"
).split()


@pytest.fixture(scope="module")
def plain(spark):
    return Scratch(spark).write(spark.createDataFrame(ROWS, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, drop=()):
    cols = sorted(c for c in df.columns if c not in drop)
    return sorted(map(repr, df.select(*(F.col(f"`{c}`") for c in cols)).collect()))


OPERATORS = {
    "near_copies": bagmin.near_copies,
    "language": langid.detect,
    "packing": lambda d: packing.pack(d, weights={"src0": 1.0, "src3": 2.0}).drop("sequence_id", "offset"),
    "quality": quality.quality,
    "repeated_passages": suffixes.repeated_passages,
    "licences": licenses.scan,
    "tokens": tokens.count_tokens,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(name, plain, clashing, empty):
    want = OPERATORS[name](plain)
    assert OPERATORS[name](clashing).columns == want.columns
    assert rows(OPERATORS[name](clashing)) == rows(want)
    assert OPERATORS[name](empty).count() == 0
    if name != "packing":
        assert want.count() == len(ROWS)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_all_columns(spark, name, stage, plain, clashing, empty):
    got = stage(spark, clashing, "")
    assert got.columns == clashing.columns
    assert all(r[n] == f"own {n}" for r in got.collect() for n in NAMES)
    assert rows(got, NAMES) == rows(stage(spark, plain, ""))
    assert stage(spark, empty, "").count() == 0 and stage(spark, empty, "").columns == empty.columns


def test_stages_on_odd_rows(spark, plain):
    left = {n: sorted((r.doc_id or 0, r.text) for r in s(spark, plain, "").where("text IS NOT NULL").collect()) for n, s in corpus_pipeline.STAGES[:-1]}
    assert {d for d, _ in left["quality_rules"]} == {0, 6, 7, 8, 9, 10}
    assert [d for d, _ in left["minhash_near_dedup"]] == [0, 2, 3, 3, 4, 5, 6, 9]  # 7, 8 are near 6, 10 is near 9; null texts and rows without a key stay
    cut = dict(left["suffix_array_dedup"])
    assert cut[6] == PASSAGE and cut[7] == "" and cut[9] == LONG and cut[10].strip() in (LONG + " and an end")[-50:] and cut[0].endswith(PASSAGE)
    whole = corpus_pipeline.STAGES[-1][1](spark, plain, "").toPandas()
    n = tokens.count_tokens(plain).toPandas().n_tokens.sum() + len(ROWS)
    assert whole.length.sum() == n
    sizes = whole.groupby("sequence_id").length.sum()
    assert (sizes[:-11] == 1024).all() and all(x & (x - 1) == 0 for x in sizes)
    for _, g in whole.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()


def test_mixing_returns_its_own_columns_in_place_of_equal_ones(clashing):
    got = mixing.mix(clashing, mixing.Mixture())
    assert got.columns == [c for c in clashing.columns if c not in ("__epoch", "__tokens")] + ["__epoch", "__tokens"]
    assert got.where("__epoch = 0 AND __tokens >= 0").count() == got.count() > 0


def test_chats_of_odd_rows(spark):
    turns = [(1, 0, "user", LONG), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "x"), (2, 1, "assistant", "</s>"), (None, 0, "user", "no key"), (None, 0, "user", "no key")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    more = df.select("*", *(F.lit(n).alias(n) for n in NAMES if n not in df.columns))
    want, got = chat.digest(chat.format_chats(df)), chat.digest(chat.format_chats(more))
    assert rows(want) == rows(got)
    out = {r.conv_id: r for r in want.collect()}
    assert (out[1].n_turns, out[1].loss_chars, out[2].n_turns, out[None].n_turns) == (3, 0, 2, 2) and out[2].loss_chars == 4
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_vectors_of_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    table = [(1, v), (1, v), (2, [2.0, 4.0, 6.0, 8.0]), (3, None), (4, [0.0] * 4), (5, [1.0, None, 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0, 1.0]), (None, v), (7, []), (8, [1.0] * 3000), (9, [1.0] * 3000)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    more = df.select("*", *(F.lit(n).alias(n) for n in NAMES))
    got = lattice.near_vectors(more)
    assert got.columns == lattice.near_vectors(df).columns and rows(got) == rows(lattice.near_vectors(df))
    links = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got.collect())
    assert links == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8)]
    assert lattice.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [3, 8, 16, 24, 48, 128])
def test_lattice_recall_by_dimension(dim):
    """Pairs at a cosine of exactly 0.95 meet in a cell of some table, at every dimension."""
    import numpy as np

    rng, n, least = np.random.default_rng(dim), 1500, lattice.Lattice()
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    u, v = unit(rng.normal(size=(n, dim))), rng.normal(size=(n, dim))
    v = unit(v - (v * u).sum(1, keepdims=True) * u)
    a, b = lattice.cells(u, least), lattice.cells(0.95 * u + np.sqrt(1 - 0.95**2) * v, least)
    met = ((a[:, :, :, None] == b[:, :, None, :1]) | (b[:, :, :, None] == a[:, :, None, :1])).any((1, 2, 3))
    assert met.mean() > 0.99
