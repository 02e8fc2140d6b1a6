"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to a few blocks of eight dimensions, each decoded to the
nearest point of the E8 lattice; the points of a table's blocks name a cell.  A vector is
stored in its own cell of each table and also looks into the neighbouring cells whose points
are nearest.  All that meet in a cell are compared by cosine, in blocks of bounded size, so a
crowded cell costs more tasks, not a larger one, and only counts and spanning links leave a
comparison.  Equal vectors are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._components import components
from ._spark import Scratch


@dataclass(frozen=True)
class Lattice:
    """tables of `blocks` E8 points at `scale`; `probes` cells are looked into per table."""

    tables: int = 5
    blocks: int = 2
    scale: float = 0.3
    probes: int = 8
    seed: int = 20
    block_rows: int = 128


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, from their definition."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer of the nearest points of D8 and of D8 shifted by one half."""

    def d8(y: np.ndarray) -> np.ndarray:
        f = np.rint(y)
        gap = y - f
        worst = np.abs(gap).argmax(1)
        row = np.flatnonzero(f.sum(1) % 2 != 0)
        f[row, worst[row]] += np.where(gap[row, worst[row]] >= 0, 1, -1)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


@lru_cache(maxsize=16)
def projections(dim: int, lattice: Lattice) -> np.ndarray:
    """For each table, orthonormal rows where the dimension allows: tables x dim x 8 blocks."""
    rng = np.random.default_rng([lattice.seed, dim])
    wide = 8 * lattice.blocks
    out = np.zeros((lattice.tables, dim, wide))
    for t in range(lattice.tables):
        g = rng.normal(size=(max(dim, wide), wide))
        out[t] = np.linalg.qr(g)[0][:dim] if dim >= wide else g[:dim] / np.sqrt(wide)
    # a projection keeps wide / dim of a squared distance, all of it where dim <= wide: scaled to that at 64 dimensions
    return out * np.sqrt(max(dim, wide) / 64)


def cells(unit: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Cell hashes, rows x tables x probes; the first is the vector's own cell."""
    n, dim = unit.shape
    out = np.zeros((n, lattice.tables, lattice.probes), np.int64)
    near = min(16, 1 + len(roots()))
    for t, matrix in enumerate(projections(dim, lattice)):
        x = (unit @ matrix / lattice.scale).reshape(n, lattice.blocks, 8)
        total, code = np.zeros((n, 1)), np.full((n, 1), t * 1_000_003 + dim, np.uint64)
        for b in range(lattice.blocks):
            centre = decode(x[:, b])
            points = np.concatenate([centre[:, None], centre[:, None] + roots()[None]], 1)
            far = ((x[:, b, None] - points) ** 2).sum(2)
            some = np.argpartition(far, near - 1, axis=1)[:, :near]
            gap = np.take_along_axis(far, some, 1)
            order = np.lexsort((some, gap), axis=1)
            some, gap = np.take_along_axis(some, order, 1), np.take_along_axis(gap, order, 1)
            twice = np.rint(2 * np.take_along_axis(points, some[:, :, None], 1)).astype(np.int64)
            mark = np.zeros((n, near), np.uint64)
            for k in range(8):
                mark = _text.mix64(mark * np.uint64(0x9E3779B97F4A7C15) + twice[:, :, k].astype(np.uint64) + np.uint64(k + 8 * b))
            total = (total[:, :, None] + gap[:, None]).reshape(n, -1)
            code = _text.mix64(code[:, :, None] * np.uint64(0xA0761D6478BD642F) + mark[:, None]).reshape(n, -1)
            best = np.argsort(total, axis=1, kind="stable")[:, : lattice.probes]
            total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
        if code.shape[1] < lattice.probes:
            code = np.concatenate([code, np.repeat(code[:, :1], lattice.probes - code.shape[1], 1)], 1)
        out[:, t] = code.view(np.int64)
    return out


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite parts and not zero."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells_of(lattice: Lattice):
    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                for a in range(0, len(rows), 2000):
                    some = pa.array(rows[a : a + 2000])
                    ids = batch.column(0).take(some).to_numpy(zero_copy_only=False)
                    got = cells(_unit(batch.column(1).take(some)), lattice)
                    n, t, p = got.shape
                    own = np.zeros((n, t, p + 1), np.int64)
                    own[:, :, 0], own[:, :, 1:] = got[:, :, 0], got
                    fresh = np.ones((n, t, p + 1), bool)
                    for k in range(2, p + 1):  # a probe is told once
                        fresh[:, :, k] = (own[:, :, k, None] != own[:, :, 1:k]).all(2)
                    fresh = fresh.ravel()
                    columns = [np.repeat(ids, t * (p + 1)), np.tile(np.repeat(np.arange(t), p + 1), n), own.ravel(), np.tile(np.arange(p + 1) > 0, n * t)]
                    yield pa.RecordBatch.from_arrays([pa.array(c[fresh]) for c in columns], names=["rep", "table", "cell", "looks"])

    return run


def _compare(lattice: Lattice, least: float):
    """Counts of links and spanning links of one pair of blocks."""

    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_rows, b_rows, adds = [], [], []
            table = batch.column(0).to_pylist()
            stored, looking = batch.column(1), batch.column(2)
            for r in range(batch.num_rows):
                i, j = stored[r].values, looking[r].values
                ids_i, ids_j = (np.asarray(x.field("rep")) for x in (i, j))
                dim_i, dim_j = (len(x.field("vec")[0]) for x in (i, j))
                if dim_i != dim_j:
                    continue
                u, v = _unit(i.field("vec")), _unit(j.field("vec"))
                x, y = np.nonzero(u @ v.T >= least)
                other = ids_i[x] != ids_j[y]
                x, y = x[other], y[other]
                if not len(x):
                    continue
                # a pair may meet in several cells; it counts in the first table and role where it does
                t = table[r]
                nx, ny = np.unique(x), np.unique(y)
                cx, cy = cells(u[nx], lattice), cells(v[ny], lattice)
                px, py = np.searchsorted(nx, x), np.searchsorted(ny, y)
                counted = np.zeros(len(x), bool)
                for k in range(0, len(x), 20_000):
                    s = slice(k, k + 20_000)
                    finds = (cy[py[s]] == cx[px[s], :, :1]).any(2)  # j looks into i's cell
                    found = (cx[px[s]] == cy[py[s], :, :1]).any(2)
                    first = (finds | found).argmax(1)
                    row = np.arange(len(first))
                    counted[s] = (first == t) & (~found[row, first] | (ids_i[x[s]] < ids_j[y[s]]))
                x, y = x[counted], y[counted]
                if not len(x):
                    continue
                m_i, m_j = (np.asarray(z.field("mult")) for z in (i, j))
                for ids, mine, others, mult in ((ids_i, x, y, m_j), (ids_j, y, x, m_i)):
                    n = np.bincount(mine, mult[others], minlength=len(ids))
                    has = np.flatnonzero(n)
                    a_rows += ids[has].tolist()
                    b_rows += [None] * len(has)
                    adds += n[has].astype(np.int64).tolist()
                both, edge = np.unique(np.concatenate([ids_i[x], ids_j[y]]), return_inverse=True)
                for p, q in _spanning(len(both), edge[: len(x)], edge[len(x) :]):
                    a_rows.append(int(both[p]))
                    b_rows.append(int(both[q]))
                    adds.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(a_rows, pa.int64()), pa.array(b_rows, pa.int64()), pa.array(adds, pa.int64())], names=["a", "b", "n"])

    return run


def _spanning(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a small graph."""
    parent, out = list(range(n)), []

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        a, b = root(p), root(q)
        if a != b:
            parent[b] = a
            out.append((p, q))
    return out


def near_vectors(vectors: DataFrame, least: float = 0.95, lattice: Lattice = Lattice(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:  # noqa: B008
    """Per row: key, n_links, component_id, kept.

    Two rows are linked if their cosine in double precision is at least `least`.  Vectors that
    are null, zero or hold null or non-finite parts, and rows without a key, link with nothing;
    vectors of different lengths don't link.  A repeated row is another linked row.  An empty
    table gives an empty table; other columns aren't read.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.when(usable(F.col(vector)) & F.col(key).isNotNull(), F.col(vector).cast("array<double>")).alias("vec"))
    classes = scratch.write(rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("mult")))
    # a key with several vectors must still name one class each
    classes = scratch.write(classes.select("vec", "mult", F.col("rep").alias("least_id"), F.xxhash64("vec", "rep").alias("rep")))
    told = scratch.write(classes.select("rep", "vec").mapInArrow(_cells_of(lattice), "rep long, table long, cell long, looks boolean"))
    busy = told.groupBy("table", "cell").agg(F.count_if(~F.col("looks")).alias("stored"), F.count_if("looks").alias("looking"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("stored > 0 AND low <> high").drop("low", "high")
    size = F.lit(lattice.block_rows)
    parts = lambda c: F.ceil(F.col(c) / size)
    met = told.join(busy, ["table", "cell"]).select("table", "cell", "looks", "rep", parts("stored").alias("s"), parts("looking").alias("l"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.when(F.col("looks"), F.col("l")).otherwise(F.col("s"))))
    blocks = met.join(classes.select("rep", "mult", "vec"), "rep").groupBy("table", "cell", "looks", "block").agg(F.collect_list(F.struct("rep", "mult", "vec")).alias("members"), F.first("l").alias("l"))
    blocks = scratch.write(blocks)
    stored = blocks.where("NOT looks").select("table", "cell", F.col("members").alias("stored"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("l") - 1)).alias("block"))
    looking = blocks.where("looks").select("table", "cell", "block", F.col("members").alias("looking"))
    pairs = stored.join(looking, ["table", "cell", "block"]).select("table", "stored", "looking")
    found = scratch.write(pairs.mapInArrow(_compare(lattice, least), "a long, b long, n long"))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    reach = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
    joined = classes.join(reach.select(F.col("id").alias("rep"), F.col("component")), "rep", "left").join(links.select(F.col("a").alias("rep"), "n"), "rep", "left")
    joined = scratch.write(joined.select("vec", "least_id", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    names = joined.groupBy("component").agg(F.min("least_id").alias("name"))
    named = joined.join(names, "component").select("vec", "n_links", "name")
    out = rows.join(named, "vec", "left")
    name = F.coalesce("name", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.coalesce(F.col("id") == name, F.lit(False)).alias("kept"))


def oracle() -> str:
    """All pairs by brute force and the links' closure, over the table embeddings."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT vec_id, CAST((SELECT count(*) FROM p WHERE p.a = vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON id = vec_id
"""
