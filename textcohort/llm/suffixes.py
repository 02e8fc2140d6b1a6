"""Removing passages that repeat across documents, exactly and at any scale.

A byte goes if it lies in a string of `least` bytes that also starts in a document with a
smaller key.  Documents are grouped in chunks of a few megabytes, the shards of the input.

1. Every such string contains a rarest gram: the least hash among its k-grams.  Runs of
   strings with one such anchor are told by the anchor's hash; each chunk sorts its distinct
   hashes and deals them to buckets, where the chunks' arrays are merged by binary search.
   Only anchors that two different texts have can matter.
2. For these, the run's bytes are sent once per chunk and content, with the least key, to the
   shard of the anchor.  All copies of a string meet there.
3. A shard works through its anchors in parts of about a megabyte and keeps equal contents of
   a part once, with the least key.  It sorts their suffixes as Larsson and Sadakane do: by a
   few bytes, then, only within groups still equal, by the ranks of what follows at doubled
   distance.  Kasai's common
   prefixes of neighbours give the intervals of equal strings and each one's least key: what a
   suffix shares with its predecessor, less one byte, is carried to the suffix that begins one
   byte later.  Many places of the text are walked side by side, each one as far as LANE bytes.
4. The chunks look up their runs' answers and cut.

An anchor that very many chunks have doesn't go to one shard: its strings are sent one by one
to the shards of their own hashes.  Texts equal as a whole are found by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import Scratch
from ._text import U64, mix64

_GOLD = U64(0x9E3779B97F4A7C15)
_CODEC = "zstd"
_SECOND = mix64(np.arange(256, dtype=U64) + U64(7))
LANE = 64
BLOCK = 1 << 17  # bytes hashed at a time; bounds memory and fits caches
PARTS, PART_BYTES = 256, 2 << 20  # a shard's finest parts, and the bytes solved at a time


@dataclass(frozen=True)
class Plan:
    """least: bytes of a repeated string; gram: bytes of an anchor; hot: chunks that make an anchor hot."""

    least: int = 50
    gram: int = 20
    chunk_bytes: int = 3 << 20
    buckets: int = 2048
    bucket_bytes: int = 4 << 20
    hot: int = 1000


def _pack(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec(_CODEC).compress(raw, asbytes=True)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.Codec(_CODEC).decompress(raw[8:], size, asbytes=True) if size else b"", kind)


# ----- chunks


def _digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each row's text."""
    d1, d2 = np.empty(len(offsets) - 1, U64), np.empty(len(offsets) - 1, U64)
    for i, j in _text.chunks(offsets, BLOCK):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        hasher = _text.Hasher(part)
        d1[i:j] = hasher(at[:-1], at[1:])
        other = np.zeros(len(part) + 1, U64)
        np.cumsum(_SECOND[part] * hasher.down[: len(part)], out=other[1:])
        d2[i:j] = mix64((other[at[1:]] - other[at[:-1]]) * hasher.up[at[:-1]])
    return d1, d2


def _contents(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of slices in the order of their starts."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        a = int(starts[i])
        out[i:j] = _text.Hasher(data[a : int(ends[i:j].max())])(starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def _chunk(plan: Plan, schema: T.StructType):
    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, size
            tables = pa.Table.from_batches(held).combine_chunks()
            data, offsets = _text.utf8(tables.column(1))
            d1, d2 = _digests(data, offsets)
            rest = [tables.column(i).combine_chunks() for i in range(2, tables.num_columns)]
            rest = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in rest]
            extra = pa.StructArray.from_arrays(rest, names=tables.schema.names[2:]) if rest else pa.StructArray.from_arrays([pa.nulls(tables.num_rows, pa.int8())], names=["none"])
            one = pa.array([0, tables.num_rows], pa.int32())
            listed = lambda x: pa.ListArray.from_arrays(one, x)
            ids = tables.column(0).combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            out = [pa.array([part << 24 | seq], pa.int64()), listed(ids), listed(pa.array(np.diff(offsets))), listed(pa.array(d1.view(np.int64))), listed(pa.array(d2.view(np.int64))), listed(extra), pa.array([_pack(data)], pa.binary())]
            seq, held, size = seq + 1, [], 0
            return pa.RecordBatch.from_arrays(out, names=["uid", "ids", "sizes", "d1", "d2", "extra", "blob"])

        for batch in batches:
            _, offsets = _text.utf8(batch.column(1))
            for i, j in _text.chunks(offsets, plan.chunk_bytes):
                held.append(batch.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                if size >= plan.chunk_bytes // 2:
                    yield flush()
        if held:
            yield flush()

    return run


# ----- anchors


def anchors(data: np.ndarray, offsets: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first start, last start, hash.  A run ends at the latest where a block of BLOCK starts does."""
    n = len(data) - plan.least + 1
    found = [_block_anchors(data, offsets, plan, a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _block_anchors(data: np.ndarray, offsets: np.ndarray, plan: Plan, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of the strings that start from a to before b."""
    n, k = b - a, plan.gram
    part = data[a : b + plan.least - 1]
    hasher = _text.Hasher(part)
    low = mix64((hasher.prefix[k:] - hasher.prefix[:-k]) * hasher.down[: len(part) - k + 1])
    span, width = 1, plan.least - k + 1
    while span < width:
        s = min(span, width - span)
        low = np.minimum(low[:-s], low[s:])
        span += s
    rows = slice(max(int(np.searchsorted(offsets, a, "right")) - 1, 0), int(np.searchsorted(offsets, b, "left")))
    ends = offsets[1:][rows]
    end = np.repeat(ends, np.minimum(ends, b) - np.maximum(offsets[:-1][rows], a))
    whole = np.arange(a, b) + plan.least <= end  # the string lies in one row
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = (low[1:] != low[:-1]) | ~whole[:-1] | (end[1:] != end[:-1])
    starts = np.flatnonzero(begin & whole)
    stop = np.empty(n, bool)
    stop[-1] = True
    stop[:-1] = begin[1:] | ~whole[1:]
    # least hashes crowd at the low end; mixed again, they spread evenly over buckets and shards
    return starts + a, np.flatnonzero(stop & whole) + a, mix64(low[starts] ^ _GOLD)


def _texts(batch: pa.RecordBatch, r: int, at: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, keys and whether there is a key, of a chunk; rows without a key are left empty."""
    sizes = np.asarray(batch.column(at["sizes"])[r].values)
    ids = batch.column(at["ids"])[r].values
    data = _unpack(batch.column(at["blob"])[r].as_py(), "u1")
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    there = ~np.asarray(ids.is_null())
    return data, offsets, np.asarray(ids.fill_null(0)), there


def _runs_of(data, offsets, there, plan: Plan):
    start, last, mark = anchors(data, offsets, plan)
    row = _text.owners(start, offsets)
    if not there.all():
        ok = there[row]
        start, last, mark, row = start[ok], last[ok], mark[ok], row[ok]
    return start, last, mark, row


def _low5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _read5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _deal(plan: Plan, buckets: int):
    """Distinct anchors of each chunk, by bucket: low hash bytes, and low bytes of the text's digest (0: several texts)."""

    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                data, offsets, _, there = _texts(batch, r, at)
                digest = np.asarray(batch.column(at["d1"])[r].values).view(U64)
                _, _, mark, row = _runs_of(data, offsets, there, plan)
                order, first = _distinct(mark, buckets)
                text = digest[row[order]] & U64((1 << 40) - 1) | U64(1)
                same = np.minimum.reduceat(text, first) == np.maximum.reduceat(text, first) if len(first) else np.zeros(0, bool)
                who = np.where(same, text[first], U64(0))
                hashes = mark[order][first]
                edges = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array(np.full(len(full), batch.column(at["uid"])[r].as_py(), np.int64)), pa.array([_low5(hashes[edges[b] : edges[b + 1]]) for b in full], pa.binary()), pa.array([_low5(who[edges[b] : edges[b + 1]]) for b in full], pa.binary())],
                    names=["bucket", "uid", "hashes", "texts"],
                )

    return run


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _part(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of its bucket's PARTS a hash is in; grows with the hash."""
    return (((hashes >> U64(32)) * U64(buckets) & U64(0xFFFFFFFF)) * U64(PARTS) >> U64(32)).astype(np.uint8)


def _distinct(mark: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and where each distinct one begins in it."""
    order = np.argsort(mark, kind="stable")
    ranked = mark[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)


def _meet(plan: Plan):
    """Which of each chunk's anchors two different texts have (1), and which very many chunks have (2)."""

    def run(table: pa.Table) -> pa.Table:
        uids = table.column("uid").to_pylist()
        hashes = [_read5(x.as_buffer().to_pybytes()) for x in table.column("hashes")]
        texts = np.concatenate([_read5(x.as_buffer().to_pybytes()) for x in table.column("texts")])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        low, high = np.minimum.reduceat(texts[order], first), np.maximum.reduceat(texts[order], first)
        n = np.diff(np.append(first, len(ranked)))
        state = ((low != high) | (low == 0)).astype(np.uint8)
        state[(state > 0) & (n >= plan.hot)] = 2
        merged = ranked[first]
        bits = [state[np.searchsorted(merged, h)].tobytes() for h in hashes]
        return pa.table({"uid": pa.array(uids, pa.int64()), "bucket": table.column("bucket"), "bits": pa.array([pa.Codec(_CODEC).compress(b, asbytes=True) for b in bits], pa.binary()), "n": pa.array([len(b) for b in bits], pa.int64())})

    return run


# ----- runs sent to shards


def _send(plan: Plan, buckets: int):
    """Per chunk and shard the distinct contents of shared runs; shard -1: where the runs lie and which content each has."""

    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                data, offsets, ids, there = _texts(batch, r, at)
                uid = batch.column(at["uid"])[r].as_py()
                start, last, mark, row = _runs_of(data, offsets, there, plan)
                order, first = _distinct(mark, buckets)
                state = np.zeros(len(first), np.uint8)
                edges = np.searchsorted(_bucket(mark[order][first], buckets), np.arange(buckets + 1))
                told = batch.column(at["told"])[r].as_py() or []
                for x in told:
                    b = x["bucket"]
                    state[edges[b] : edges[b + 1]] = np.frombuffer(pa.Codec(_CODEC).decompress(x["bits"], x["n"], asbytes=True), np.uint8)
                mine = np.empty(len(mark), np.uint8)
                mine[order] = np.repeat(state, np.diff(np.append(first, len(order))))
                keep = mine > 0
                start, last, mark, row, mine = start[keep], last[keep], mark[keep], row[keep], mine[keep]
                hot = mine == 2
                if hot.any():  # one by one
                    n = np.where(hot, last - start + 1, 1)
                    index = np.repeat(np.arange(len(start)), n)
                    within = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
                    single = hot[index]
                    start = start[index] + np.where(single, within, 0)
                    last = np.where(single, start, last[index])
                    row = row[index]
                    mark = mark[index]
                    mark = np.where(single, _contents(data, start, start + plan.least), mark)
                content = _contents(data, start, last + plan.least)
                shard, part = _bucket(mark, buckets), _part(mark, buckets)
                rank = np.lexsort((ids[row], content, shard * PARTS + part))
                c, s, p = content[rank], shard[rank], part[rank]
                new = np.ones(len(rank), bool)
                new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1]) | (p[1:] != p[:-1])
                one = rank[new]  # the run of least key with each content
                number = np.empty(len(rank), np.int64)
                number[rank] = np.cumsum(new) - 1
                state_row = _pack(np.concatenate([start, last, number]).astype("<u4"))
                size = (last[one] + plan.least - start[one]).astype(np.int64)
                total = np.append(0, np.cumsum(size))
                flat = data[np.arange(int(total[-1])) + np.repeat(start[one] - total[:-1], size)] if len(one) else data[:0]
                cut = np.searchsorted(shard[one], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                keys = ids[row[one]].astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(full) + 1, uid, np.int64)),
                        pa.array(np.append(full, -1), pa.int64()),
                        pa.array(np.append(cut[full], 0), pa.int64()),
                        pa.array([_pack(size[cut[b] : cut[b + 1]].astype("<u4")) for b in full] + [b""], pa.binary()),
                        pa.array([_pack(part[one[cut[b] : cut[b + 1]]]) for b in full] + [b""], pa.binary()),
                        pa.array([_pack(keys[cut[b] : cut[b + 1]]) for b in full] + [b""], pa.binary()),
                        pa.array([_pack(flat[total[cut[b]] : total[cut[b + 1]]]) for b in full] + [state_row], pa.binary()),
                    ],
                    names=["uid", "shard", "first", "sizes", "parts", "keys", "blob"],
                )

    return run


def suffix_order(data: np.ndarray, wanted: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """wanted positions in the order of their first `least` bytes, and a number that equal ones share; each has as many bytes to its end.

    Sorted by the first bytes; then groups that are still equal are refined by the ranks at the
    doubled distance until `least` bytes are covered.
    """
    n = len(data)
    bits = n.bit_length()
    word = _words(data)
    if bits <= 24:  # five bytes and the position fit one number, which sorts faster than an index
        packed = np.sort(word >> U64(24) << U64(24) | np.arange(n, dtype=U64))
        order, changed, known = (packed & U64((1 << 24) - 1)).astype(np.int64), np.diff(packed >> U64(24)) != 0, 5
    else:
        order = np.argsort(word)
        changed, known = np.diff(word[order]) != 0, 8
    # a rank is the place of its group's first member, so refining a group leaves the others' ranks
    head = _heads(changed)
    rank = np.empty(n, np.int64)
    rank[order] = head
    while known < least:
        step = min(known, least - known)
        same = head[1:] == head[:-1]
        where = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(where):
            break
        open_ = order[where]
        follow = rank[np.minimum(open_ + step, n - 1)] + 1
        follow[open_ + step >= n] = 0
        key = head[where].astype(U64) << U64(bits) | follow.astype(U64)
        if 3 * bits <= 64:
            key = np.sort(key << U64(bits) | np.arange(len(key), dtype=U64))
            open_, key = open_[(key & U64((1 << bits) - 1)).astype(np.int64)], key >> U64(bits)
        else:
            sub = np.argsort(key)
            open_, key = open_[sub], key[sub]
        order[where] = open_
        head[where] = where[_heads(key[1:] != key[:-1])]
        rank[open_] = head[where]
        known += step
    mask = np.zeros(n, bool)
    mask[wanted] = True
    mask = mask[order]
    return order[mask], head[mask]


def _heads(changed: np.ndarray) -> np.ndarray:
    """For each member of a sorted sequence, the place of the first one equal to it."""
    starts = np.append(0, np.flatnonzero(changed) + 1)
    return np.repeat(starts, np.diff(np.append(starts, len(changed) + 1)))


def _words(data: np.ndarray, kind: str = ">u8") -> np.ndarray:
    """The eight bytes from each position on, zeros beyond the end, as numbers; big-endian ones sort as the bytes do."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data),), kind, padded.data, 0, (1,)).astype(U64)


def common_prefixes(data: np.ndarray, order: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each position in the order with the one before it, up to `most` bytes, by Kasai's carry.

    group: equal for positions whose first `most` bytes are equal.  A position is compared with
    the last one of the group before its own.  If the two differ after h < most bytes, the
    positions one byte later are in different groups in the same order, so the later one shares
    at least h - 1 bytes with what comes before it: only further bytes are compared.  Where the
    other one's successor isn't in the order, nothing is carried.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    before = np.repeat(np.append(-1, order[head[1:] - 1]), np.diff(np.append(head, n)))
    listed = np.zeros(len(data) + 1, bool)
    listed[order] = True
    place = np.flatnonzero(listed)
    slot = np.empty(len(data), np.int64)
    slot[order] = np.arange(n)
    slot = slot[place]  # of each place of the text, in the order
    other = before[slot]  # what each place is compared with
    carries = (other >= 0) & listed[other + 1]
    # lanes: runs of neighbouring places, at most LANE of them each, the longest ones first
    stop = np.append(np.flatnonzero(np.diff(place) != 1) + 1, n)
    first = np.append(0, stop[:-1])
    pieces = -(-(stop - first) // LANE)
    lane = np.repeat(first, pieces) + LANE * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    length = np.minimum(LANE, np.repeat(stop, pieces) - lane)
    by_length = np.argsort(-length)
    lane, length = lane[by_length], length[by_length]
    live = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # lanes longer than t
    word = _words(data, "<u8")
    shared, h = np.zeros(n, np.int64), np.zeros(len(lane), np.int64)
    for t, lanes in enumerate(live.tolist()):
        k = lane[:lanes] + t
        h = h[:lanes]
        i, j = place[k], other[k]
        x = word[i + h] ^ word[j + h]
        h += _same_bytes(x)
        todo = np.flatnonzero((x == 0) & (h < most))
        while len(todo):
            x = word[i[todo] + h[todo]] ^ word[j[todo] + h[todo]]
            h[todo] += _same_bytes(x)
            todo = todo[(x == 0) & (h[todo] < most)]
        np.minimum(h, most, out=h)
        shared[k] = h
        h = np.where(carries[k], np.maximum(h - 1, 0), 0)
    by_order = np.empty(n, np.int64)
    by_order[slot] = shared
    out = np.full(n, most, np.int64)
    out[head] = by_order[head]
    out[0] = 0
    return out


def _same_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the first, lowest, bytes of numbers are zero."""
    low = (x & (~x + U64(1))).astype(np.float64).view(np.int64)  # the lowest bit alone, a power of two
    return np.where(x == 0, 8, ((low >> 52) - 1023) >> 3)


def answers_of(data: np.ndarray, size: np.ndarray, keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of contents that a smaller key than the content's own has: content, first start, number, that key.

    Equal contents are sorted once: of them all, a string has the least key of any content it lies in.
    """
    begin = np.cumsum(size) - size
    _, one, of = np.unique(_contents(data, begin, begin + size), return_index=True, return_inverse=True)
    low = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(low, of, keys)
    if len(one) < len(size):
        short = size[one]
        data = data[np.arange(int(short.sum())) + np.repeat(begin[one] - (np.cumsum(short) - short), short)]
        size = short
        begin = np.cumsum(size) - size
    else:
        size, begin = size[one], begin[one]
    n = size - least + 1
    base = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(size)), n)
    within = np.arange(len(owner)) - np.repeat(base, n)
    wanted = begin[owner] + within
    order, group = suffix_order(data, wanted, least)
    equal = common_prefixes(data, order, group, least) >= least
    first = np.flatnonzero(~equal)
    text_of = np.empty(len(data), np.int64)
    text_of[wanted] = np.arange(len(wanted))
    index = text_of[order]
    least_key = np.empty(len(wanted), np.int64)
    least_key[index] = np.repeat(np.minimum.reduceat(low[owner[index]], first), np.diff(np.append(first, len(order))))
    new = np.ones(len(wanted), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (least_key[1:] != least_key[:-1])
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(wanted)))
    # each content takes the runs of the one that was sorted
    edge = np.searchsorted(starts, np.append(base, len(wanted)))
    runs = np.diff(edge)[of]
    content = np.repeat(np.arange(len(of)), runs)
    run = np.repeat(edge[of], runs) + np.arange(len(content)) - np.repeat(np.cumsum(runs) - runs, runs)
    key = least_key[starts[run]]
    told = key < keys[content]
    content, run, key = content[told], run[told], key[told]
    return content, within[starts[run]], length[run], key


def _solve(plan: Plan):
    """For each chunk's contents, the strings that a document with a smaller key than the content's own has."""

    def run(table: pa.Table) -> pa.Table:
        uids = table.column("uid").to_pylist()
        sizes = [_unpack(x.as_py(), "<u4").astype(np.int64) for x in table.column("sizes")]
        keys = np.concatenate([_unpack(x.as_py(), "<i8") for x in table.column("keys")])
        part = np.concatenate([_unpack(x.as_py(), "u1") for x in table.column("parts")])
        data = np.concatenate([_unpack(x.as_py(), "u1") for x in table.column("blob")])
        size = np.concatenate(sizes)
        begin = np.cumsum(size) - size
        by_part = np.argsort(part, kind="stable")
        # whole parts, as many as have PART_BYTES
        last = np.cumsum(np.bincount(part, weights=size, minlength=PARTS).astype(np.int64))
        edge, p = [0], 0
        while p < PARTS:
            p = max(p + 1, int(np.searchsorted(last, (last[p - 1] if p else 0) + PART_BYTES, "right")))
            edge.append(p)
        cut = np.searchsorted(part[by_part], np.array(edge[:-1]), "left").tolist() + [len(part)]
        found = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i == j:
                continue
            which = by_part[i:j]
            m = size[which]
            own = data[np.arange(int(m.sum())) + np.repeat(begin[which] - (np.cumsum(m) - m), m)]
            content, *rest = answers_of(own, m, keys[which], plan.least)
            found.append((which[content], *rest))
        content, start, length, low = (np.concatenate(x) for x in zip(*found, strict=True))
        by_content = np.argsort(content, kind="stable")
        content, start, length, low = content[by_content], start[by_content], length[by_content], low[by_content]
        first_of = np.asarray(table.column("first"))
        edge = np.append(0, np.cumsum([len(s) for s in sizes]))
        cut = np.searchsorted(content, edge)
        rows = [k for k in range(len(uids)) if cut[k] < cut[k + 1]]
        answer = []
        for k in rows:
            of = slice(cut[k], cut[k + 1])
            answer.append(_pack(np.concatenate([content[of] - edge[k] + first_of[k], start[of], length[of], low[of]]).astype("<i8")))
        return pa.table({"uid": pa.array([uids[k] for k in rows], pa.int64()), "answer": pa.array(answer, pa.binary())})

    return run


def _cut(plan: Plan, with_text: bool):
    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                data, offsets, ids, _ = _texts(batch, r, at)
                rows = len(offsets) - 1
                raw = batch.column(at["state"])[r].as_py()
                start, last, number = _unpack(raw, "<u4").astype(np.int64).reshape(3, -1) if raw else np.zeros((3, 0), np.int64)
                row = _text.owners(start, offsets)
                n = last - start + 1
                contents = int(number.max()) + 1 if len(number) else 0
                own = np.full(contents, np.iinfo(np.int64).max)
                np.minimum.at(own, number, ids[row])
                length = np.zeros(contents, np.int64)
                length[number] = n
                base = np.cumsum(length) - length
                least = np.repeat(own, length)
                for x in batch.column(at["answers"])[r].as_py() or []:
                    c, s, m, key = _unpack(x, "<i8").reshape(4, -1)
                    where = np.repeat(base[c] + s, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    least[where] = np.repeat(key, m)
                index = np.repeat(np.arange(len(start)), n)
                within = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
                hit = least[base[number[index]] + within] < ids[row[index]]
                place = (start[index] + within)[hit]
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, place, 1)
                np.add.at(change, place + plan.least, -1)
                gone = np.cumsum(change, out=change)[:-1] > 0
                for k in batch.column(at["copies"])[r].as_py() or []:
                    gone[offsets[k] : offsets[k + 1]] = True
                first, _ = _text.runs(gone, offsets)
                spans = np.bincount(_text.owners(first, offsets), minlength=rows) if len(first) else np.zeros(rows, np.int64)
                upto = np.zeros(len(data) + 1, np.int32)
                np.cumsum(gone, out=upto[1:])
                removed = np.diff(upto[offsets].astype(np.int64))
                kept = data[~gone].tobytes()
                edge = offsets - np.append(0, np.cumsum(removed))
                texts = [kept[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                out = [batch.column(at["extra"])[r].values] if with_text else []
                names = ["extra", "text"] if with_text else []
                if with_text:
                    out.append(pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string()))
                else:
                    out = [batch.column(at["ids"])[r].values, pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _cuts(docs: DataFrame, plan: Plan, key: str, text: str, with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    others = [c for c in docs.columns if c != text] if with_text else []
    # the table's own columns go by number, so that no name of theirs can clash
    inner = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(others)] if others else [T.StructField("none", T.ByteType())])
    schema = T.StructType([T.StructField("uid", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("ids", "sizes", "d1", "d2")), T.StructField("extra", T.ArrayType(inner)), T.StructField("blob", T.BinaryType())])
    asked = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    chunks = scratch.write(asked.mapInArrow(_chunk(plan, schema), schema), compression="uncompressed")
    # whole texts that a smaller key has
    whole = chunks.select("uid", F.explode(F.expr("transform(ids, (x, i) -> struct(x AS id, i AS i, sizes[i] AS size, d1[i] AS d1, d2[i] AS d2))")).alias("d")).select("uid", "d.*").where(F.col("id").isNotNull() & (F.col("size") >= plan.least))
    whole = scratch.write(whole)
    least = whole.groupBy("d1", "d2", "size").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high")
    copies = scratch.write(whole.join(least, ["d1", "d2", "size"]).where("id > low").groupBy("uid").agg(F.collect_list("i").alias("copies")))
    scratch.drop(whole)
    total = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(plan.buckets, total // plan.bucket_bytes)
    dealt = chunks.select("uid", "ids", "sizes", "d1", "blob").mapInArrow(_deal(plan, buckets), "bucket long, uid long, hashes binary, texts binary")
    told = scratch.write(dealt.groupBy("bucket").applyInArrow(_meet(plan), "uid long, bucket long, bits binary, n long"))
    by_chunk = told.groupBy("uid").agg(F.collect_list(F.struct("bucket", "bits", "n")).alias("told"))
    sent = chunks.select("uid", "ids", "sizes", "blob").join(by_chunk, "uid").mapInArrow(_send(plan, buckets), "uid long, shard long, first long, sizes binary, parts binary, keys binary, blob binary")
    state, sent = scratch.write_parts(sent.withColumn("is_state", F.col("shard") < 0), "is_state", compression="uncompressed")
    scratch.drop(told)
    state_table = state
    answers = answer_table = scratch.write(sent.groupBy("shard").applyInArrow(_solve(plan), "uid long, answer binary"))
    scratch.drop(sent)
    answers = answers.groupBy("uid").agg(F.collect_list("answer").alias("answers"))
    state = state.select("uid", F.col("blob").alias("state"))
    last = chunks.select("uid", "ids", "sizes", "extra", "blob").join(state, "uid", "left").join(answers, "uid", "left").join(copies, "uid", "left")
    if with_text:
        out = last.mapInArrow(_cut(plan, True), T.StructType([T.StructField("extra", inner), T.StructField("text", T.StringType())]))
        place = {c: i for i, c in enumerate(others)}
        out = out.select(*(F.col("text").alias(c) if c == text else F.col(f"extra.c{place[c]}").alias(c) for c in docs.columns))
    else:
        out = last.mapInArrow(_cut(plan, False), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = scratch.write(out)
    scratch.drop(chunks, copies, state_table, answer_table)
    return out


def repeated_passages(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay.

    Null and empty texts have no bytes; a row without a key keeps all and takes nothing from
    others; rows with equal keys don't take from each other, so of rows that tie all keep what
    they have first; very long texts are chunks of their own; an empty table gives an empty table;
    other columns aren't read, whatever their names.
    """
    out = _cuts(docs, plan, key, text, False)
    return out.withColumnRenamed("id", key) if key != "id" else out


def drop_repeated_passages(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """The rows with all their columns, of any names, and what stays of their texts; characters cut in part go too.

    Odd rows are treated as by `repeated_passages`; a null text comes back empty.
    """
    return _cuts(docs, plan, key, text, True)
