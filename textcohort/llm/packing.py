"""Mixture-controlled packing of token streams into fixed windows.

Every source is a queue of its documents' tokens, served in quanta by deficit round-robin: all
deficits grow in proportion to the target weights, a queue is served a quantum when its deficit
has reached one, and what a window can't take stays owed, across windows and partitions.  So the
k-th quantum of a queue is due at time k * quantum / weight, and the windows take the quanta in
the order of these times.  No state passes from window to window: quanta are sorted by their
times over all partitions, and a running sum of lengths, with the sums of the partitions before,
says where each one lies.  A queue that runs dry has no more quanta, and the others go on in
proportion.

Quanta and windows are powers of two, so no quantum is cut by a window's end.  What a queue has
beyond whole quanta is cut into powers of two too, and those come last, the largest first: they
fill up windows without a gap, and the very last tokens are windows of powers of two.  Nothing
is padded, and nothing grows with the number of sources but tables that are joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text, bpe
from ._spark import Scratch, broadcast_upto
from .tokens import DEFAULT_TOKENIZER

QUANTUM = 64
MAX_BROADCAST_ROWS = 1_000_000
NULL = "\0null"
ORDER = ["rest", "late", "due", "queue", "place"]


def tokenised(docs: DataFrame, path: str | None = None, end: int | None = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Token ids of whole texts, `end` appended: key, queue, part, before, n_tokens, ids (little-endian uint16 or uint32).

    part numbers the task; before counts the tokens of the same queue that the task had seen.
    """
    path = path or public_tokenizers.path(DEFAULT_TOKENIZER)

    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, seen = bpe.load(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            data, offsets = _text.utf8(batch.column(2))
            queues = batch.column(1).to_pylist()
            for i, j in _text.chunks(offsets):
                piece, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, _, number = model.encode(piece, own)
                ids = model.token_ids_of(number)
                upto = np.append(0, np.cumsum(model.counts[number], dtype=np.int64))
                cut = upto[np.searchsorted(starts, own)]
                if end is not None:
                    ids = np.insert(ids, cut[1:], end)
                    cut = cut + np.arange(len(cut))
                before = []
                for q, n in zip(queues[i:j], np.diff(cut).tolist(), strict=True):
                    before.append(seen.get(q, 0))
                    seen[q] = before[-1] + n
                wide = ids.dtype.itemsize
                packed = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((cut * wide).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(queues[i:j], pa.string()), pa.array(np.full(j - i, part, np.int64)), pa.array(before, pa.int64()), pa.array(np.diff(cut)), packed],
                    names=["key", "queue", "part", "before", "n_tokens", "ids"],
                )

    kind = docs.schema[key].dataType.simpleString()
    asked = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NULL)).alias("queue"), F.col(f"`{text}`").alias("text"))
    return asked.mapInArrow(run, f"key {kind}, queue string, part long, before long, n_tokens long, ids binary")


def cuts(place: np.ndarray, length: np.ndarray, total: np.ndarray, quantum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the queue intervals [place, place + length): row, start in it, length, and size of the quantum they lie in.

    total: tokens of the interval's queue.  Whole quanta come first; the rest of a queue is cut
    into powers of two, the largest first.
    """
    whole = total // quantum * quantum
    stop = place + length
    inside = np.minimum(stop, whole)  # where a row's part in whole quanta ends
    n = np.where(inside > place, (inside - 1) // quantum - place // quantum + 1, 0)
    row = np.repeat(np.arange(len(place)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    edge = (place[row] // quantum + nth) * quantum
    rows, starts, stops, sizes = [row], [np.maximum(edge, place[row])], [np.minimum(edge + quantum, inside[row])], [np.full(len(row), quantum)]
    size = quantum // 2
    edge = whole
    while size:
        has = (total & size) > 0
        first, last = np.maximum(edge, place), np.minimum(edge + size, stop)
        row = np.flatnonzero(has & (first < last))
        rows.append(row)
        starts.append(first[row])
        stops.append(last[row])
        sizes.append(np.full(len(row), size))
        edge = edge + np.where(has, size, 0)
        size //= 2
    row, start, stop, size = (np.concatenate(x) for x in (rows, starts, stops, sizes))
    order = np.lexsort((start, row))
    row = row[order]
    return row, start[order] - place[row], (stop - start)[order], size[order]


def _pieces(quantum: int, keep_ids: bool):
    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            place, length, total = (at[n].to_numpy(zero_copy_only=False) for n in ("place", "n_tokens", "total"))
            row, start, size, quantum_of = cuts(place, length, total, quantum)
            crc, own, of, tokens = np.zeros(len(row), np.int64), [], -1, b""
            for k, (r, a, n) in enumerate(zip(row.tolist(), (4 * start).tolist(), (4 * size).tolist(), strict=True)):
                if r != of:
                    of, raw = r, at["ids"][r].as_buffer()
                    tokens = memoryview(np.frombuffer(raw, np.uint16 if len(raw) == 2 * length[r] else np.uint32).astype("<u4").tobytes())
                crc[k] = zlib.crc32(tokens[a : a + n])
                if keep_ids:
                    own.append(bytes(tokens[a : a + n]))
            whose = pa.array(row)
            where = place[row] + start
            # the end of a quantum is when it is due; the rests of a queue are due in the order of their sizes
            due = np.where(quantum_of == quantum, (where // quantum + 1) * quantum, total[row]) / at["weight"].to_numpy(zero_copy_only=False)[row]
            out = [at["key"].take(whose), pa.array(start), pa.array(size), pa.array(crc), pa.array(length[row]), pa.array((quantum - quantum_of).astype(np.int64)), at["late"].take(whose), pa.array(due), at["queue"].take(whose), pa.array(where)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(own, pa.binary())] * keep_ids, names=["key", "start", "length", "ids_crc32", "doc_tokens", *ORDER] + ["ids"] * keep_ids)

    return run


@_text.released
def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and the tokens that it has had before each piece."""
    task, had = TaskContext.get().partitionId(), 0
    for batch in batches:
        length = batch.column(2).to_numpy(zero_copy_only=False)
        upto = had + np.cumsum(length)
        had = int(upto[-1]) if len(upto) else had
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), task, np.int64)), pa.array(upto - length)], names=[*batch.schema.names, "task", "within"])


def pack(docs: DataFrame, size: int = 1024, weights: dict[str, float] | None = None, path: str | None = None, key: str = "doc_id", text: str = "text", source: str = "source", keep_ids: bool = False, quantum: int = QUANTUM) -> DataFrame:
    """Pack all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    weights: target proportions of sources; without any, each source's share is that of its
    tokens, so that all end together.  A source that isn't named, or at 0, comes after all others,
    in proportion to its tokens.  size and quantum are powers of two.

    Each token of each document, with its end id, lies in one piece.  Null and empty texts are
    the end id alone; very long texts are cut like others; a null source is a queue of its own;
    quanta that are due at once come in the order of their sources' names; repeated rows and rows
    without a key are packed each; an empty table gives no pieces; other columns aren't read,
    whatever their names.  The pieces, without their tokens, are sorted by a range shuffle.
    """
    quantum = min(quantum, size)
    if size & (size - 1) or quantum & (quantum - 1) or quantum < 1:
        raise ValueError("size and quantum must be powers of two")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ids = scratch.write(tokenised(docs, path, key=key, text=text, source=source))
    parts = scratch.write(ids.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n")))
    total = parts.groupBy("queue").agg(F.sum("n").alias("total"))
    if weights:
        target = spark.createDataFrame([(q, float(w)) for q, w in weights.items() if w > 0], "queue string, target double")
        total = total.join(F.broadcast(target), "queue", "left").select("queue", "total", F.coalesce("target", F.col("total").cast("double")).alias("weight"), F.col("target").isNull().alias("late"))
    else:
        total = total.select("queue", "total", F.col("total").cast("double").alias("weight"), F.lit(False).alias("late"))
    base = parts.select("queue", "part", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))  # a row for each task that read the queue
    plan = base.join(total, "queue")
    kind = docs.schema[key].dataType.simpleString()
    columns = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, rest long, late boolean, due double, queue string, place long" + ", ids binary" * keep_ids
    joined = ids.join(broadcast_upto(plan, MAX_BROADCAST_ROWS), ["queue", "part"]).select("key", "queue", (F.col("base") + F.col("before")).alias("place"), "n_tokens", "total", "weight", "late", "ids")
    pieces = scratch.write(joined.mapInArrow(_pieces(quantum, keep_ids), columns))
    scratch.drop(ids)
    ordered = pieces.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).drop(*ORDER)
    columns = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    placed = scratch.write(ordered.mapInArrow(_running, columns + ", task long, within long"))
    scratch.drop(pieces)
    sums, before, tokens = sorted(placed.groupBy("task").agg(F.sum("length")).collect()), [], 0  # a row for each task
    for task, n in sums:
        before.append((task, tokens))
        tokens += n
    at = F.col("before") + F.col("within")
    full, rest = divmod(tokens, size)
    number, first = F.floor(at / size), F.floor(at / size) * size
    start = full * size
    for k, b in enumerate(x for x in reversed(range(size.bit_length())) if rest >> x & 1):
        number, first = F.when(at >= start, full + k).otherwise(number), F.when(at >= start, start).otherwise(first)
        start += 1 << b
    out = placed.join(F.broadcast(spark.createDataFrame(before, "task long, before long")), "task")
    return out.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", number.cast("long").alias("sequence_id"), (at - first).cast("long").alias("offset"), *(["ids"] if keep_ids else []))
