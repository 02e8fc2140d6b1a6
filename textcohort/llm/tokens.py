"""Token counts by prefix dynamic programming (see bpe.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text, bpe

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def _fit(model: bpe.PrefixBpe, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, limit: int, row_end: int) -> int:
    """Bytes of the longest prefix with at most `limit` tokens, from the counts of its prefixes."""
    upto = np.cumsum(counts)
    k = int(np.searchsorted(upto, limit, "right"))
    if k == len(counts):
        return row_end - int(starts[0]) if len(starts) else 0
    begin = int(starts[k])
    word = data[begin : ends[k]].tobytes()
    if word[:1] == b"'" and word[1:].isalpha() or word.decode() in model.special:
        return begin - int(starts[0])  # a cut contraction would be split differently
    spare = limit - (int(upto[k - 1]) if k else 0)
    _, count = model.one(word)
    after_space = word[:1] == b" " and begin > starts[0] and data[begin - 1 : begin].tobytes().isspace()
    for i in range(len(word) - 1, 1 if after_space else 0, -1):
        if count[i] <= spare and word[i] & 0xC0 != 0x80:
            return begin + i - int(starts[0])
    return begin - int(starts[0])


def prefix_counts(text: str | None, path: str | None = None) -> np.ndarray:
    """Token counts of all byte prefixes of a text, at every end of a code point.

    A prefix that ends in white space ends in one run of it, whatever follows in the text, and
    one that cuts a contraction ends in the apostrophe and a letter; both are counted as such.
    """
    model = bpe.load(path or public_tokenizers.path(DEFAULT_TOKENIZER))
    data, offsets = _text.utf8(pa.array([text or ""]))
    starts, ends, number = model.encode(data, offsets)
    out, done = np.zeros(len(data) + 1, np.int64), 0
    for s, e, k in zip(starts.tolist(), ends.tolist(), number.tolist(), strict=True):
        word = data[s:e].tobytes()
        if word.decode() in model.special:
            out[s + 1 : e + 1] = done + 1
        else:
            out[s + 1 : e + 1] = done + np.array(model.one(word)[1][1:])
            if word in (b"'re", b"'ve", b"'ll"):
                out[s + 2] = done + 2
        done += int(model.counts[k])
        out[e] = done
    points, at = bpe.code_points(data)
    first, stop = _text.runs(bpe.classes()[points] == bpe.SPACE, np.array([0, len(points)]))
    edge = np.append(at, len(data))
    for a, b in zip(edge[first].tolist(), edge[stop].tolist(), strict=True):
        out[a + 1 : b + 1] = out[a] + np.array(model.one(data[a:b].tobytes())[1][1:])
    return out


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact token counts of whole texts: key, n_bytes, n_tokens, over_limit, fit_bytes.

    fit_bytes is the length of the longest prefix of at most `limit` tokens, read from the
    prefix counts.  One output row per input row; null and empty texts have no bytes and no
    tokens; a text of just `limit` tokens isn't over it; very long texts are counted whole; rows
    without a key and repeated rows are counted each; an empty table gives an empty table; other
    columns, whatever their names, are not read.  No shuffle: each task works on its own rows
    and keeps at most bpe.MAX_WORDS words.
    """
    path = path or public_tokenizers.path(DEFAULT_TOKENIZER)

    @_text.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        for batch in batches:
            data, offsets = _text.utf8(batch.column(1))
            n_tokens, fit = np.zeros(batch.num_rows, np.int64), np.diff(offsets)
            for i, j in _text.chunks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, number = model.encode(part, own)
                counts = model.counts[number].astype(np.int64)
                upto = np.append(0, np.cumsum(counts))
                edge = np.searchsorted(starts, own)
                n_tokens[i:j] = np.diff(upto[edge])
                for r in np.flatnonzero(n_tokens[i:j] > limit).tolist():
                    at = slice(edge[r], edge[r + 1])
                    fit[i + r] = _fit(model, part, starts[at], ends[at], counts[at], limit, int(own[r + 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(fit)], names=[key, "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")
