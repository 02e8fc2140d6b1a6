"""Byte-level BPE by prefix dynamic programming.

For every prefix of a pretoken the last token of the prefix's own encoding is the one
suffix token that can follow the encoding of what precedes it: a sequence is a BPE
encoding exactly if each adjacent pair of it is what BPE makes of the pair's text.  So
`last[i]` follows from `last[i - length]`, and `count[i] = count[i - length] + 1` holds
the exact token count of each prefix without encoding any prefix again.

The vocabulary and merges are read from a tokenizer's JSON file; nothing is trained.
Pretokens are found on the UTF-8 bytes by character class.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from ._interner import Interner
from ._text import BYTE_VALUE, U64, Hasher, finish, mix64, powers

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Unicode White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LONG_WORD = 48
MAX_WORDS = 1_500_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Character class of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(maxsize=1)
def _ascii_classes() -> np.ndarray:
    return classes()[:128].copy()


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 bytes and where each starts."""
    if not len(data) or data.max() < 128:
        return data.astype(np.int32), np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    out = lead.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        which = np.flatnonzero((lead >= low) & (lead < (0xE0, 0xF0, 0x100)[more - 1]))
        if len(which):
            value = lead[which] & keep
            for j in range(1, more + 1):
                value = value << 6 | (padded[at[which] + j] & 0x3F)
            out[which] = value
    return out, at


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pretokens of all rows, in order.

    Runs of letters, of numbers and of other marks are pretokens and take one preceding
    space; white space before them keeps its last character apart; 's 't 're 've 'm 'll
    'd are split off where an apostrophe begins a pretoken.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points, at = code_points(data)
    kind = classes()[points] if len(at) != len(data) else _ascii_classes()[points]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = first[at]
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
    begin[after - 1] = True
    begin[after[points[after - 1] == 32]] = False
    mark = np.flatnonzero((points == 39) & begin)
    if len(mark):
        n = len(points)
        ends = np.append(first, [True] * 4)  # no contraction reaches into the next row
        wide = np.append(points, [0] * 4)
        one = wide[mark + 1]
        short = ~ends[mark + 1] & np.isin(one, [ord(c) for c in "stmd"])
        two = wide[mark + 2]
        long = ~ends[mark + 1] & ~ends[mark + 2] & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        begin[mark[short | long] + 1] = False
        begin[mark[long] + 2] = False
        for which, skip in ((mark[short], 2), (mark[long], 3)):
            which = which[which + skip < n] + skip
            begin[which] = True
    starts = at[begin]
    return starts, np.append(starts[1:], len(data))


def _unicode_bytes() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = _unicode_bytes()
        raw = lambda s: bytes(stand_in[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: raw(t) for t, i in vocab.items()}
        self.ids = {b: i for i, b in self.bytes.items()}
        self.rank, self.parts = {}, {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = (vocab[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            self.rank[a, b] = r
            self.parts.setdefault(self.ids[self.bytes[a] + self.bytes[b]], (a, b, r))
        self.lengths = sorted({len(b) for b in self.ids}, reverse=True)
        self.length_of = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            self.length_of[i] = len(b)
        flat = np.frombuffer(b"".join(self.ids), np.uint8)
        ends = np.cumsum([len(b) for b in self.ids])
        self.tokens = Interner(18)
        self.tokens.add(Hasher(flat)(np.append(0, ends[:-1]), ends))
        self.token_ids = np.fromiter(self.ids.values(), np.int64, len(self.ids))
        self.pairs, self.pair_ok = Interner(18), np.zeros(1 << 16, bool)
        self._left, self._right = {}, {}
        self._forget()

    # ----- which token may follow which

    def _spine(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """Pieces at one edge of a token while BPE builds it: piece, from rank, until rank."""
        known = (self._left, self._right)[side]
        if token not in known:
            out, until = [], float("inf")
            piece = token
            while True:
                made = self.parts.get(piece)
                out.append((piece, made[2] if made else -1, until))
                if not made:
                    break
                piece, until = made[side], made[2]
            known[token] = out
        return known[token]

    def follows(self, u: int, t: int) -> bool:
        """Whether BPE turns the text of u and t into just u and t.

        It doesn't if two pieces that lie side by side at the border at some time merge
        before either becomes part of a larger piece; the left of two equal merges goes first.
        """
        left, right = self._spine(u, 1), self._spine(t, 0)
        i, j = len(left) - 1, len(right) - 1
        while True:
            a, _, a_until = left[i]
            b, _, b_until = right[j]
            r = self.rank.get((a, b))
            if r is not None and r < a_until and r <= b_until:
                return False
            if i == 0 and j == 0:
                return True
            if a_until <= b_until:
                i -= 1
            else:
                j -= 1

    def _allowed(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        keys = mix64((u.astype(U64) << U64(32)) + t.astype(U64) + U64(1))
        at = self.pairs.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, where = np.unique(keys[new], return_index=True)
            number = self.pairs.add(fresh)
            if self.pairs.size > len(self.pair_ok):
                self.pair_ok = np.append(self.pair_ok, np.zeros(max(len(self.pair_ok), self.pairs.size), bool))
            self.pair_ok[number] = [self.follows(x, y) for x, y in zip(u[new[where]].tolist(), t[new[where]].tolist(), strict=True)]
            at[new] = self.pairs.find(keys[new])
        return self.pair_ok[at]

    # ----- the dynamic programme

    def _many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """last and count of every prefix of words of at most LONG_WORD bytes, longest word first."""
        size = ends - starts
        most, rows = int(size[0]), len(starts)
        last, count = np.full((most + 1, rows), -1, np.int32), np.zeros((most + 1, rows), np.int32)
        up, down = powers(most + 1)
        prefix = np.zeros((most + 1, rows), U64)
        for i in range(1, most + 1):
            some = int(np.searchsorted(-size, -i, "right"))
            np.add(prefix[i - 1, :some], BYTE_VALUE[data[starts[:some] + (i - 1)]] * up[i - 1], out=prefix[i, :some])
            open_ = np.arange(some)
            for n in range(i, 0, -1):
                part = (prefix[i, open_] - prefix[i - n, open_]) * down[i - n] if n < i else prefix[i, :some].copy()
                number = self.tokens.find(finish(part, n))
                hit = np.flatnonzero(number >= 0)
                if len(hit):
                    t = self.token_ids[number[hit]]
                    if n < i:
                        ok = self._allowed(last[i - n, open_[hit]], t)
                        hit, t = hit[ok], t[ok]
                    rows_ = open_[hit]
                    last[i, rows_] = t
                    count[i, rows_] = count[i - n, rows_] + 1
                    keep = np.ones(len(open_), bool)
                    keep[hit] = False
                    open_ = open_[keep]
                    if not len(open_):
                        break
        return last, count

    def one(self, word: bytes) -> tuple[list[int], list[int]]:
        """last and count of every prefix of one word of any length."""
        last, count = [-1], [0]
        for i in range(1, len(word) + 1):
            for n in self.lengths:
                if n <= i and (t := self.ids.get(word[i - n : i])) is not None and (n == i or self.follows(last[i - n], t)):
                    last.append(t)
                    count.append(count[i - n] + 1)
                    break
        return last, count

    # ----- words seen so far

    def _forget(self) -> None:
        self.words = Interner(18)
        self.counts = np.zeros(1 << 17, np.int32)
        self.begins = np.zeros((1 << 17) + 1, np.int64)
        self.flat = np.zeros(1 << 19, np.uint16 if len(self.length_of) <= 1 << 16 else np.uint32)
        if self.special:  # their strings are words of one token each
            names = [s.encode() for s in self.special]
            ends = np.cumsum([len(x) for x in names])
            self.words.add(Hasher(np.frombuffer(b"".join(names), np.uint8))(np.append(0, ends[:-1]), ends))
            n = len(names)
            self.counts[:n], self.begins[1 : n + 1], self.flat[:n] = 1, np.arange(1, n + 1), list(self.special.values())

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Encode distinct new words and keep their ids."""
        order = np.argsort(starts - ends, kind="stable")
        starts, ends, keys = starts[order], ends[order], keys[order]
        size = ends - starts
        n_long = int(np.searchsorted(-size, -LONG_WORD, "left"))
        counts, parts = np.zeros(len(starts), np.int32), []
        for k in range(n_long):
            last, count = self.one(data[starts[k] : ends[k]].tobytes())
            ids, i = [], len(last) - 1
            while i:
                ids.append(last[i])
                i -= len(self.bytes[last[i]])
            counts[k] = count[-1]
            parts.append(np.array(ids[::-1], self.flat.dtype))
        for a in range(n_long, len(starts), 40_000):
            s, e = starts[a : a + 40_000], ends[a : a + 40_000]
            last, count = self._many(data, s, e)
            n = count[e - s, np.arange(len(s))]
            counts[a : a + len(s)] = n
            put, flat = np.cumsum(n), np.zeros(int(n.sum()), self.flat.dtype)
            rows, where, to = np.arange(len(s)), e - s, put.copy()
            while len(rows):
                t = last[where, rows]
                to -= 1
                flat[to] = t
                where = where - self.length_of[t]
                go = where > 0
                rows, where, to = rows[go], where[go], to[go]
            parts.append(flat)
        number = self.words.add(keys)
        old, new = int(number[0]), int(number[-1]) + 1
        if new > len(self.counts):
            grow = max(len(self.counts), new)
            self.counts, self.begins = np.append(self.counts, np.zeros(grow, np.int32)), np.append(self.begins, np.zeros(grow, np.int64))
        self.counts[old:new] = counts
        base = int(self.begins[old])
        self.begins[old + 1 : new + 1] = base + np.cumsum(counts)
        end = int(self.begins[new])
        if end > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(max(len(self.flat), end), self.flat.dtype))
        self.flat[base:end] = np.concatenate(parts)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each pretoken's word; its tokens are counts[number], begins and flat."""
        if self.words.size > MAX_WORDS:
            self._forget()
        hasher = Hasher(data)
        keys = hasher(starts, ends)
        keys[keys == 0] = 1
        at = self.words.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, where = np.unique(keys[new], return_index=True)
            self._learn(data, starts[new[where]], ends[new[where]], fresh)
            at[new] = self.words.find(keys[new])
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and word numbers of the pretokens of all rows.

        Strings of special tokens become these tokens, as the library does by default.
        """
        found = []
        if self.special and (text := data.tobytes()) and any(s.encode() in text for s in self.special):
            pattern = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True)))
            found = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in pattern.finditer(text, a, b)]
        if not found:
            starts, ends = pretokens(data, offsets)
            return starts, ends, self.numbers(data, starts, ends)
        cut = np.array(found)
        starts, _ = pretokens(data, np.unique(np.concatenate([offsets, cut.ravel()])))
        inside = np.searchsorted(cut[:, 0], starts, "left") - 1  # the last special string that begins before
        starts = starts[(inside < 0) | (starts >= cut[np.maximum(inside, 0), 1])]
        ends = np.append(starts[1:], len(data))
        return starts, ends, self.numbers(data, starts, ends)

    def token_ids_of(self, number: np.ndarray) -> np.ndarray:
        """Token ids of pretokens, one after the other."""
        n = self.counts[number].astype(np.int64)
        total = int(n.sum())
        if not total:
            return np.zeros(0, self.flat.dtype)
        return self.flat[np.arange(total) + np.repeat(self.begins[number] - (np.cumsum(n) - n), n)]


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    return PrefixBpe(path)
