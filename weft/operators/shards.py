"""Phrases found in the texts of a shard in vectors: phrases.py's rules on many texts at once.

Texts are one array of code points. Pieces begin where the kind of character changes; what is compared is in lower case, white space as
one blank. A sum of powers, kept from the start on, gives the hash of any consecutive pieces. Hashes only say what may be equal:
a mention stands where all characters are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .sentences import text_bytes

WORD, SPACE, OTHER = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Bits of the filter of phrases' first pieces, and of a shard's own.
_BITS, _OWN_BITS = 27, 20
#: Bytes of texts that are worked on at a time.
_BYTES = 4_000_000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point the kind and the lower case, if that is one character."""
    kind, low = np.full(0x110000, OTHER, np.uint8), np.arange(0x110000, dtype=np.uint32)
    every = [chr(c) for c in range(0x110000)]
    kind[[c for c, x in enumerate(every) if x.isalnum() or x == "_"]] = WORD
    kind[[ord(x) for x in re.findall(r"[^\S\x1c-\x1f]", "".join(every))]] = SPACE
    for c, x in enumerate(every):
        if len(y := x.lower()) == 1 and y != x:
            low[c] = ord(y)
    return kind, low


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            each = np.full(max(n, 1 << 20), base, np.uint64)
            each[0] = 1
            _powers[k] = np.cumprod(each)
    return _powers


def _sums(points: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power(len(points) + 1)[0][: len(points)])))


def _hashed(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the code points of each stretch."""
    h = (sums[end] - sums[begin]) * _power(len(sums))[1][begin]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _steps(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    off = _starts(sizes)
    return np.repeat(begins - off[:-1], sizes) + np.arange(off[-1])


def distinct(x: np.ndarray) -> np.ndarray:
    """Each value once, in order (np.unique hashes first, which takes longer for as many values)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]]


def _points(texts) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The code points of an Arrow array of strings, where each text begins, with the end of all, and the bytes."""
    import pyarrow.compute as pc

    data = text_bytes(texts)[0].tobytes()
    return np.frombuffer(data.decode().encode("utf-32-le"), np.uint32), _starts(pc.utf8_length(texts).to_numpy(zero_copy_only=False)), data


def hashes(texts) -> np.ndarray:
    """The hash of each whole string, as it is."""
    points, at, _ = _points(texts)
    return _hashed(_sums(points), at[:-1], at[1:]).view(np.int64)


class Cut:
    """Texts cut into pieces. begin: where each piece begins in the texts' code points; at: in what is compared; first: the first piece of each text; all with the end of all."""

    def __init__(self, texts):
        self.points, self.text, self.data = _points(texts)
        kinds, low = _tables()
        kind = kinds[self.points]
        starts = kind == OTHER
        starts[1:] |= kind[1:] != kind[:-1]
        starts[self.text[:-1][np.diff(self.text) > 0]] = True
        begin = np.flatnonzero(starts)
        self.kind, self.begin = kind[begin], np.append(begin, len(self.points))
        self.first = np.searchsorted(begin, self.text)
        self.end = np.repeat(self.first[1:], np.diff(self.first))  # of each piece's text
        space = self.kind == SPACE
        keys = low[self.points]
        keys[begin[space]] = 32
        sizes = np.where(space, 1, np.diff(self.begin))
        keys = keys[starts | (kind != SPACE)]
        # the lower case of a word with a sigma rests on its place in the word, that of I with a dot is two characters
        hard = np.unique(np.searchsorted(begin, np.flatnonzero((self.points == 0x3A3) | (self.points == 0x130)), side="right") - 1)
        if len(hard):
            words = [np.frombuffer(self.points[a:b].tobytes().decode("utf-32-le").lower().encode("utf-32-le"), np.uint32) for a, b in zip(self.begin[hard], self.begin[hard + 1])]
            plain = np.ones(len(sizes), bool)
            plain[hard] = False
            was = _starts(sizes)
            sizes[hard] = list(map(len, words))
            new = np.empty(int(sizes.sum()), np.uint32)
            at = _starts(sizes)
            new[_steps(at[:-1][plain], sizes[plain])] = keys[_steps(was[:-1][plain], sizes[plain])]
            new[_steps(at[:-1][hard], sizes[hard])] = np.concatenate(words)
            keys = new
        self.keys, self.at = keys, _starts(sizes)
        self.sums = _sums(keys)

    def hashes(self, i: np.ndarray, n: int) -> np.ndarray:
        """The hash of n pieces from each on."""
        return _hashed(self.sums, self.at[i], self.at[i + n])


def pieces_of(texts) -> Iterator[slice]:
    """Slices of texts of bounded size, or of one."""
    import pyarrow.compute as pc

    total, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _BYTES, side="right")))
        yield slice(at, end)
        at = end


def shape_code(kinds) -> int:
    """Kinds of pieces as a number: digits of four behind a one."""
    code = 1
    for k in kinds:
        code = code * 4 + int(k)
    return code


class Filter:
    """What may be the first pieces of a phrase: their shapes, and a bit for each part of the hashes. words, bits: the 64-bit words that aren't zero."""

    def __init__(self, shapes: set[int], words: np.ndarray, bits: np.ndarray):
        self.shapes = shapes
        self.bits = np.zeros(1 << (_BITS - 6), np.int64)
        self.bits[words] = bits

    def standing(self, texts, lead: int) -> np.ndarray:
        """The hashes of all that may be first pieces in the texts, each once."""
        cut = Cut(texts)
        code, found = np.ones(len(cut.kind), np.int64), []
        i = np.arange(len(cut.kind))
        for n in range(1, lead + 1):
            some = i + n <= cut.end[i]
            i, code = i[some], code[some]
            code = code * 4 + cut.kind[i + n - 1]
            own = [s for s in self.shapes if 4**n <= s < 4 ** (n + 1)]
            if own:
                h = cut.hashes(i[np.isin(code, own)], n)
                place = h >> np.uint64(64 - _BITS)
                found.append(h[(self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)).astype(np.int64)) & 1 > 0])
            longer = [s // 4 ** k for s in self.shapes for k in range(1, 2 * lead) if 4**n <= s // 4**k < 4 ** (n + 1)]
            on = np.isin(code, list(set(longer)))
            i, code = i[on], code[on]
        return distinct(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


class Table:
    """The phrases of a shard: what is compared of each, how many pieces it has, the hash of the first, and its value."""

    def __init__(self, keys, n: np.ndarray, first: np.ndarray, values):
        self.values = values
        self.points, self.at, _ = _points(keys)
        h = _hashed(_sums(self.points), self.at[:-1], self.at[1:])
        order = np.lexsort((h, n))
        h, n, first = h[order], n[order], first.view(np.uint64)[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (n[1:] != n[:-1])))[: len(h)]
        layer = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))  # of equal hashes each in a layer of its own
        self.groups, self.heads = [], np.zeros(1 << _OWN_BITS, bool)
        for size in np.unique(n):
            for k in np.unique(layer[n == size]):
                own = np.flatnonzero((n == size) & (layer == k))
                heads = np.zeros(1 << _OWN_BITS, bool)
                heads[first[own] >> np.uint64(64 - _OWN_BITS)] = True
                self.heads |= heads
                self.groups.append((int(size), h[own], order[own], heads))

    def mentions(self, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, n, phrase): where mentions stand, leftmost-longest, in order."""
        begin, found = np.flatnonzero(cut.kind != SPACE), []
        head = cut.hashes(begin, 1) >> np.uint64(64 - _OWN_BITS)
        some = self.heads[head]
        begin, head = begin[some], head[some]
        for n, h, phrase, heads in self.groups:
            i = begin[heads[head]]
            i = i[i + n <= cut.end[i]]
            own = cut.hashes(i, n)
            at = np.minimum(np.searchsorted(h, own), len(h) - 1)
            some = h[at] == own
            i, own = i[some], phrase[at[some]]
            size = cut.at[i + n] - cut.at[i]
            some = size == self.at[own + 1] - self.at[own]
            i, own, size = i[some], own[some], size[some]
            same = cut.keys[_steps(cut.at[i], size)] == self.points[_steps(self.at[own], size)]
            some = np.add.reduceat(same, _starts(size)[:-1]) == size if len(size) else np.zeros(0, bool)
            found.append((i[some], np.full(int(some.sum()), n), own[some]))
        i, n, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
        order = np.lexsort((-n, i))
        i, n, own = i[order], n[order], own[order]
        longest = np.concatenate(([True], i[1:] != i[:-1]))[: len(i)]
        i, n, own = i[longest], n[longest], own[longest]
        end = i + n
        free = i >= np.concatenate(([0], np.maximum.accumulate(end)[:-1]))[: len(i)]
        before = np.maximum.accumulate(np.where(free, np.arange(len(i)), 0))
        group, upto = -1, 0
        for j in np.flatnonzero(~free).tolist():
            if before[j] != group:
                group = before[j]
                upto = end[group]
            if i[j] >= upto:
                free[j], upto = True, end[j]
        return i[free], n[free], own[free]

    def rewritten(self, texts, keep: bool):
        """The texts, in which none is null, with each mention's value in its place, or behind it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = Cut(texts)
        i, n, own = self.mentions(cut)
        width = 1 + (cut.points > 0x7F).astype(np.int64) + (cut.points > 0x7FF) + (cut.points > 0xFFFF)
        byte = _starts(width)
        begin, end, text = byte[cut.begin[i]], byte[cut.begin[i + n]], byte[cut.text]
        bounds = distinct(np.concatenate((text, begin, end)))
        segments = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(cut.data))
        order, at, off = np.arange(len(segments)), np.searchsorted(bounds, begin), np.searchsorted(bounds, text)
        value = len(segments) + np.arange(len(i))
        if keep:
            order, off = np.insert(order, at + 1, value), off + np.searchsorted(at, off)
        else:
            order[at] = value
        both = pa.concat_arrays([segments, self.values.take(pa.array(own))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), both.take(pa.array(order))), "")
