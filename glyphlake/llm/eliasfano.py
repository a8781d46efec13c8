"""Elias-Fano sequences and an n-gram trie on them, in flat buffers that can be mapped into memory."""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np

U64 = np.uint64
#: Ranges of up to this many successors are read through, wider ones are searched.
NARROW = 4


def _short(x: np.ndarray) -> np.ndarray:
    """In 32 bits if they hold it."""
    return x.astype(np.uint32) if not len(x) or int(x[-1]) < 1 << 32 else x


class EliasFano:
    """A monotone sequence of unsigned integers: low bits packed, high bits in unary. Made by `of`, read from a buffer. What
    selects the unary part's zeros and ones is made when it is first searched, by one pass over it, and isn't stored."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @cached_property
    def starts(self) -> np.ndarray:
        """How many elements have a high part below each value: the ones before each zero of the unary part."""
        zeros = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little") == 0)
        return _short(np.concatenate(([0], zeros - np.arange(len(zeros)))))

    @cached_property
    def highs(self) -> np.ndarray:
        """The high part of each element: the zeros before each one of the unary part."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return _short(ones - np.arange(len(ones)))

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        high = (values >> U64(bits)).astype(np.int64)
        places = high + np.arange(n)
        size = (int(high[-1]) if n else 0) + n + 1
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[places] = 1
        low = np.zeros(-(-n * bits // 64) + 1, U64)
        if bits and n:
            part = values & U64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, off = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, part << off)
            over = (off.astype(np.int64) + bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - off[over]))
        return cls(n, bits, low, np.packbits(unary, bitorder="little").view(U64))

    def to_bytes(self) -> bytes:
        return struct.pack("<4q", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, buffer, at: int = 0) -> tuple[EliasFano, int]:
        n, bits, a, b = struct.unpack_from("<4q", buffer, at)
        at += 32
        low, high = np.frombuffer(buffer, U64, a, at), np.frombuffer(buffer, U64, b, at + 8 * a)
        return cls(n, bits, low, high), at + 8 * (a + b)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(U64)
        high = np.where(off > 0, self.low[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
        return ((self.low[word] >> off) | high) & U64((1 << self.low_bits) - 1)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, -1 where it isn't there: a successor search among the elements with the same high part, and
        of those among the elements [begin, end)."""
        x = np.asarray(x, U64)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        fits = np.flatnonzero((x >> U64(self.low_bits)) < U64(len(self.starts) - 1))
        h, low = (x[fits] >> U64(self.low_bits)).astype(np.int64), x[fits] & U64((1 << self.low_bits) - 1)
        lo, stop = self.starts[h].astype(np.int64), self.starts[h + 1].astype(np.int64)
        if begin is not None:
            lo, stop = np.maximum(lo, begin[fits]), np.minimum(stop, end[fits])
        hi = stop.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        inside = np.flatnonzero(lo < stop)
        hit = inside[self.lows(lo[inside]) == low[inside]]
        out[fits[hit]] = lo[hit]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements at indexes i, by the unary part's i-th one."""
        i = np.asarray(i, np.int64)
        return (self.highs[i].astype(U64) << U64(self.low_bits)) | self.lows(i)


def quantised(values: np.ndarray, levels: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1.. and a table of at most `levels` + 1 values (0 for code 0): each value itself if there are few, else bins of
    equal width in the logarithm, each by its mean log, so the error is at most half a bin's width."""
    book = np.zeros(levels + 1, np.float32)
    if not len(values):
        return np.zeros(0, np.uint8), book
    edges = np.unique(values)
    if len(edges) > levels:
        edges = np.exp(np.linspace(np.log(edges[0]), np.log(edges[-1]), levels + 1))[:-1]
        edges[0] = 0.0
    code = np.searchsorted(edges, values, side="right")
    total = np.bincount(code, weights=np.log(values), minlength=levels + 1)
    count = np.bincount(code, minlength=levels + 1)
    book[count > 0] = np.exp(total[count > 0] / count[count > 0])
    return code.astype(np.uint8), book


def mapped(data: bytes) -> np.ndarray:
    """Stored bytes as a memory map of a file that has no name any more: pages are read as they are searched, and nothing
    is left when the task ends."""
    import mmap
    import tempfile

    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)


class Trie:
    """Contexts, their counts, and their successors with smoothed probabilities, for the contexts of one shard: words, or
    n-grams of one length by their hashes.

    Level 1: context hashes (Elias-Fano), exact counts, quantised mass left for the lower order, and pointers into level 2
    (Elias-Fano): the running number of successors. Level 2: successors as ranks in the shard's own list of successor hashes,
    each added to the last value of the context before, so the level is monotone. A successor search for (context, word)
    takes the context's range from its two pointers and looks for the word's rank, made relative to that range, inside it.
    Level 2 has quantised discounted probabilities.
    """

    def __init__(self, words, counts, mass, pointers, successors, level, codes, mass_book, book):
        self.words, self.counts, self.mass, self.pointers, self.successors, self.level, self.codes, self.mass_book, self.book = words, counts, mass, pointers, successors, level, codes, mass_book, book

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, context: np.ndarray, word: np.ndarray, pair_counts: np.ndarray, discount: float) -> Trie:
        """words: sorted hashes with their counts; pairs (context: index into words, word: hash) sorted by context, then
        word, with counts above 0."""
        totals = np.bincount(context, weights=pair_counts, minlength=len(words))
        kinds = np.bincount(context, minlength=len(words))
        seen = totals > 0
        left = np.zeros(len(words))
        left[seen] = discount * kinds[seen] / totals[seen]
        mass = np.zeros(len(words), np.uint8)
        mass[seen], mass_book = quantised(left[seen])
        codes, book = quantised((pair_counts - discount) / totals[context] if len(context) else np.zeros(0))
        known = np.unique(word)
        rank = np.searchsorted(known, word)
        ends = np.cumsum(kinds)
        # each context adds its largest rank + 1 to those after it
        most = np.zeros(len(words), np.int64)
        most[kinds > 0] = rank[ends[kinds > 0] - 1] + 1
        level = (np.cumsum(most) - most)[context] + rank + 1 if len(context) else np.zeros(0, np.int64)
        return cls(EliasFano.of(words), np.asarray(counts, np.uint64), mass, EliasFano.of(ends), EliasFano.of(known), EliasFano.of(level), codes, mass_book, book)

    def to_bytes(self) -> bytes:
        parts = [self.words.to_bytes(), self.pointers.to_bytes(), self.successors.to_bytes(), self.level.to_bytes()]
        plain = [np.ascontiguousarray(x).tobytes() for x in (self.counts, self.mass_book, self.book, self.mass, self.codes)]
        return b"".join([struct.pack("<2q", len(self.counts), len(self.codes)), *parts, *plain])

    @classmethod
    def read(cls, buffer) -> Trie:
        """Over a buffer, such as a memory map, without copying it."""
        n, m = struct.unpack_from("<2q", buffer, 0)
        at, levels = 16, []
        for _ in range(4):
            level, at = EliasFano.read(buffer, at)
            levels.append(level)
        plain = []
        for kind, size in ((np.uint64, n), (np.float32, 256), (np.float32, 256), (np.uint8, n), (np.uint8, m)):
            plain.append(np.frombuffer(buffer, kind, size, at))
            at += plain[-1].nbytes
        counts, mass_book, book, mass, codes = plain
        return cls(levels[0], counts, mass, levels[1], levels[2], levels[3], codes, mass_book, book)

    def look(self, words: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words, and codes of the mass they leave as contexts (0: never a context). `at`: their places, if found."""
        at = self.words.find(words) if at is None else at
        there = at >= 0
        count, mass = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint8)
        count[there], mass[there] = self.counts[at[there]], self.mass[at[there]]
        return count, mass

    def follow(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the discounted probabilities of words after contexts (hashes); 0: not seen."""
        return self.fan(context, np.ones(len(context), np.int64), word, np.arange(len(word)))

    def fan(self, contexts: np.ndarray, children: np.ndarray, words: np.ndarray, which: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """As follow, for contexts that ask for `children` words each: words[which], one context after the other. What a
        context needs is looked up once. `at`: the contexts' places, if found."""
        c, w = self.words.find(contexts) if at is None else at, self.successors.find(words)
        there = np.flatnonzero(c >= 0)
        begin, end, base = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(len(c), U64)
        end[there] = self.pointers.get(c[there]).astype(np.int64)
        after = there[c[there] > 0]
        begin[after] = self.pointers.get(c[after] - 1).astype(np.int64)
        later = np.flatnonzero((begin > 0) & (end > begin))
        base[later] = self.level.get(begin[later] - 1)
        owner, rank = np.repeat(np.arange(len(c)), children), w[which]
        code = np.zeros(len(owner), np.uint8)
        ask = np.flatnonzero((rank >= 0) & (end > begin)[owner])
        owner = owner[ask]
        lo, hi, wanted = begin[owner], end[owner], base[owner] + rank[ask].astype(U64) + U64(1)
        at = np.full(len(ask), -1, np.int64)
        wide = np.flatnonzero(hi - lo > NARROW)
        at[wide] = self.level.find(wanted[wide], lo[wide], hi[wide])
        # a few successors are compared one after the other
        left = np.flatnonzero(hi - lo <= NARROW)
        for k in range(NARROW):
            left = left[lo[left] + k < hi[left]]
            value = self.level.get(lo[left] + k)
            hit = value == wanted[left]
            at[left[hit]] = lo[left[hit]] + k
            left = left[value < wanted[left]]
        code[ask[at >= 0]] = self.codes[at[at >= 0]]
        return code
