"""Language-model scores from n-gram tries in Elias-Fano code."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbering, lower_words, shared_dir, small_batches, stash, table, texts_of

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.6  # taken from the count of each stored bigram and trigram and given to the shorter context
LEAST_COUNTS = (1, 1)  # bigrams and trigrams seen less often are left to the shorter context, with their whole mass; 1 keeps all
CELL_BYTES = 16 << 20  # training text of one trie, on average
WORD_FILE = 1 << 20  # words of one file of the first level, on average
BLOCK_TOKENS = 3_000_000  # tokens that a counting task gathers before it sends counts
SCORED_BYTES = 6_000_000  # texts that are scored at once
SUCCESSOR_BITS, THIRD_BITS = 40, 32  # of the hash of a word's successor and of a pair's: n successors of a context hide a foreign word with chance n / 2**bits
NUMBERS = 1 << 21  # of words in a block that one 64-bit key of three holds
END, BEGIN = b"\n", b"\r"  # no word holds white space


# ---------------------------------------------------------------- Elias-Fano code
_BYTES = np.uint64(0x0101010101010101)
_FIVES, _THREES, _NIBBLES, _TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x80))
#: Place of the k-th set bit of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.uint64)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with the number of ones and zeros before each word.

    get(i) and find(x) read a few words each; nothing is built when a file is opened, all five arrays may be memory-mapped.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, nulls: np.ndarray) -> None:
        """low: packed uint64 words; high: unary high parts, uint64 words; ones, nulls: uint32, one more than high has words."""
        self.n, self.low_bits, self.low, self.high, self.ones, self.nulls = n, low_bits, low, high, ones, nulls

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        marks = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(marks[-1]) if n else 0) + 2
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[marks] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            rest = values & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, rest << shift)
            over = (at & 63) + low_bits > 64
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        nulls = np.arange(len(ones), dtype=np.int64) * 64 - ones
        return n, low_bits, low, high, ones.astype(np.uint32), nulls.astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        return cls(*cls.parts(np.asarray(values)))
    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = shift > 0
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    @staticmethod
    def _bit(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) set bit of each word: its byte by running counts of all eight bytes at once, then a table."""
        k = k.astype(np.uint64)
        with np.errstate(over="ignore"):
            s = words - ((words >> np.uint64(1)) & _FIVES)
            s = (s & _THREES) + ((s >> np.uint64(2)) & _THREES)
            s = ((s + (s >> np.uint64(4))) & _NIBBLES) * _BYTES
            byte = (((((k * _BYTES) | _TOPS) - s) & _TOPS) >> np.uint64(7)) * _BYTES >> np.uint64(56)
            at = byte << np.uint64(3)
            before = ((s << np.uint64(8)) >> at) & np.uint64(255)
        return (at + _IN_BYTE[((words >> at) & np.uint64(255)) << np.uint64(3) | (k - before)]).astype(np.int64)

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i.astype(np.uint32), "right") - 1
        return word * 64 + self._bit(np.asarray(self.high[word]), i - self.ones[word].astype(np.int64))

    def _select0(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.nulls, i.astype(np.uint32), "right") - 1
        return word * 64 + self._bit(~np.asarray(self.high[word]), i - self.nulls[word].astype(np.int64))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        i = np.asarray(i, np.int64)
        return ((self._select1(i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at positions i and i + 1, as signed numbers: the next one of the unary code is near, as a rule in the same word."""
        bit = self._select1(i)
        first = ((bit - i) << self.low_bits) | self._low(i).astype(np.int64)
        word, later = bit >> 6, (bit & 63) + 1
        rest = np.where(later < 64, self.high[word] >> (later & 63).astype(np.uint64), np.uint64(0))
        second = bit + 1 + self._bit(rest, np.zeros(len(i), np.int64))
        none = rest == 0
        if none.any():
            second[none] = self._select1(i[none] + 1)
        return first, ((second - i - 1) << self.low_bits) | self._low(i + 1).astype(np.int64)

    def find(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Position of x in [begin, end), where the sequence is strictly increasing; -1 where it is not there.

        The successor of x is among the values with its high part, which the unary code finds at once.
        """
        x = np.asarray(x, np.uint64)
        part = (x >> np.uint64(self.low_bits)).astype(np.int64)
        out = np.full(len(x), -1, np.int64)
        live = np.flatnonzero(part < int(self.nulls[-1]))
        p = part[live]
        bit = np.zeros(len(live), np.int64)  # where the ones of this high part begin
        later = p > 0
        bit[later] = self._select0(p[later] - 1) + 1
        i = bit - p
        want = (x & np.uint64((1 << self.low_bits) - 1))[live]
        begin, end = begin[live], end[live]
        for _ in range(2):  # a run of equal high parts holds one or two values as a rule
            one = self.high[np.minimum(bit >> 6, len(self.high) - 1)] >> (bit & 63).astype(np.uint64) & np.uint64(1)
            go = np.flatnonzero((one == 1) & (bit >> 6 < len(self.high)) & (i < end))
            live, p, bit, i, want, begin, end = live[go], p[go], bit[go], i[go], want[go], begin[go], end[go]
            value = self._low(i)
            hit = (value == want) & (i >= begin)
            out[live[hit]] = i[hit]
            go = np.flatnonzero(~hit & ((value < want) | (i < begin)))
            live, p, bit, i, want, begin, end = live[go], p[go], bit[go] + 1, i[go] + 1, want[go], begin[go], end[go]
        low, high = np.maximum(i, begin), np.minimum(self._select0(p) - p, end)
        while len(live):  # bisection in the longer ones
            go = np.flatnonzero(low < high)
            live, low, high, want = live[go], low[go], high[go], want[go]
            mid = (low + high) // 2
            value = self._low(mid)
            hit = value == want
            out[live[hit]] = mid[hit]
            low, high = np.where(value < want, mid + 1, low), np.where(value < want, high, mid)
            go = np.flatnonzero(~hit)
            live, low, high, want = live[go], low[go], high[go], want[go]
        return out


# ---------------------------------------------------------------- files of arrays
def packed(arrays: list[np.ndarray], sequences: list[np.ndarray]) -> bytes:
    """A file of arrays and of increasing sequences in Elias-Fano code, each at a multiple of eight bytes."""
    flat, numbers = [], []
    for seq in sequences:
        n, low_bits, *words = EliasFano.parts(seq)
        numbers += [n, low_bits]
        flat += words
    flat += arrays
    head = struct.pack(f"<{2 + len(numbers) + len(flat)}q", len(sequences), len(arrays), *numbers, *(x.nbytes for x in flat))
    out = [b"EFT2\0\0\0\0", head]
    for x in flat:
        out += [x.tobytes(), bytes(-x.nbytes % 8)]
    return b"".join(out)


def unpacked(data: np.ndarray, kinds: list[type]) -> tuple[list[EliasFano], list[np.ndarray]]:
    """Sequences and arrays of the given kinds as views of a file's bytes, which may be a memory map."""
    data = np.asarray(data)
    m, k = struct.unpack_from("<qq", data, 8)
    numbers = struct.unpack_from(f"<{2 * m + 4 * m + k}q", data, 24)
    at, views = 24 + 8 * len(numbers), []
    for size in numbers[2 * m :]:
        views.append(data[at : at + size])
        at += size + (-size % 8)
    sequences = []
    for i in range(m):
        low, high, ones, nulls = views[4 * i : 4 * i + 4]
        sequences.append(EliasFano(numbers[2 * i], numbers[2 * i + 1], low.view(np.uint64), high.view(np.uint64), ones.view(np.uint32), nulls.view(np.uint32)))
    return sequences, [v.view(t) for v, t in zip(views[4 * m :], kinds)]


# ---------------------------------------------------------------- probabilities of one byte, rests of two
_STEPS = np.r_[np.exp2(-np.arange(255) / 8), 0.0]


def code_of(p: np.ndarray) -> np.ndarray:
    """The code of the greatest step, an eighth of an octave apart, that is not above p; 255 stands for 0."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.ceil(-np.log2(p) * 8 - 1e-9), 255).astype(np.uint8)


def probability(codes: np.ndarray) -> np.ndarray:
    return _STEPS[codes]


WORD_REST = PAIR_REST = 65535  # parts in which the share that a word, and a pair of words, leaves to the shorter context is told


def rest_code(rest: np.ndarray, parts: int) -> np.ndarray:
    """What a context leaves to the shorter one, in parts of which it has one at least: no word is impossible."""
    return np.clip(np.rint(rest * parts), 1, parts).astype(np.uint16)


# ---------------------------------------------------------------- one trie
def relative(hashes: np.ndarray, bits: int = SUCCESSOR_BITS) -> np.ndarray:
    """A successor's number within a context, from 1 on."""
    return (hashes >> np.uint64(64 - bits)) + np.uint64(1)


def increasing(rel: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers within contexts made relative to the end of the context before, so that the level is one increasing sequence."""
    if not len(rel):
        return rel
    last = rel[np.cumsum(sizes)[sizes > 0] - 1]
    total = np.cumsum(last, dtype=np.uint64)
    if (total[1:] < total[:-1]).any():
        raise OverflowError("a trie holds too many contexts; make CELL_BYTES smaller")
    return rel + np.repeat(np.r_[np.zeros(1, np.uint64), total[:-1]], sizes[sizes > 0])


class Trie:
    """Words u; their successors v; the successors w of (u, v).

    Each level is one increasing sequence, monotone pointers give a context's part of it. A bigram has the byte code of its
    discounted share of u's tokens in this trie, of which the first level has the exact number; a trigram that of its
    discounted share of (u, v); a context (u, v) has the share that it leaves to v.
    """

    KINDS = [np.uint8, np.uint16, np.uint8]

    def __init__(self, data: np.ndarray) -> None:
        (self.words, self.totals, self.pointers, self.seconds, self.pointers3, self.thirds), (self.codes, self.rests, self.codes3) = unpacked(data, self.KINDS)

    @staticmethod
    def _spans(pointers: EliasFano, level: EliasFano, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, number before) of each context's part of a level."""
        begin, end = pointers.both(context)
        base = np.zeros(len(context), np.uint64)
        some = np.flatnonzero((begin < end) & (begin > 0))
        base[some] = level.get(begin[some] - 1)
        return begin, end, base

    @staticmethod
    def _within(level: EliasFano, spans: tuple[np.ndarray, np.ndarray, np.ndarray], successor: np.ndarray) -> np.ndarray:
        """Place in the level of each successor's number in a context's span; -1 if not there."""
        begin, end, base = spans
        out = np.full(len(successor), -1, np.int64)
        some = np.flatnonzero(begin < end)
        if len(some):
            with np.errstate(over="ignore"):
                out[some] = level.find(base[some] + successor[some], begin[some], end[some])
        return out

    def bigrams(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of (u, v) in the second level or -1, its discounted count) of hashes; u is ordered."""
        at, count = np.full(len(u), -1, np.int64), np.zeros(len(u))
        if self.words.n:
            first = groups(u)  # a word's part is looked up once
            zero = np.zeros(len(first), np.int64)
            word = self.words.find(u[first], zero, zero + self.words.n)
            known = np.flatnonzero(word >= 0)
            spans = self._spans(self.pointers, self.seconds, word[known])
            before, upto = self.totals.both(word[known])
            times = np.diff(np.r_[first, len(u)])[known]
            own = np.repeat(first[known] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            place = self._within(self.seconds, tuple(np.repeat(x, times) for x in spans), relative(v[own]))
            at[own] = place
            hit = place >= 0
            count[own[hit]] = probability(self.codes[place[hit]]) * np.repeat(upto - before, times)[hit]
        return at, count

    def spans(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each context (u, v), a place in the second level, its part of the third."""
        return self._spans(self.pointers3, self.thirds, context)

    def trigrams(self, spans: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
        """Discounted probability of w within each span of the third level; 0 if not stored."""
        out = np.zeros(len(w))
        if self.thirds.n:
            at = self._within(self.thirds, spans, relative(w, THIRD_BITS))
            out[at >= 0] = probability(self.codes3[at[at >= 0]])
        return out


def groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def trie_bytes(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, least: tuple[int, int] = LEAST_COUNTS) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(file, words, their tokens, their stored mass in 2**-20 tokens) of counted trigrams, distinct and sorted; w = 0 stands for none."""
    first2 = groups(u, v)
    u2, v2, n2 = u[first2], v[first2], np.add.reduceat(n, first2) if len(n) else n
    number2 = np.repeat(np.arange(len(u2)), np.diff(np.r_[first2, len(u)]))
    first1 = groups(u2)
    words, totals = u2[first1], np.add.reduceat(n2, first1) if len(n2) else n2
    number1 = np.repeat(np.arange(len(words)), np.diff(np.r_[first1, len(u2)]))
    kept2 = n2 >= least[0]
    kept3 = (w != 0) & (n >= least[1]) & kept2[number2]
    codes3 = code_of((n[kept3] - DISCOUNT) / n2[number2[kept3]])
    rests = rest_code(1 - np.bincount(number2[kept3], weights=probability(codes3), minlength=len(u2)), PAIR_REST)[kept2]
    codes = code_of((n2[kept2] - DISCOUNT) / totals[number1[kept2]])
    mass = np.bincount(number1[kept2], weights=probability(codes), minlength=len(words)) * totals
    sizes2 = np.bincount(number1[kept2], minlength=len(words))
    place = np.cumsum(kept2) - 1
    sizes3 = np.bincount(place[number2[kept3]], minlength=int(kept2.sum()))
    edges = lambda sizes: np.r_[0, np.cumsum(sizes)].astype(np.int64)
    sequences = [words, edges(totals), edges(sizes2), increasing(relative(v2[kept2]), sizes2), edges(sizes3), increasing(relative(w[kept3], THIRD_BITS), sizes3)]
    return packed([codes, rests, codes3], sequences), words, totals, np.rint(mass * (1 << 20)).astype(np.int64)


# ---------------------------------------------------------------- counting
_CUT = np.uint64((1 << 64) - (1 << (64 - SUCCESSOR_BITS)))
_TAIL = SUCCESSOR_BITS // 8


class Grid:
    """Tries by the leading bits of the first word's hash (rows) and of the second's (columns): a word's contexts are spread over a row."""

    def __init__(self, bits: int) -> None:
        self.columns = max(1, bits // 2)
        self.rows = max(1, bits - self.columns)

    @property
    def size(self) -> int:
        return 1 << (self.rows + self.columns)

    def cell(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            column = ((v & _CUT) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.columns)
        return ((u >> np.uint64(64 - self.rows)) << np.uint64(self.columns) | column).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Null ids have no remainder and are trained on."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def numbered(data: bytes, number: Numbering) -> np.ndarray:
    """Numbers of BEGIN, the words and END of a text."""
    words = lower_words(data)
    return np.fromiter(map(number.__getitem__, (BEGIN, *words, END)), np.int64, len(words) + 2)


def tails(hashes: np.ndarray) -> np.ndarray:
    """Hashes cut to SUCCESSOR_BITS, 0 kept for `none`."""
    cut = hashes & _CUT
    return np.where(cut == 0, np.uint64(1 << (64 - SUCCESSOR_BITS)), cut)


def by_bytes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones, ...: leading bytes of small or ordered numbers repeat."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_bytes(data: bytes, kind: type, count: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8, count * width, at).reshape(width, count)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def trigrams_packed(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted trigrams: distinct first words, the distinct words behind them, and by their numbers the seconds of each first word and the thirds of each pair; counts."""
    two, one = groups(u, v), groups(u)
    behind, number = np.unique(np.concatenate([v[two], w]), return_inverse=True)
    tail = behind.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_TAIL].tobytes()
    kind = np.uint16 if len(behind) <= 1 << 16 else np.uint32
    seconds = np.diff(np.r_[np.searchsorted(two, one), len(two)])
    thirds = np.diff(np.r_[two, len(u)])
    sizes = np.concatenate([seconds, thirds, np.minimum(n, 0xFFFFFFFF)]).astype(np.uint32)
    rest = zlib.compress(by_bytes(sizes) + by_bytes(number.astype(kind)), 1)
    return struct.pack("<qqqq", len(one), len(two), len(u), len(behind)) + u[one].tobytes() + tail + rest


def trigrams_unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ones, twos, n, words = struct.unpack_from("<qqqq", data, 0)
    at = 32
    u = np.frombuffer(data, np.uint64, ones, at)
    at += 8 * ones
    wide = np.zeros((words, 8), np.uint8)
    wide[:, :_TAIL] = np.frombuffer(data, np.uint8, words * _TAIL, at).reshape(words, _TAIL)
    behind = wide.view(">u8").ravel().astype(np.uint64)
    rest = zlib.decompress(data[at + words * _TAIL :])
    sizes = from_bytes(rest, np.uint32, ones + twos + n, 0)
    number = from_bytes(rest, np.uint16 if words <= 1 << 16 else np.uint32, twos + n, 4 * len(sizes))
    thirds = sizes[ones : ones + twos]
    return np.repeat(np.repeat(u, sizes[:ones]), thirds), np.repeat(behind[number[:twos]], thirds), behind[number[twos:]], sizes[ones + twos :].astype(np.int64)


def merged(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal trigrams summed, sorted."""
    order = np.lexsort((v | w >> np.uint64(SUCCESSOR_BITS), u)) if v.dtype == np.uint64 else np.lexsort((w, v, u))
    u, v, w, n = u[order], v[order], w[order], n[order]
    if v.dtype == np.uint64 and ((u[1:] == u[:-1]) & (v[1:] == v[:-1]) & (w[1:] < w[:-1])).any():  # thirds that agree in their leading bits
        order = np.lexsort((w, v, u))
        u, v, w, n = u[order], v[order], w[order], n[order]
    first = groups(u, v, w)
    return u[first], v[first], w[first], np.add.reduceat(n, first) if len(first) else n


def counted(ids: np.ndarray, number: Numbering) -> tuple[np.ndarray, ...]:
    """Distinct trigrams (hashes u, v, w) of consecutive texts and their counts; after an END stands none, so that every bigram counts."""
    hashes = number.hashes()
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    begin, end = rank[number[BEGIN]], rank[number[END]]
    hashes, ids = hashes[order], rank[ids]  # so that trigrams of numbers are ordered as those of hashes
    last = len(hashes)  # stands for none
    third = np.r_[ids[2:], last]
    u, v, w = ids[:-1], ids[1:], np.where(ids[1:] == end, last, third)
    real = v != begin
    u, v, w = u[real], v[real], w[real]
    if last < NUMBERS:
        keys, n = np.unique((u.astype(np.uint64) << np.uint64(42)) | (v.astype(np.uint64) << np.uint64(21)) | w.astype(np.uint64), return_counts=True)
        low = np.uint64((1 << 21) - 1)
        u, v, w = (x.astype(np.int64) for x in (keys >> np.uint64(42), keys >> np.uint64(21) & low, keys & low))
    else:
        u, v, w, n = merged(u, v, w, np.ones(len(u), np.int64))
    cut = np.r_[tails(hashes), np.uint64(0)]
    return hashes[u], cut[v], cut[w], n


def trigram_blocks(texts: DataFrame, grid: Grid) -> DataFrame:
    """cell, trigrams: counts of the training texts, summed per task and sent packed, about 6 bytes a token, to the trie of their first two words."""

    def sent(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number, held, n = Numbering(), [], 0

        def flushed():
            nonlocal number, held, n
            u, v, w, c = counted(np.concatenate(held), number)
            cell = grid.cell(u, v)
            order = np.argsort(cell.astype(np.uint16) if grid.size <= 1 << 16 else cell, kind="stable")
            u, v, w, c, cell = u[order], v[order], w[order], c[order], cell[order]
            edges = np.r_[groups(cell), len(cell)]
            rows = [(int(cell[a]), trigrams_packed(u[a:b], v[a:b], w[a:b], c[a:b])) for a, b in zip(edges, edges[1:])]
            number, held, n = Numbering(), [], 0
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["cell", "trigrams"])

        for batch in batches:
            for data in texts_of(batch):
                held.append(numbered(data, number))
                n += len(held[-1])
                if n >= BLOCK_TOKENS:
                    yield flushed()
        if held:
            yield flushed()

    return texts.mapInArrow(sent, "cell int, trigrams binary")


def write_tries(blocks: DataFrame, grid: Grid, folder: str, least: tuple[int, int]) -> DataFrame:
    """word, n, mass of the tries' first levels, and a row (cell) for each trie written.

    A task merges the blocks of one trie at a time. An attempt writes under a name of its own and then moves the file into
    place; all attempts make the same bytes.
    """

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, held = None, []

        def written():
            data, words, totals, mass = trie_bytes(*merged(*map(np.concatenate, zip(*map(trigrams_unpacked, held)))), least)
            put(folder, f"cell-{now:08d}", data)
            cells = pa.array([now] + [None] * len(words), pa.int32())
            columns = [pa.array(np.r_[np.zeros(1, x.dtype), x].view(np.int64)) for x in (words, totals, mass)]
            return pa.RecordBatch.from_arrays([cells, *columns], ["cell", "word", "n", "mass"])

        for batch in batches:
            for cell, block in zip(batch.column("cell").to_pylist(), batch.column("trigrams").to_pylist()):
                if cell != now and held:
                    yield written()
                    held = []
                now = cell
                held.append(block)
        if held:
            yield written()

    return blocks.repartition(min(grid.size, 10_000), "cell").sortWithinPartitions("cell").mapInArrow(of, "cell int, word long, n long, mass long")


def write_words(words: DataFrame, bits: int, folder: str) -> list[int]:
    """Files of the words whose hashes begin alike: hashes and running counts in Elias-Fano code, the share each leaves to the unigrams."""

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, held, names = None, [], []

        def written():
            word, n, mass = (np.concatenate(x) for x in zip(*held))
            word = word.view(np.uint64)
            order = np.argsort(word)
            word, n, mass = word[order], n[order], mass[order]
            put(folder, f"words-{now:08d}", packed([rest_code(1 - mass / (1 << 20) / n, WORD_REST)], [word, np.r_[0, np.cumsum(n)]]))
            names.append(now)

        for batch in batches:
            part = batch.column("part").to_numpy()
            columns = [batch.column(c).to_numpy() for c in ("word", "n", "mass")]
            edges = np.r_[groups(part), len(part)]
            for a, b in zip(edges, edges[1:]):
                if part[a] != now and held:
                    written()
                    held = []
                now = int(part[a])
                held.append([x[a:b] for x in columns])
        if held:
            written()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32())], ["part"])

    part = F.shiftrightunsigned("word", 64 - bits).cast("int") if bits else F.lit(0)
    rows = words.select(part.alias("part"), "word", "n", "mass").repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(of, "part int")
    return [r[0] for r in rows.collect()]  # 2**bits numbers at most


# ---------------------------------------------------------------- files of the shared folder
def put(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    own = f"{base}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, f"{base}/{name}")


_open: OrderedDict[str, object] = OrderedDict()
MOST_MAPPED, MOST_READ = 4096, 16  # files that a worker holds open: mapped ones take no memory of its own


def opened(folder: str, name: str, kind):
    """A file of the shared folder: memory-mapped where that is a file system, read whole from other stores; the longest unused are closed."""
    path = f"{folder}/{name}"
    if path in _open:
        _open.move_to_end(path)
        return _open[path]
    local = path.removeprefix("file://").removeprefix("file:")
    mapped = folder.startswith("file:") and os.path.exists(local)
    if mapped:
        data = np.memmap(local, np.uint8, "r")
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{base}/{name}") as f:
            data = np.frombuffer(f.read(), np.uint8)
    while len(_open) >= (MOST_MAPPED if mapped else MOST_READ):
        _open.popitem(last=False)
    _open[path] = kind(data)
    return _open[path]


def word_file(data: np.ndarray) -> tuple[EliasFano, EliasFano, np.ndarray]:
    (words, counts), (rests,) = unpacked(data, [np.uint16])
    return words, counts, rests


class Model:
    """Where the tries and the words are, which of them there are, and the totals of the training tokens."""

    def __init__(self, folder: str, grid: Grid, cells: list[int], word_bits: int, parts: list[int], tokens: int, types: int) -> None:
        self.folder, self.grid, self.word_bits, self.tokens, self.types = folder, grid, word_bits, tokens, types
        self.there = self._bitmap(cells, grid.size)
        self.parts = self._bitmap(parts, 1 << word_bits)

    @staticmethod
    def _bitmap(numbers: list[int], size: int) -> np.ndarray:
        """A bit for each possible file; a missing file that should be there is an error."""
        out = np.zeros(size, bool)
        out[numbers] = True
        return np.packbits(out)

    @staticmethod
    def _in(bitmap: np.ndarray, number: int) -> bool:
        return bool(bitmap[number >> 3] >> (7 - (number & 7)) & 1)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, share left to the unigrams) of each word; 0 and 1 if unknown. hashes are sorted."""
        count, rest = np.zeros(len(hashes), np.int64), np.ones(len(hashes))
        part = (hashes >> np.uint64(64 - self.word_bits)).astype(np.int64) if self.word_bits else np.zeros(len(hashes), np.int64)
        edges = np.r_[groups(part), len(part)]
        for a, b in zip(edges[:-1], edges[1:]):
            if self._in(self.parts, int(part[a])):
                words, counts, rests = opened(self.folder, f"words-{part[a]:08d}", word_file)
                zero = np.zeros(b - a, np.int64)
                at = words.find(hashes[a:b], zero, zero + words.n)
                hit, at = np.flatnonzero(at >= 0) + a, at[at >= 0]
                count[hit] = (counts.get(at + 1) - counts.get(at)).astype(np.int64)
                rest[hit] = rests[at] / WORD_REST
        return count, rest

    def scored(self, texts: list[bytes]) -> list[np.ndarray]:
        """(tokens, known tokens, base score, score) of the texts, an array each.

        p(w | u, v) = stored(u, v, w) + rest(u, v) * p(w | v), where (u, v) is stored, else p(w | v); p(w | v) = stored(v, w) +
        rest(v) * base(w), where v is known, else base(w), the add-one unigram.
        """
        numbers = Numbering()
        ids = [numbered(x, numbers) for x in texts]
        hashes = numbers.hashes()
        order = np.argsort(hashes)  # words are renumbered by hash, so that lookups run through the files in their order
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes, flat = hashes[order], rank[np.concatenate(ids)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        begin, end = rank[numbers[BEGIN]], rank[numbers[END]]
        count, rest = self.words(hashes)
        seen = count.copy()
        seen[end], seen[begin] = count[begin], 0  # every text ends once; BEGIN is no token
        base = (seen + 1) / (self.tokens + self.types + 1)
        cut = tails(hashes)

        pairs, back = np.unique(flat[:-1].astype(np.uint64) << np.uint64(32) | flat[1:].astype(np.uint64), return_inverse=True)
        u, v = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place, stored, left = np.full(len(pairs), -1, np.int64), np.zeros(len(pairs)), np.ones(len(pairs))
        cell = self.grid.cell(hashes[u], cut[v])
        by_cell = np.argsort(cell, kind="stable")
        edges = np.r_[groups(cell[by_cell]), len(cell)]
        # a token's context is the pair before it; the first token has no such pair, its place in `third` is passed over
        third = np.zeros(len(flat) - 1)
        order_of = np.empty(len(pairs), np.int64)
        order_of[by_cell] = np.arange(len(pairs))
        asked = order_of[back[:-1]]
        by_context = np.argsort(asked, kind="stable")  # by trie, and within it by place
        asked = asked[by_context]
        for a, b in zip(edges[:-1], edges[1:]):
            number = int(cell[by_cell[a]])
            if not self._in(self.there, number):
                continue
            trie = opened(self.folder, f"cell-{number:08d}", Trie)
            own = by_cell[a:b]
            place[own], stored[own] = trie.bigrams(hashes[u[own]], cut[v[own]])
            hit = np.flatnonzero(place[own] >= 0)
            at = place[own[hit]]
            left[own[hit]] = trie.rests[at] / PAIR_REST
            begin3, end3, base3 = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), np.zeros(b - a, np.uint64)
            begin3[hit], end3[hit], base3[hit] = trie.spans(at)
            low, high = np.searchsorted(asked, (a, b))
            context = asked[low:high] - a
            some = np.flatnonzero(begin3[context] < end3[context])
            tokens, context = by_context[low:high][some], context[some]
            third[tokens + 1] = trie.trigrams((begin3[context], end3[context], base3[context]), cut[flat[tokens + 2]])
        p2 = np.where(count[u] > 0, stored / np.maximum(count[u], 1) + rest[u] * base[v], base[v])[back]
        p = p2.copy()
        p[1:] = third[1:] + np.where(place[back[:-1]] >= 0, left[back[:-1]], 1.0) * p2[1:]
        starts = np.r_[0, np.cumsum(lengths)[:-1]]  # of the texts in flat; flat[i + 1] is predicted at i
        first = starts.copy()
        p[first] = p2[first]
        log_p, log_base, known = np.log10(np.r_[p, 1.0]), np.log10(base[np.r_[flat[1:], 0]]), np.r_[seen[flat[1:]] > 0, False].astype(np.int64)
        for x in (log_p, log_base, known):
            x[starts[1:] - 1] = 0  # BEGIN after the END before it is no token
        log_base[-1] = 0
        sums = [np.add.reduceat(x, starts) for x in (known, log_base, log_p)]
        return [lengths - 1, *sums]


def train(texts: DataFrame, least: tuple[int, int] = LEAST_COUNTS, cell_bytes: int = CELL_BYTES) -> Model:
    """A trigram model of all the texts. Totals and one bit or number for each file reach the driver."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    grid = Grid(max(2, (size // cell_bytes).bit_length()))
    folder = shared_dir(spark)
    rows = stash(write_tries(trigram_blocks(texts, grid), grid, folder, least))
    words = stash(rows.where("cell IS NULL").groupBy("word").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")))
    cells = [r[0] for r in rows.where("cell IS NOT NULL").select("cell").collect()]
    tokens, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()  # BEGIN stands for END, which is as frequent and no context
    word_bits = (types // WORD_FILE).bit_length()
    return Model(folder, grid, cells, word_bits, write_words(words, word_bits, folder), tokens, types)


def score_documents(docs: DataFrame, least: tuple[int, int] = LEAST_COUNTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Learns from the rows that are not held out, all of them; repeated rows count as often as they are there. Null and empty texts
    are the one end token. Words are cut at ASCII white space, A-Z lower-cased. A very long text is counted and scored whole, by
    one task. Without any training text all words are unknown and the scores are of the uniform model. Rows of equal texts get
    equal scores. An empty table gives an empty one; extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(rows.where(~held_out(F.col("doc_id"))).select("text"), least)

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, texts, size = [], [], 0

        def flushed():
            n, known, base, score = model.scored(texts)
            arrays = [pa.concat_arrays(ids), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            begun = 0
            made = texts_of(batch)
            for i, data in enumerate(made, 1):
                texts.append(data)
                size += len(data)
                if size >= SCORED_BYTES:  # words and bigrams that repeat within these texts are looked up once
                    ids.append(batch.column("doc_id").slice(begun, i - begun))
                    yield flushed()
                    ids, texts, size, begun = [], [], 0, i
            if begun < len(made):
                ids.append(batch.column("doc_id").slice(begun))
        if texts:
            yield flushed()

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    scored = rows.mapInArrow(of, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
