"""Weighted character n-gram vectors of words and names, and the cosines that compare them.

Vectors are sparse and binary but for one weight; each kind of n-grams is hashed into SLOTS places. A word's vector holds its bigrams and, without regard to order, its bigrams and trigrams (so two swapped letters cost little); n-grams
at the start of the word weigh START times the others. A name of two words is the tensor product of its words' vectors: the cosine of
two such products is the product of the cosines of their words, so names that share one word only are as good as orthogonal. Names
of other numbers of words (run together, cut apart) are the product of their two halves. Words may come in either order.

Weights by document frequency were tried and separate worse: n-grams made by slips are rare and would weigh most.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

START = 1.5
#: Names run together whose cosine is below this have halves that differ by more.
APART = 0.4
#: Slots into which the n-grams of each kind are hashed.
SLOTS = 256

#: The n-grams, and those at the start, as bits of numbers; the length of the vector.
Vector = tuple[int, int, float]


class _Bits(dict):
    """The bits of each two, or each three, letters met so far."""

    def __missing__(self, key: str) -> int:
        c = list(map(ord, key))
        low = sorted(c)
        if len(c) == 2:
            bits = 1 << (c[0] * 31 + c[1]) % SLOTS | 1 << SLOTS + (low[0] * 31 + low[1]) % SLOTS
        else:
            bits = 1 << 2 * SLOTS + (low[0] * 961 + low[1] * 31 + low[2]) % SLOTS
        if len(self) < 100_000:
            self[key] = bits
        return bits


_bits = _Bits()


def vector(text: str) -> Vector:
    """Of a text whose ends are marked ^ and $ by the caller."""
    bits = first = 0
    n = len(text)
    for i in range(n - 1):
        bits |= _bits[text[i : i + 2]]
    for i in range(n - 2):
        bits |= _bits[text[i : i + 3]]
    if text[:1] == "^" and n > 1:
        first = _bits[text[:2]] | (_bits[text[:3]] if n > 2 else 0)
    return bits, first, sqrt(bits.bit_count() + (START - 1) * first.bit_count())


def cosine(a: Vector, b: Vector) -> float:
    if not a[2] or not b[2]:
        return 0.0
    return ((a[0] & b[0]).bit_count() + (START - 1) * (a[1] & b[1]).bit_count()) / (a[2] * b[2])


def letters(word: str) -> str:
    """Syllables of Hangul as their letters, so that a slip changes a part of them only."""
    return word if word.isascii() else unicodedata.normalize("NFD", word)


@lru_cache(80_000)
def word_vector(word: str) -> Vector:
    return vector(f"^{letters(word)}$")


@lru_cache(10_000)
def halves(joined: str) -> tuple[Vector, Vector]:
    s = f"^{letters(joined)}$"
    h = (len(s) + 1) // 2
    return vector(s[: h + 1]), vector(s[h - 1 :])


@lru_cache(50_000)
def _parts(core: str) -> tuple:
    """The vectors of the words of a name of two, else its words."""
    v = core.split()
    return (word_vector(v[0]), word_vector(v[1])) if len(v) == 2 else (v,)


#: What products of floats may be off by.
SLACK = 1e-9


def name_cosine(core1: str, core2: str, least: float = 0.0) -> float:
    """The cosine of two names, given as words separated by blanks; 1 for equal ones, 0 if one is empty. One below `least` may be given as 0."""
    if core1 == core2:
        return 1.0 if core1 else 0.0
    x, y = _parts(core1), _parts(core2)
    if len(x) == 2 and len(y) == 2:
        (a, b), (c, d) = x, y
        p, q = cosine(a, c), cosine(a, d)  # a product is at most each of its factors
        p = p * cosine(b, d) if p > least - SLACK else 0.0
        return max(p, q * cosine(b, c)) if q > least - SLACK and q > p - SLACK else p
    v, w = core1.split(), core2.split()
    if cosine(word_vector("".join(v)), word_vector("".join(w))) < APART:
        return 0.0
    best = 0.0
    for s in {"".join(v), "".join(sorted(v)), "".join(v[::-1])}:
        for t in {"".join(w), "".join(sorted(w))}:
            if s == t:
                return 1.0
            (a, b), (c, d) = halves(s), halves(t)
            best = max(best, cosine(a, c) * cosine(b, d))
    return best


class Vectors:
    """vector() of many texts of at least three characters (two, if none starts with a mark). starts: whether all of them start with ^, or none does."""

    def __init__(self, texts: list[str], starts: bool = True) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        row = np.repeat(np.arange(len(texts)), size)
        c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        grid = np.zeros((len(texts), 3 * SLOTS), bool)
        x, y, z = c[:-2], c[1:-1], c[2:]
        a, b = c[:-1], c[1:]
        pair, either = (a * 31 + b) % SLOTS, SLOTS + (np.minimum(a, b) * 31 + np.maximum(a, b)) % SLOTS
        low, high = np.minimum(np.minimum(x, y), z), np.maximum(np.maximum(x, y), z)
        triple = 2 * SLOTS + (low * 961 + (x + y + z - low - high) * 31 + high) % SLOTS
        two, three = np.flatnonzero(row[:-1] == row[1:]), np.flatnonzero(row[:-2] == row[2:])
        for places, own in ((pair, two), (either, two), (triple, three)):
            grid[row[own], places[own]] = True
        #: The n-grams as rows of 64-bit numbers, those at the start by their places, the lengths.
        self.bits = np.packbits(grid, axis=1).view(np.uint64)
        at = np.cumsum(size) - size
        self.first = np.stack([pair[at], either[at], triple[at]], axis=1) if starts else None
        self.norm = np.sqrt(np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64) + (START - 1) * 3 * starts)

    def cosines(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """cosine() of the texts at u and those at v."""
        common = np.bitwise_count(self.bits[u] & self.bits[v]).sum(axis=1, dtype=np.int64)
        if self.first is not None:
            common = common + (START - 1) * (self.first[u] == self.first[v]).sum(axis=1)
        return common / (self.norm[u] * self.norm[v])


def _encoded(x: pa.Array, y: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different values of two arrays, and where those of each are among them."""
    held = pa.concat_arrays([x, y]).dictionary_encode()
    at = held.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return held.dictionary.to_pylist(), at[: len(x)], at[len(x) :]


def _of_two_words(x: pa.Array, y: pa.Array, least: float) -> np.ndarray:
    words, u, v = _encoded(*(pc.split_pattern(z, " ").flatten() for z in (x, y)))
    of = Vectors([f"^{letters(w)}$" for w in words])
    a, b, c, d = u[::2], u[1::2], v[::2], v[1::2]
    p, q = of.cosines(a, c), of.cosines(a, d)
    out = np.zeros(len(p))
    k = np.flatnonzero(p > least - SLACK)
    out[k] = p[k] * of.cosines(b[k], d[k])
    k = np.flatnonzero((q > least - SLACK) & (q > out - SLACK))
    out[k] = np.maximum(out[k], q[k] * of.cosines(b[k], c[k]))
    return out


def _run_together(x: pa.Array, y: pa.Array) -> np.ndarray:
    names, u, v = _encoded(x, y)
    split = [n.split() for n in names]
    out = np.zeros(len(u))
    of = Vectors([f"^{letters(''.join(w))}$" for w in split])
    k = np.flatnonzero(of.cosines(u, v) >= APART)
    if not len(k):
        return out
    at: dict[str, int] = {}
    forms = np.zeros((len(names), 3), np.int64)  # as written, sorted, turned
    for i in np.unique(np.concatenate([u[k], v[k]])):
        w = split[i]
        forms[i] = [at.setdefault("".join(f), len(at)) for f in (w, sorted(w), w[::-1])]
    texts = [f"^{letters(f)}$" for f in at]
    front, back = Vectors([s[: (len(s) + 1) // 2 + 1] for s in texts]), Vectors([s[(len(s) + 1) // 2 - 1 :] for s in texts], False)
    for s in range(3):
        for t in range(2):
            f, g = forms[u[k], s], forms[v[k], t]
            out[k] = np.maximum(out[k], np.where(f == g, 1.0, front.cosines(f, g) * back.cosines(f, g)))
    return out


def name_cosines(cores1: pa.Array, cores2: pa.Array, least: float = 0.0) -> np.ndarray:
    """name_cosine() of each two names of a batch, none of them missing."""
    flag = lambda x: x.to_numpy(zero_copy_only=False)
    none = flag(pc.or_(pc.equal(cores1, ""), pc.equal(cores2, "")))
    out = np.where(flag(pc.equal(cores1, cores2)) & ~none, 1.0, 0.0)
    two = flag(pc.equal(pc.count_substring(cores1, " "), 1)) & flag(pc.equal(pc.count_substring(cores2, " "), 1))
    for own, f in ((two, lambda x, y: _of_two_words(x, y, least)), (~two, _run_together)):
        k = np.flatnonzero(own & ~none & (out < 1))
        if len(k):
            out[k] = f(cores1.take(pa.array(k)), cores2.take(pa.array(k)))
    return out


def words_cosine(words1: list[str], words2: list[str]) -> float:
    """Of two sets of words: the better of the whole run together and the mean over the words of the smaller set of their best partner's cosine, if that covers most letters of the larger."""
    if not words1 or not words2:
        return 0.0
    a, b = "".join(words1), "".join(words2)
    if a == b:
        return 1.0
    whole = cosine(word_vector(a), word_vector(b))
    if len(words1) == len(words2) == 1:
        return whole
    few, many = (words1, words2) if len(words1) <= len(words2) else (words2, words1)
    best = [max((cosine(word_vector(x), word_vector(y)), y) for y in many) for x in few]
    if sum(len(y) for y in {y for _, y in best}) >= 0.5 * sum(map(len, many)):
        whole = max(whole, sum(c for c, _ in best) / len(best))
    return whole


class _Slots(dict):
    """The bit of each two letters in a sketch."""

    def __missing__(self, key: str) -> int:
        a, b = sorted(map(ord, key))
        bit = 1 << (a * 31 + b) % 64
        if len(self) < 100_000:
            self[key] = bit
        return bit


_slots = _Slots()


def sketch(text: str) -> int:
    """64 slots into which the unordered bigrams of a text are hashed, as bits of a signed number."""
    out, s = 0, letters(text)
    for i in range(len(s) - 1):
        out |= _slots[s[i : i + 2]]
    return out - (1 << 64) if out >> 63 else out


@lru_cache(50_000)
def word_sketch(word: str) -> int:
    return sketch(f"^{word}$")


def sketches(core: list[str]) -> tuple[int, int]:
    """Of a name of two words those of its words; else that of the whole, and 0."""
    if len(core) == 2:
        return word_sketch(core[0]), word_sketch(core[1])
    return sketch("".join(core)), 0
