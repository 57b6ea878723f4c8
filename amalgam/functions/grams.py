"""Counts of character trigrams of many texts, and cosines of pairs of texts by weighted trigrams, over numpy arrays.

A trigram is a number, 21 bits to each of its characters, so trigrams are told apart exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

N, BITS = 3, 21
#: Characters that are taken apart at once, and different trigrams that are counted before they are handed on.
CHARACTERS, HELD = 1_000_000, 500_000

Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def trigrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, at): all trigrams of the texts, and the places of the texts they are of."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    key = codes[:-2] << 2 * BITS | codes[1:-1] << BITS | codes[2:]
    whole = at[:-2] == at[2:]
    return key[whole], at[:-2][whole]


def words_of(keys: np.ndarray) -> list[str]:
    """The trigrams as texts."""
    codes = np.stack([keys >> (N - 1 - k) * BITS & (1 << BITS) - 1 for k in range(N)], 1)
    s = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [s[i : i + N] for i in range(0, len(s), N)]


def keys_of(grams: Sequence[str]) -> np.ndarray:
    return trigrams(grams)[0]


def _places(texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """The different texts, and the place of each text among them."""
    at: dict[str, int] = {}
    place = np.fromiter((at.setdefault(t, len(at)) for t in texts), np.int64, len(texts))
    return list(at), place


def _slices(lengths: np.ndarray) -> Iterator[slice]:
    """Neighbours of about CHARACTERS together."""
    part = (np.cumsum(lengths) - lengths) // CHARACTERS
    ends = [0, *np.flatnonzero(np.diff(part)) + 1, len(lengths)]
    return (slice(i, j) for i, j in zip(ends, ends[1:]) if i < j)


def _lengths(texts: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _summed(parts: Sequence[Counts]) -> Counts:
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total, df = (np.bincount(at, np.concatenate([p[k] for p in parts]), len(key)).astype(np.int64) for k in (1, 2))
    return key, total, df


def counts(texts: Sequence[str]) -> Iterator[Counts]:
    """(key, how often the texts hold it, how many texts hold it)."""
    for s in _slices(_lengths(texts)):
        once, place = _places(texts[s])
        times = np.bincount(place, minlength=len(once))
        key, at = trigrams(once)
        key, nth = np.unique(key, return_inverse=True)
        code, tf = np.unique(nth * len(once) + at, return_counts=True)
        nth, m = code // len(once), times[code % len(once)]
        yield key, np.bincount(nth, tf * m, len(key)).astype(np.int64), np.bincount(nth, m, len(key)).astype(np.int64)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, total, df) of batches of texts (s): summed up over the batches of a task, in parts if there are many trigrams."""
    row = lambda c: pa.RecordBatch.from_arrays([pa.array(words_of(c[0]), pa.string()), pa.array(c[1]), pa.array(c[2])], ["gram", "total", "df"])
    parts: list[Counts] = []
    for b in batches:
        for c in counts(b.column("s").to_pylist()):
            parts.append(c)
            if sum(len(p[0]) for p in parts) > HELD:
                parts = [_summed(parts)]
                if len(parts[0][0]) > HELD / 2:
                    yield row(parts.pop())
    if parts:
        yield row(_summed(parts))


def cosines(a: Sequence[str], b: Sequence[str], keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of the pairs of texts; keys: the trigrams that count, in order, weights: what each counts. 0 if a text has none of them."""
    out = np.zeros(len(a))
    for s in _slices(_lengths(a) + _lengths(b)) if len(keys) else ():
        once, place = _places([*a[s], *b[s]])
        x, y = place[: len(place) // 2], place[len(place) // 2 :]
        key, at = trigrams(once)
        nth = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = keys[nth] == key
        code, tf = np.unique(at[known] * len(keys) + nth[known], return_counts=True)  # the vectors, one after the other
        if not len(code):
            continue
        of, nth = np.divmod(code, len(keys))
        w = tf * weights[nth]
        norm = np.sqrt(np.bincount(of, w * w, len(once)))
        start = np.searchsorted(of, np.arange(len(once) + 1))
        held = start[x + 1] - start[x]
        pair = np.repeat(np.arange(len(x)), held)
        entry = np.arange(len(pair)) + np.repeat(start[x] - (np.cumsum(held) - held), held)
        there = y[pair] * len(keys) + nth[entry]
        found = np.minimum(np.searchsorted(code, there), len(code) - 1)
        both = code[found] == there
        product = np.bincount(pair[both], w[entry[both]] * w[found[both]], len(x))
        size = norm[x] * norm[y]
        out[s] = np.divide(product, size, out=np.zeros(len(x)), where=size > 0)
    return out
