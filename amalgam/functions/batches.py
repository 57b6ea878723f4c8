"""Edit-based similarities of many pairs of texts at once, bit-parallel over numpy arrays.

A text of up to 64 characters (the pattern) is a 64-bit word, and each character of the other text a mask of the places where the
pattern has it; one step of an algorithm is a few operations on the words of all pairs. Longer patterns go through Python's
unbounded integers, pair by pair, with the same recurrence.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

WORD = 64
_ONE, _ALL = np.uint64(1), np.uint64(2**64 - 1)


def _codes(texts: Sequence[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.int64)
    for i, t in enumerate(texts):
        if t:
            out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out


def _masks(patterns: Sequence[str], texts: Sequence[str]) -> np.ndarray:
    """[pair, place in the text]: the places of the pattern that hold the text's character there."""
    p = _codes(patterns, max(map(len, patterns), default=0), -1)
    t = _codes(texts, max(map(len, texts), default=0), -2)
    out = np.zeros(t.shape, np.uint64)
    for k in range(p.shape[1]):
        out |= (t == p[:, k : k + 1]).astype(np.uint64) << np.uint64(k)
    return out


def _lengths(texts: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _full(lengths: np.ndarray) -> np.ndarray:
    return np.where(lengths >= WORD, _ALL, (_ONE << np.minimum(lengths, WORD - 1).astype(np.uint64)) - _ONE)


def _steps(row: np.ndarray, masks) -> np.ndarray:
    for m in masks:
        seen = row & m
        row = (row + seen) | (row - seen)
    return row


def lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence of two texts of any length."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        seen = row & at.get(c, 0)
        row = ((row + seen) | (row - seen)) & full
    return len(a) - row.bit_count()


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b)]
    long_ = [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    n = _lengths(short)
    out = np.zeros(len(n), np.int64)
    fits = np.flatnonzero((n > 0) & (n <= WORD))
    order = fits[np.argsort(_lengths(long_)[fits], kind="stable")]
    for part in np.array_split(order, max(1, len(order) // 1000)):  # texts of like length together
        p, t = [short[i] for i in part], [long_[i] for i in part]
        masks, full = _masks(p, t), _full(n[part])
        row = _steps(full.copy(), masks.T)
        out[part] = n[part] - np.bitwise_count(row & full).astype(np.int64)
    for i in np.flatnonzero(n > WORD):
        out[i] = lcs(short[i], long_[i])
    return out


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """2 LCS / (len a + len b); 1 for two empty texts."""
    both = _lengths(a) + _lengths(b)
    return np.where(both == 0, 1.0, 2 * lcs_lengths(a, b) / np.maximum(both, 1))


def _window_ratios(short: list[str], long_: list[str]) -> np.ndarray:
    """The best ratio of each short text (all of one length k, at most 64) against the windows of k characters of the long one, also those cut off at its ends."""
    k, n = len(short[0]), _lengths(long_)
    masks = _masks(short, long_)
    width = masks.shape[1]
    padded = np.zeros((len(short), width + 2 * (k - 1)), np.uint64)
    padded[:, k - 1 : k - 1 + width] = masks
    starts = width + k - 1
    full = _full(np.full(1, k))[0]
    row = np.full((len(short), starts), full)
    for j in range(k):
        seen = row & padded[:, j : j + starts]
        row = (row + seen) | (row - seen)
    found = k - np.bitwise_count(row & full).astype(np.int64)
    first = np.arange(starts) - (k - 1)
    held = np.minimum(first + k, n[:, None]) - np.maximum(first, 0)  # characters in the window
    return np.where(held > 0, 2 * found / (k + np.maximum(held, 1)), 0.0).max(1)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text against windows of the longer one, also those cut off at its ends; both ways for equal lengths."""
    best = 0.0
    for s, t in ((a, b), (b, a)) if len(a) == len(b) else (sorted((a, b), key=len),):
        if not s or not t:
            return float(s == t)
        k = len(s)
        best = max(best, *(2 * lcs(s, w) / (k + len(w)) for w in (t[max(0, i) : i + k] for i in range(1 - k, len(t)))))
    return best


def partial_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    out = np.zeros(len(a))
    by_length: dict[int, list[tuple[int, str, str]]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        s, t = (x, y) if len(x) <= len(y) else (y, x)
        if not s or s == t:
            out[i] = float(s == t)
        elif len(s) > WORD:
            out[i] = partial_ratio(x, y)
        else:
            by_length.setdefault(len(s), []).append((i, s, t))
            if len(s) == len(t):
                by_length[len(s)].append((i, t, s))
    for items in by_length.values():
        items.sort(key=lambda x: len(x[2]))
        for at in range(0, len(items), 500):
            at_, short, long_ = zip(*items[at : at + 500])
            np.maximum.at(out, np.array(at_), _window_ratios(list(short), list(long_)))
    return out


def partial_token_set_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """0 without words on a side, 1 with a word in common, else the partial ratio of the sorted words."""
    words = [(set(x.split()), set(y.split())) for x, y in zip(a, b)]
    out = np.array([1.0 if x & y else 0.0 for x, y in words])
    open_ = [i for i, (x, y) in enumerate(words) if x and y and not x & y]
    if open_:
        out[open_] = partial_ratios(*([" ".join(sorted(words[i][k])) for i in open_] for k in (0, 1)))
    return out


def jaro_winkler_ratio(a: str, b: str) -> float:
    """Jaro similarity with a bonus of a tenth for each of up to 4 equal first characters, above 0.7; 1 for two empty texts."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (b[j] for j in range(len(b)) if taken[j]))) // 2
    m = len(hits)
    return _winkler((m / len(a) + m / len(b) + (m - moved) / m) / 3, a, b)


def _winkler(jaro: float, a: str, b: str) -> float:
    if jaro <= 0.7:
        return jaro
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def jaro_winkler_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(a, b)])
    la, lb = _lengths(a), _lengths(b)
    open_ = np.flatnonzero((out == 0) & (la > 0) & (lb > 0))
    for i in open_[lb[open_] > WORD]:
        out[i] = jaro_winkler_ratio(a[i], b[i])
    open_ = open_[lb[open_] <= WORD]
    open_ = open_[np.argsort(la[open_], kind="stable")]
    for part in np.array_split(open_, max(1, len(open_) // 1000)):
        if not len(part):
            continue
        x, y = [a[i] for i in part], [b[i] for i in part]
        n, m = la[part], lb[part]
        masks = _masks(y, x)  # [pair, place in a]: places of b with the same character
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        taken = np.zeros(len(part), np.uint64)
        hit = np.zeros(masks.shape, bool)
        for i in range(masks.shape[1]):
            low, high = np.clip(i - reach, 0, WORD), np.clip(i + reach + 1, 0, WORD)
            free = masks[:, i] & (_full(high) & ~_full(low)) & ~taken
            bit = free & (~free + _ONE)
            taken |= bit
            hit[:, i] = bit != 0
        found, rest, moved = hit.sum(1), taken.copy(), np.zeros(len(part), np.int64)
        for i in range(masks.shape[1]):
            bit = rest & (~rest + _ONE)
            bit[~hit[:, i]] = 0
            moved += (bit != 0) & (masks[:, i] & bit == 0)
            rest ^= bit
        k = np.maximum(found, 1)
        jaro = np.where(found > 0, (found / n + found / m + (found - moved // 2) / k) / 3, 0.0)
        same = np.zeros(len(part), np.int64)
        for i, (s, t) in enumerate(zip(x, y)):
            while same[i] < min(4, n[i], m[i]) and s[same[i]] == t[same[i]]:
                same[i] += 1
        out[part] = np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)
    return out
