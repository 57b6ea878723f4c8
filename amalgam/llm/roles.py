"""What the common words of names and addresses mean, learned from the corpus alone.

Values that agree in all their rare words (the core) mostly mean the same thing, so how their common words differ tells what those
words are worth. For each two common words, over all cores with more than one value:
- a word STANDS IN for a more frequent one (Bob, Robert; mfg, manufacturing; r, Robert; USA, US) if one is put in the place of the
  other far more often than chance, in a fair part of the cores that hold the rarer word, and hardly ever beside it;
- a word can be DROPPED (Ltd, the, near) if another value of its core has all else but it;
- two words CONTRADICT each other (seeds, plastics; two towns) if they hardly ever stand together, hardly ever replace each other, and,
  where they do so as often as chance has it (two streets that differ in this word), are both mostly kept.

No list of names, legal forms, trades, streets or countries is used. The counts are tables of at most (common words) squared entries,
and the number of common words is bounded by the share of all values that each must hold (records.COMMON), whatever the size of the data
(267 words of names and 559 of addresses at every size of the tests' tables).

Defined results: without values there are no roles, every word can be dropped and none contradict; repeated values count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A stand-in: this share of the cores with the rarer word, this many times chance, at least so many cores.
SHARE, LIFT, SEEN = 0.2, 2.5, 3
#: Cores of at most so many values are compared without arrays.
FEW = 16
#: Words dropped in less than this share of their cores can't be dropped; in less than that share, they are mostly kept.
DROPPED, KEPT = 0.05, 0.25
#: Two words contradict each other below these: standing together and replacing each other, as shares of chance; replacing each other, as a share of the rarer one's cores.
TOGETHER, SWAPPED, REPLACED = 0.1, 0.2, 0.1


@dataclass
class Roles:
    words: list[str]
    roots: list[frozenset[int]]
    droppable: list[bool]
    against: np.ndarray  # [u, v], a bool for each two words
    specific: list[bool] = field(default_factory=list)
    known: dict = field(default_factory=dict, repr=False)
    telling: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        """The roots of each word, and the words that contradict it, as bits of numbers."""
        k = len(self.words)
        own = np.zeros((k, k), np.float32)
        for i, xs in enumerate(self.roots):
            own[i, list(xs)] = 1
        bits = lambda flags: [sum(1 << int(v) for v in np.flatnonzero(row)) for row in flags]
        self.root_bits, self.foe_bits = bits(own), bits(own @ ~np.asarray(self.against, bool) @ own.T == 0)

    def clash(self, u: int, v: int) -> bool:
        """Whether all readings of two words contradict each other."""
        return all(self.against[p, q] for p in self.roots[u] for q in self.roots[v])

    def level(self, a: tuple[int, ...], b: tuple[int, ...]) -> int:
        """0 the same words or stand-ins, 1 words left out, 2 words left out that can't be, 3 words that contradict each other."""
        if a == b:
            return 0
        if (a, b) not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            ra, rb = (reduce(or_, (self.root_bits[x] for x in xs), 0) for xs in (a, b))
            only_a, only_b = ([x for x in xs if not self.root_bits[x] & other] for xs, other in ((a, rb), (b, ra)))
            if not only_a and not only_b:
                out = 0
            elif any(self.foe_bits[u] >> v & 1 for u in only_a for v in only_b):
                out = 3
            else:
                out = 1 if all(self.droppable[x] for x in only_a + only_b) else 2
            self.known[a, b] = out
        return self.known[a, b]

    def shared(self, a: tuple[int, ...], b: tuple[int, ...]) -> bool:
        """Whether both hold the same telling word (one that few values hold) or stand-ins of one."""
        return not self.told(a).isdisjoint(self.told(b))

    def told(self, xs: tuple[int, ...]) -> frozenset[int]:
        """The telling words of a value, by what they mean."""
        if xs not in self.telling:
            if len(self.telling) > 20_000:
                self.telling.clear()
            self.telling[xs] = frozenset(r for x in xs for r in self.roots[x] if self.specific[r])
        return self.telling[xs]


_TALLY = pa.schema([("kind", pa.string()), ("u", pa.int32()), ("v", pa.int32()), ("n", pa.int64())])


def _rows(counts: dict) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate(_TALLY.types[:3])] + [pa.array([counts[k] for k in keys], pa.int64())], schema=_TALLY)


def _swaps_and_drops(values: list[tuple[int, ...]], ids: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Of the different values of a core and their words: words in each other's place, and words that a value has beyond all of another."""
    if len(values) > FEW:
        at = {w: i for i, w in enumerate(ids)}
        x = np.zeros((len(values), len(ids)), np.int32)
        for k, v in enumerate(values):
            x[k, [at[w] for w in v]] = 1
        without = (x.T @ (1 - x)) > 0  # [u, v]: a value holds u but not v
        inside = (x @ (1 - x).T) == 0  # [k, l]: value k is part of value l
        np.fill_diagonal(inside, False)
        dropped = np.zeros(len(ids), bool)
        for k, m in zip(*np.nonzero(inside)):
            dropped |= x[m] > x[k]
        return [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(without & without.T, 1)))], [ids[i] for i in np.flatnonzero(dropped)]
    sets = list(map(set, values))
    holds = [sum(1 << k for k, v in enumerate(sets) if w in v) for w in ids]
    swaps = [(ids[i], ids[j]) for i, p in enumerate(holds) for j in range(i + 1, len(ids)) if p & ~holds[j] and holds[j] & ~p]
    return swaps, sorted(set().union(*(b - a for a in sets for b in sets if a < b)))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(values: array of arrays of words) of each core with several values -> counts of cores: n(u), swaps(u, v), drops(u)."""
    seen: Counter[tuple[tuple[int, ...], ...]] = Counter()
    counts: Counter = Counter()

    def expand() -> None:
        for values, n in seen.items():
            ids = sorted({w for v in values for w in v})
            swaps, drops = _swaps_and_drops(values, ids)
            counts["N", 0, 0] += n
            for w in ids:
                counts["g", w, w] += n
            for w in drops:
                counts["d", w, w] += n
            for u, v in swaps:
                counts["s", u, v] += n
        seen.clear()

    for b in batches:
        seen.update(tuple(sorted(map(tuple, values))) for values in b.column(0).to_pylist())
        if len(seen) > 50_000:
            expand()
    expand()
    yield _rows(counts)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words) of each value -> how many values hold each word and each two words."""
    seen: Counter[tuple[int, ...]] = Counter()
    counts: Counter = Counter()

    def expand() -> None:
        for words, n in seen.items():
            counts["T", 0, 0] += n
            for i, u in enumerate(words):
                for v in words[i:]:
                    counts["t", u, v] += n
        seen.clear()

    for b in batches:
        seen.update(map(tuple, b.column(0).to_pylist()))
        if len(seen) > 50_000:
            expand()
    expand()
    yield _rows(counts)


def learn(values: DataFrame, words: list[str], generic: float = 1.0) -> Roles:
    """The roles of `words` from values (core: any hash of the rare words, null without any; marks), each once or nearly so.

    marks: the sorted positions of a value's common words in `words`.

    generic: words that at least this share of the values hold tell nothing apart.
    """
    ddl = "kind string, u int, v int, n bigint"
    groups = values.where("core is not null").groupBy("core").agg(F.collect_set("marks").alias("m")).where(F.size("m") > 1).select("m")
    tally = groups.mapInArrow(_groups, ddl).unionByName(values.select("marks").mapInArrow(_values, ddl))
    k = len(words)
    beside, swaps, held, drops, cores, total = np.zeros((k, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k), 1, 1
    for r in tally.groupBy("kind", "u", "v").agg(F.sum("n").alias("n")).collect():  # at most (words squared) rows
        if r.kind in "ts":
            (beside if r.kind == "t" else swaps)[[r.u, r.v], [r.v, r.u]] = r.n
        elif r.kind in "gd":
            (held if r.kind == "g" else drops)[r.u] = r.n
        elif r.kind == "N":
            cores = max(r.n, 1)
        else:
            total = max(r.n, 1)
    often = np.diag(beside).copy()
    # rows: the rarer word of two (of equals the earlier one), columns: what it may stand in for
    rarer = (often[:, None] < often[None, :]) | ((often[:, None] == often[None, :]) & (np.arange(k)[:, None] < np.arange(k)[None, :]))
    share = swaps / np.maximum(held, 1)[:, None]
    stands = rarer & (swaps >= SEEN) & (share >= SHARE) & (swaps * cores >= LIFT * np.outer(held, held)) & (beside < 0.1 * share * often[:, None])
    found = [set(map(int, np.flatnonzero(x))) for x in stands]
    # a word that stands in for one which itself stands in for another means the last
    roots = [frozenset(y for x in (found[i] or {i}) for y in (found[x] or {x})) for i in range(k)]
    dropped = (drops + 0.5) / (held + 10)
    expected = np.outer(held, held) / cores
    apart = (beside <= TOGETHER * np.outer(often, often) / total) & (swaps <= REPLACED * np.minimum(held[:, None], held[None, :]))
    against = apart & ((expected < 0.5) | (swaps <= SWAPPED * expected) | (np.maximum(dropped[:, None], dropped[None, :]) < KEPT))
    np.fill_diagonal(against, False)
    return Roles(words, roots, (dropped >= DROPPED).tolist(), against, (often < generic * total).tolist())
