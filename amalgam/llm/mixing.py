"""Problem 9: documents drawn so that each source has its target share of the tokens.

1. One pass gives each document its size in tokens and a histogram of its words (hashed); both are written as a narrow table.
2. A classifier of sources is fitted on labelled rows. A document of a listed source belongs to it wholly; one whose source is null
   or not listed belongs to the listed sources by the classifier's posterior (soft membership).
3. Document rates between 0 and the cap are fitted by distributed projected gradient least squares: expected tokens of each source
   against its target. The gradient is scaled by each source's mass; an iteration is one sum over the narrow table.
4. Rates become whole repeats: the whole part for every document, one more for those whose hash is below the source's threshold.
   The threshold is set by two histograms of tokens over the hash, so the drawn total meets the target within a few documents.

Targets that no document can meet (a source without documents) leave a gap; the shares nearest to the targets (least squares) spread it
evenly over the others. The total is the largest at which all those shares can be met within the caps.

Defined results: null and empty texts have no tokens and are never drawn; a document with no listed source may be used as often as
the least cap allows; repeated rows are drawn on their own; no targets or no documents give no rows; ties in the hash fall together.
The classifier sees at most `max_labelled` rows (those of least hash); everything else covers all rows. Rates that don't settle
to within 0.0001 of all tokens in `iterations` rounds give a warning with the gap left.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amalgam.llm.tokens import TOKENIZERS
from amalgam.llm.words import coded, sizes, words_of
from amalgam.sources.tables import cut

FEATURES = 64
BINS = 4096


def _profile(tokenizer: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sizes(tokenizer, folder)
        slots: dict[str, int] = {}
        for batch in batches:
            distinct, codes, first = coded(batch.column(2))
            n_of = np.fromiter(map(len, size.of(distinct)), np.int64, len(distinct))
            if len(slots) > 400_000:
                slots.clear()
            for w in distinct:
                if w not in slots:
                    slots[w] = xxhash.xxh32_intdigest(w) % FEATURES
            slot = np.fromiter((slots[w] for w in distinct), np.int64, len(distinct))
            rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
            n = np.bincount(rows, n_of[codes], len(first) - 1).astype(np.int32)
            seen = np.bincount(rows * FEATURES + slot[codes], minlength=(len(first) - 1) * FEATURES).astype(np.float32)
            x = pa.FixedSizeListArray.from_arrays(pa.array(seen), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), x], ["key", "source", "n", "x"])

    return run


def profiles(df: DataFrame, key: str, source: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, source, n, x): size in tokens and hashed word counts of each document."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words_of(F.col(text)).alias("w")).mapInArrow(_profile(tokenizer, folder), f"key {kind}, source string, n int, x array<float>")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Word counts as square roots of their parts, with the length and a constant."""
    total = x.sum(1, keepdims=True)
    return np.hstack([np.sqrt(x / np.maximum(total, 1)), np.log1p(total) / 10, np.ones_like(total)])


def fit_classifier(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300) -> np.ndarray:
    """Weights of multinomial logistic regression, by accelerated gradient."""
    z = _scaled(x.astype(np.float64))
    hot = np.eye(classes)[y]
    w = v = np.zeros((z.shape[1], classes))
    rate = 4.0 / max(1e-9, np.linalg.norm(z, 2) ** 2 / len(z))
    for k in range(steps):
        p = _softmax(z @ v)
        new = v - rate * (z.T @ (p - hot) / len(z) + 1e-5 * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    cap: int


def _membership(batch: pa.RecordBatch, names: list[str], weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each document's membership in the listed sources, and the position of its own source (-1: none listed)."""
    at = {s: i for i, s in enumerate(names)}
    own = np.array([at.get(s, -1) for s in batch.column("source").to_pylist()], np.int64)
    p = np.zeros((len(own), len(names)))
    p[own >= 0, own[own >= 0]] = 1
    if (own < 0).any() and weights is not None:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)[own < 0]
        p[own < 0] = _softmax(_scaled(x.astype(np.float64)) @ weights)
    return p, own


def _rates(p: np.ndarray, own: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given gradient steps from zero, projected to [0, cap] after each."""
    cap = np.where(own >= 0, caps[own], caps.min())
    r = np.zeros(len(p))
    for s in steps:
        r = np.clip(r - p @ s, 0, cap)
    return r


def _totals(names: list[str], weights, caps: np.ndarray, steps: list[np.ndarray]):
    """Sums over a split: mass (tokens of each source), room (with caps), expected tokens at the present rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((3, len(names)))
        for batch in batches:
            p, own = _membership(batch, names, weights)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            acc += [n @ p, (n * np.where(own >= 0, caps[own], caps.min())) @ p, (n * _rates(p, own, caps, steps)) @ p]
        rows = len(names) * 3
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), pa.array(acc.ravel())], ["i", "v"])

    return run


def _draw(names: list[str], weights, caps: np.ndarray, steps: list[np.ndarray]):
    """(key, source, n, own, whole, part, u): whole repeats, the part left over, and a hash in [0, 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, own = _membership(batch, names, weights)
            r = _rates(p, own, caps, steps)
            whole = np.floor(r + 1e-9)
            u = np.array([xxhash.xxh64_intdigest(str(k), 9) / 2**64 for k in batch.column("key").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("source"), batch.column("n"), pa.array(own, pa.int32()), pa.array(whole, pa.int32()), pa.array(np.maximum(r - whole, 0)), pa.array(u)],
                ["key", "source", "n", "own", "whole", "part", "u"],
            )

    return run


def nearest_shares(shares: np.ndarray, can: np.ndarray) -> np.ndarray:
    """The shares nearest to `shares` (least squares) that sum to 1 and are 0 where a source has no tokens."""
    out, on = np.zeros(len(shares)), can.copy()
    while on.any():
        out[:] = 0
        out[on] = shares[on] + (1 - shares[on].sum()) / on.sum()
        if (out >= 0).all():
            break
        on &= out >= 0
    return out


def mix(df: DataFrame, targets: list[Target], key: str = "doc_id", source: str = "source", text: str = "text", max_labelled: int = 5_000, iterations: int = 40) -> DataFrame:
    """(key, source, n_tokens, times): the documents drawn, with how often each is used."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    empty = spark.createDataFrame([], f"`{key}` {kind}, source string, n_tokens int, times int")
    if not targets:
        return empty
    names, caps = [t.source for t in targets], np.array([t.cap for t in targets], float)
    docs = cut(profiles(df, key, source, text))
    labelled = docs.where(F.col("source").isin(names) & (F.col("n") > 0)).select("source", "x", F.xxhash64("key").alias("u"), "key")
    # a threshold on the hash leaves about max_labelled rows in all splits together; only these are sorted
    share = min(1.0, (max_labelled + 4 * max_labelled**0.5) / max(labelled.count(), 1))
    some = labelled.where(F.col("u") < int(min((2 * share - 1) * 2**63, 2**63 - 1))) if share < 1 else labelled
    got = some.orderBy("u", "key").limit(max_labelled).select("source", "x").toPandas()  # at most max_labelled rows of FEATURES numbers
    at = {s: i for i, s in enumerate(names)}
    seen = sorted({at[s] for s in got["source"]})
    weights = None
    if len(seen) > 1:
        fitted = fit_classifier(np.array(got["x"].tolist()), np.array([seen.index(at[s]) for s in got["source"]]), len(seen))
        weights = np.zeros((fitted.shape[0], len(names)))
        weights[:, seen] = fitted
        weights[-1, [i for i in range(len(names)) if i not in seen]] = -60.0  # sources without documents
    steps: list[np.ndarray] = []

    def totals() -> np.ndarray:
        out = np.zeros(3 * len(names))
        for r in docs.mapInArrow(_totals(names, weights, caps, steps), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r.i] = r.v
        return out.reshape(3, -1)

    mass, room, _ = totals()
    present = room > 1e-6 * max(room.sum(), 1)
    if not present.any():
        return empty
    shares = nearest_shares(np.array([t.share for t in targets]), present)
    size = (room[shares > 0] / shares[shares > 0]).min() * (1 - 1e-6)
    wanted = shares * size
    steps.append(-wanted / np.maximum(mass, 1e-9) * present)
    for _ in range(iterations):
        gap = totals()[2] - wanted
        if np.abs(gap).max() <= 1e-4 * size:
            break
        steps.append(gap / np.maximum(mass, 1e-9) * present)
    else:
        warnings.warn(f"rates didn't settle in {iterations} iterations: the largest gap to a target was {np.abs(gap).max() / size:.5f} of all tokens", stacklevel=2)
    drawn = cut(docs.mapInArrow(_draw(names, weights, caps, steps), f"key {kind}, source string, n int, own int, whole int, part double, u double"))

    # a source's documents share one rate, so the part left over is drawn by one threshold on the hash
    need = {r.own: r.more for r in drawn.where("own >= 0").groupBy("own").agg(F.sum(F.col("n") * F.col("part")).alias("more")).collect()}
    below, width = dict.fromkeys(need, 0.0), 1.0
    threshold = lambda: F.try_element_at(F.create_map(*[F.lit(x) for s in sorted(below) for x in (s, below[s])]), F.col("own")) if below else F.lit(0.0)
    for _ in range(2):
        width /= BINS
        bins = drawn.where("own >= 0 and part > 1e-12 and n > 0").select("own", "n", F.floor((F.col("u") - threshold()) / width).alias("bin")).where(f"bin >= 0 and bin < {BINS}")
        held: dict[int, list[tuple[int, int]]] = {s: [] for s in need}
        for r in bins.groupBy("own", "bin").agg(F.sum("n").alias("n")).collect():  # at most BINS rows for each listed source
            held[r.own].append((r.bin, r.n))
        for s, sums in held.items():
            reached = BINS
            for k, n in sorted(sums):
                if n > need[s]:
                    reached = k
                    break
                need[s] -= n
            below[s] += reached * width
    limit = F.when(F.col("own") >= 0, F.coalesce(threshold(), F.lit(0.0))).otherwise(F.col("part"))
    times = (F.col("whole") + ((F.col("part") > 1e-12) & (F.col("u") < limit)).cast("int")).alias("times")
    return drawn.where("n > 0").select(F.col("key").alias(key), "source", F.col("n").alias("n_tokens"), times).where("times > 0")


def shares_reached(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_times, tokens, actual_share): one row for each source listed or drawn."""
    used = F.col("n_tokens") * F.col("times")
    per = drawn.groupBy("source").agg(F.count("*").alias("documents"), F.max("times").alias("most_times"), F.sum(used.cast("long")).alias("tokens"))
    total = per.agg(F.sum("tokens").alias("total"))  # one row
    goal = targets.select(F.col("source").alias("s"), "target_share", "max_repeats")
    out = per.join(goal, F.col("source").eqNullSafe(F.col("s")), "full").crossJoin(F.broadcast(total))
    return out.select(
        F.coalesce("source", "s").alias("source"), "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_times", F.lit(0)).alias("most_times"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide(F.col("tokens"), F.col("total")), F.lit(0.0)).alias("actual_share"),
    )
