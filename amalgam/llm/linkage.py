"""Comparison of parsed records by levels of agreement, and the probabilities of match by expectation-maximization.

Each compared field falls into a level (0 agrees best; one level stands for a missing value). Pairs are counted by their pattern
of levels; the two-class mixture (match or not, fields independent within a class) is fitted to those few counts, so its cost doesn't
depend on the number of pairs. A pair's confidence is the posterior of its pattern.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side(df: DataFrame, n: str) -> DataFrame:
    """df with n behind all its column names."""
    return df.select(*[F.col(f"`{c}`").alias(c + n) for c in df.columns])


def fit(levels: np.ndarray, counts: np.ndarray, m: list[list[float]], u: list[list[float]], silent: list[int | None] | None = None, pinned: list[tuple[int, ...]] | None = None, prior: float = 0.5, rounds: int = 500) -> np.ndarray:
    """The posterior of each pattern, by expectation-maximization from the given starts.

    Each level keeps a little of its starting probability, so that levels never seen don't decide. A field's silent level
    (nothing to compare) says nothing for or against a match. A pinned level keeps its starting probability among matches: how
    often a match shows a contradiction isn't to be learned from pairs that agree in all else but are no matches.
    """
    silent = silent or [None] * levels.shape[1]
    pinned = pinned or [()] * levels.shape[1]
    m_, u_ = [np.array(x) / sum(x) for x in m], [np.array(x) / sum(x) for x in u]
    m0, u0 = [x.copy() for x in m_], [x.copy() for x in u_]
    total = counts.sum()
    keep = 0.01 * total + 1
    post = np.full(len(levels), prior)
    for _ in range(rounds):
        a, b = np.full(len(levels), np.log(prior)), np.full(len(levels), np.log1p(-prior))
        for f in range(levels.shape[1]):
            told = levels[:, f] != silent[f] if silent[f] is not None else np.full(len(levels), True)
            a += np.where(told, np.log(m_[f][levels[:, f]]), 0)
            b += np.where(told, np.log(u_[f][levels[:, f]]), 0)
        new = 1 / (1 + np.exp(np.clip(b - a, -500, 500)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
        for f in range(levels.shape[1]):
            for p, start, w in ((m_, m0, counts * post), (u_, u0, counts * (1 - post))):
                x = np.bincount(levels[:, f], w, len(p[f])) + keep * start[f]
                if silent[f] is not None:
                    x[silent[f]] = 1e-9
                p[f] = x / x.sum()
            if hold := list(pinned[f]):
                free = [k for k in range(len(m_[f])) if k not in hold]
                m_[f][free] *= (1 - m0[f][hold].sum()) / m_[f][free].sum()
                m_[f][hold] = m0[f][hold]
        prior = float(np.clip((counts @ post + 1) / (total + 2), 1e-3, 1 - 1e-3))
    return post


def with_confidence(pairs: DataFrame, fields: dict[str, tuple], times: str | None = None) -> DataFrame:
    """pairs with `confidence`; fields: for each column of levels where the match and the non-match
    class start from; as a third, the level that says nothing; as a fourth, the levels that are pinned. times: the column of how many pairs a row stands for."""
    names = list(fields)
    seen = pairs.groupBy(*names).agg((F.sum(times) if times else F.count("*")).alias("count")).collect()  # at most as many rows as there are patterns
    if not seen:
        return pairs.withColumn("confidence", F.lit(0.0))
    levels, counts = np.array([[r[n] for n in names] for r in seen]), np.array([r["count"] for r in seen], float)
    post = fit(levels, counts, [fields[n][0] for n in names], [fields[n][1] for n in names], [(*fields[n], None)[2] for n in names], [(*fields[n], None, ())[3] if len(fields[n]) > 3 else () for n in names])
    patterns = pairs.sparkSession.createDataFrame([(*map(int, x), float(p)) for x, p in zip(levels, post)], ", ".join(f"{n} int" for n in names) + ", confidence double")
    return pairs.join(F.broadcast(patterns), names)
