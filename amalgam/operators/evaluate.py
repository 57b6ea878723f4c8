"""F-beta over a grid of ensemble weights and thresholds, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the first model and thresholds that are tried.
WEIGHTS, THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7), (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8)


def grid(weights=WEIGHTS, thresholds=THRESHOLDS) -> Column:
    """All combinations of weights and thresholds as an array of (i, w, t), numbered in order."""
    each = ((w, t) for w in weights for t in thresholds)
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w"), F.lit(float(t)).alias("t")) for i, (w, t) in enumerate(each)])


def macro_f_beta(y: Column, p: Column, beta: float = 0.5) -> Column:
    """An aggregate: mean F-beta over the classes that occur in the labels or the predictions."""
    n = lambda c: F.sum(c.cast("long"))
    b = beta * beta

    def of(k: int) -> tuple[Column, Column]:
        tp, fn, fp = n((y == k) & (p == k)), n((y == k) & (p != k)), n((y != k) & (p == k))
        whole = (1 + b) * tp + b * fn + fp
        return tp + fn + fp > 0, F.when(whole == 0, 0.0).otherwise((1 + b) * tp / whole)

    (has0, f0), (has1, f1) = of(0), of(1)
    both = F.when(has0, f0).otherwise(0.0) + F.when(has1, f1).otherwise(0.0)
    return both / F.greatest(has0.cast("int") + has1.cast("int"), F.lit(1))


def grid_scores(scored: DataFrame, over: Column | None = None, beta: float = 0.5) -> DataFrame:
    """(i, w, t, f_beta) of (label, p1, p2): each row is set against the few dozen entries of the grid where it stands."""
    each = scored.select("label", "p1", "p2", F.explode(grid() if over is None else over).alias("g")).select("label", "p1", "p2", "g.*")
    predicted = ((F.col("w") * F.col("p1") + (1 - F.col("w")) * F.col("p2")) >= F.col("t")).cast("int")
    return each.withColumn("y", predicted).groupBy("i", "w", "t").agg(macro_f_beta(F.col("label"), F.col("y"), beta).alias("f_beta"))


def best(scores: DataFrame) -> DataFrame:
    """One row (w, t, f_beta): the first best of the grid; 0.5 and 0.5 where nothing scores."""
    top = scores.agg(F.max_by(F.struct("w", "t", "f_beta"), F.struct("f_beta", -F.col("i"))).alias("b"))
    none = F.coalesce(F.col("b.f_beta"), F.lit(0.0)) <= 0
    return top.select(F.when(none, 0.5).otherwise(F.col("b.w")).alias("w"), F.when(none, 0.5).otherwise(F.col("b.t")).alias("t"), F.when(none, 0.0).otherwise(F.col("b.f_beta")).alias("f_beta"))


def cross_validation(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of (fold, f_beta)."""
    return scores.agg(F.avg("f_beta").alias("mean"), F.stddev_pop("f_beta").alias("deviation"))
