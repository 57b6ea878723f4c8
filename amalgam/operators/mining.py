"""Labels and hard negatives for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amalgam.functions.similarity import difficulty, jaccard
from amalgam.functions.text import ABBREVIATIONS
from amalgam.operators.pairs import KEY, join_records, last_by_id


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where truth has them, else 0."""
    return pairs.join(truth.select(*KEY).distinct().withColumn("label", F.lit(1)), KEY, "left").fillna(0, ["label"])


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs with `difficulty`; ids that stand several times count by the record that arrived last."""
    joined = join_records(pairs, last_by_id(left), last_by_id(right), table=ABBREVIATIONS)
    same = lambda w: jaccard(F.col(f"{w}_1"), F.col(f"{w}_2"))
    value = difficulty(same("name_words"), same("address_words"), F.col("country_1"), F.col("country_2"))
    return joined.withColumn("difficulty", value).select(*pairs.columns, "difficulty")


def hard_negatives(pairs: DataFrame, truth: DataFrame, left: DataFrame, right: DataFrame, keep_ratio: float = 0.5, most: int | None = None) -> DataFrame:
    """The negatives hardest to tell from matches, as many as max(1, 1/keep_ratio) times the positive candidate rows, `most` at most.

    Hardest first; of equal ones the later pair. One top-n over all partitions, without a sort of the whole.
    """
    marked = labelled(pairs, truth)
    n = int(marked.where("label = 1").count() * max(1, 1 / keep_ratio))
    n = n if most is None else min(n, most)
    negatives = scored(marked.where("label = 0"), left, right)
    return negatives.orderBy(F.desc("difficulty"), F.desc("source1_entity_id"), F.desc("pos")).limit(n)


def training_set(pairs: DataFrame, truth: DataFrame, left: DataFrame, right: DataFrame, keep_ratio: float = 0.5, most: int | None = None) -> DataFrame:
    """Positives and hard negatives."""
    positives = scored(labelled(pairs, truth).where("label = 1"), left, right)
    return positives.unionByName(hard_negatives(pairs, truth, left, right, keep_ratio, most))


def class_balance(df: DataFrame) -> DataFrame:
    """One row: positives, negatives, mean label, and the weight of a positive (at most 100; 5 without positives)."""
    pos, neg = F.sum("label"), F.count("*") - F.sum("label")
    weight = F.when(F.coalesce(pos, F.lit(0)) == 0, 5.0).otherwise(F.least(F.try_divide(neg, pos), F.lit(100.0)))
    return df.agg(F.coalesce(pos, F.lit(0)).alias("positives"), F.coalesce(neg, F.lit(0)).alias("negatives"), F.avg("label").alias("mean_label"), weight.alias("weight"))
