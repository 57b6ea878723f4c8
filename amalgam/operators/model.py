"""Two tree ensembles over pair features, weighed together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.operators.evaluate import best, grid_scores
from amalgam.operators.mining import class_balance


@dataclass
class Ensemble:
    first: PipelineModel
    second: PipelineModel
    weight: float = 0.5
    threshold: float = 0.5

    def score(self, df: DataFrame) -> DataFrame:
        """df with p1, p2, the weighed probability and the prediction."""
        drop = ["features", "rawPrediction", "probability", "prediction"]
        out = self.first.transform(df).withColumn("p1", vector_to_array("probability")[1]).drop(*drop)
        out = self.second.transform(out).withColumn("p2", vector_to_array("probability")[1]).drop(*drop)
        p = self.weight * F.col("p1") + (1 - self.weight) * F.col("p2")
        return out.withColumn("probability", p).withColumn("is_match", (p >= self.threshold).cast("int"))

    def save(self, path: str) -> None:
        self.first.write().overwrite().save(f"{path}/first")
        self.second.write().overwrite().save(f"{path}/second")
        SparkSession.getActiveSession().createDataFrame([(self.weight, self.threshold)], "weight double, threshold double").write.mode("overwrite").json(f"{path}/config")

    @staticmethod
    def load(spark, path: str) -> Ensemble:
        config = spark.read.schema("weight double, threshold double").json(f"{path}/config").first()
        return Ensemble(PipelineModel.load(f"{path}/first"), PipelineModel.load(f"{path}/second"), config.weight, config.threshold)


@dataclass
class Settings:
    """What the models are trained with: rounds of boosting (fewer where the held-out part of the rows, `held` of them, stops gaining), trees of
    the forest, depth, the least gain of a split, the least rows of a leaf."""

    rounds: int = 300
    trees: int = 100
    depth: int = 4
    step: float = 0.05
    gain: float = 0.0
    leaf: int = 10
    held: float = 0.1
    seed: int = 42


def train(df: DataFrame, features: list[str], settings: Settings | None = None) -> Ensemble:
    """Fits both models on (label, *features) with weighed positives.

    Boosting stops early on a part of the rows (by a hash of their features) that it isn't fitted on. Spark checks after each
    round whether the held-out error still falls by a hundredth of itself, which is stricter than waiting for 30 rounds without gain.
    """
    s = settings or Settings()
    weight = class_balance(df).first().weight or 1.0  # 0 without negatives
    held = F.pmod(F.xxhash64(*features), F.lit(1000)) < int(1000 * s.held)
    rows = df.withColumns({"w": F.when(F.col("label") == 1, float(weight)).otherwise(1.0), "label": F.col("label").cast("double"), "held": held})
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    common = {"labelCol": "label", "weightCol": "w", "maxDepth": s.depth, "minInstancesPerNode": s.leaf, "minInfoGain": s.gain, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": s.seed}
    stop = {"validationIndicatorCol": "held", "validationTol": 0.01} if s.held and not rows.where("held").isEmpty() else {}
    first = Pipeline(stages=[assembler, GBTClassifier(stepSize=s.step, maxIter=s.rounds, cacheNodeIds=True, **common, **stop)]).fit(rows)
    second = Pipeline(stages=[assembler, RandomForestClassifier(numTrees=s.trees, **common)]).fit(rows)
    return Ensemble(first, second)


def score_one(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df with the probability of a single model and the prediction."""
    out = model.transform(df).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")
    return out.withColumn("is_match", (F.col("probability") >= threshold).cast("int"))


def tuned(model: Ensemble, held_out: DataFrame) -> Ensemble:
    """The model with the weight and threshold that score best on rows it wasn't fitted on."""
    top = best(grid_scores(model.score(held_out))).first()
    return Ensemble(model.first, model.second, top.w, top.t)
