"""Parquet scans and tables written to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, a temporary one if all of Spark runs in this process (tests), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="amalgam-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, observed: Observation | None = None, *what: Column) -> DataFrame:
    """Write df to the shared folder and read it back: a short lineage that outlives lost executors.

    Compressed Parquet instead of checkpoint(), so that later reads prune columns and the optimizer knows sizes. `observed`
    gets the aggregates `what` of the rows on their way, without a second pass.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df.observe(observed, *what) if observed else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_all(*tables: DataFrame) -> None:
    """drop_cut() of several tables, at the end of a large step: its shuffles go, too."""
    for df in tables:
        drop_cut(df)
    release(tables[0].sparkSession)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table made by cut() that nothing will read again."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/cut-" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of finished steps go: Spark deletes them once the driver has collected what refers to them, and they would pile up till then.

    The threads that tell listeners of events hold the last one, and with it the plan of the last query, until another comes; so a query without a job is run first.
    """
    gc.collect()
    spark.sql("VALUES 1").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark._jvm.System.gc()


def splits(spark: SparkSession) -> int:
    """Partitions for a stage whose size isn't known: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[str], name: str, per: list[str] | None = None) -> DataFrame:
    """df with a column of row numbers from 1 in the given order, for each value of `per` (the first columns of the order), if any.

    The rows are sorted by ranges over all tasks; what stands before a range is added to the numbers within it. No task holds a whole group.
    """
    per = per or []
    part = df.repartitionByRange(splits(df.sparkSession), *order).withColumn("__part", F.spark_partition_id())
    part = cut(part)
    held = part.groupBy("__part", *per).count()  # a row for each range and group in it
    before = held.withColumn("__before", F.coalesce(F.sum("count").over(Window.partitionBy(*per).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    here = F.row_number().over(Window.partitionBy("__part", *per).orderBy(*order))
    out = part.withColumn("__here", here)
    joined = out.join(F.broadcast(before.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in per], "__before")), (F.col("__part") == F.col("__p")) & _all_same(per), "left")
    return joined.select(*df.columns, (F.col("__here") + F.col("__before")).alias(name))


def _all_same(per: list[str]) -> Column:
    out = F.lit(True)
    for c in per:
        out = out & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out


def with_positions(df: DataFrame, name: str, base: int = 0) -> DataFrame:
    """df of a scan with each row's place in it, from base + 1: the rows of the splits before, and the place in its split. Without a shuffle of the rows."""
    at = df.withColumn("__id", F.monotonically_increasing_id())
    split = F.shiftright("__id", 33).alias("__split")
    held = at.select(split).groupBy("__split").count()
    before = held.select("__split", F.coalesce(F.sum("count").over(Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each split
    out = at.withColumn("__split", split).join(F.broadcast(before), "__split", "left")
    return out.select(*df.columns, (F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1 + base).alias(name))
