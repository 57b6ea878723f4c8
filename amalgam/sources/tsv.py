"""Tab-separated files: scans with fixed schemas and sinks that keep one row for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.sources.tables import with_positions

ENTITY = "entity_id string, business_name string, business_address string, country string"
CANDIDATES = "source1_entity_id string, candidate_entity_ids string"
MATCHES = "source1_entity_id string, matched_entity_ids string"
# Words that some readers take as missing.
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_tsv(spark: SparkSession, path: str, schema: str, na_words: bool = False) -> DataFrame:
    """Rows with empty texts for missing ones; na_words: also for words such as NA (which makes Namibia's code empty)."""
    rows = spark.read.options(sep="\t", header=True, quote='"', escape='"', multiLine=True).schema(schema).csv(path)
    out = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])
    return out.select(*[F.when(F.col(c).isin(NA_WORDS), "").otherwise(F.col(c)).alias(c) for c in out.columns]) if na_words else out


def with_order(df: DataFrame, base: int = 0) -> DataFrame:
    """df with `ord`: the place of each row in the file, from base + 1, the same however it is split."""
    return with_positions(df, "ord", base)


def row_range(df: DataFrame, start: int, n: int) -> DataFrame:
    """Rows start + 1 to start + n in the order of `ord`."""
    return df.orderBy("ord").offset(start).limit(n)


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Header and unquoted fields; empty texts stay empty. one_file: for readers that need it, through one task."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(sep="\t", header=True, emptyValue="", quote="").csv(path)


def id_set(df: DataFrame, col: str) -> DataFrame:
    """Distinct trimmed ids, blank ones left out."""
    return df.select(F.trim(col).alias("entity_id")).where("entity_id <> ''").distinct()


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Keeps an index of blocking keys (blocking.index), in as many files, as its rows come: one more shuffle would double its disk."""
    postings.coalesce(buckets).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def find_dataset(spark: SparkSession, root: str, name: str, otherwise: str | None = None) -> str | None:
    """The folder below root that holds the file `name` (the first in order, if several do); `otherwise` if none does."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    todo = [root]
    while todo:
        at = todo.pop(0)
        path = fs_path(at)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            continue
        entries = sorted(fs.listStatus(path), key=lambda x: x.getPath().getName())
        if any(x.isFile() and x.getPath().getName() == name for x in entries):
            return at
        todo += [f"{at.rstrip('/')}/{x.getPath().getName()}" for x in entries if x.isDirectory()]
    return otherwise
