"""Queries that arrive as a stream, against a kept index of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from amalgam.operators.blocking import TOP, entities, search


def stream_candidates(source: DataFrame, kept: DataFrame, out: str, checkpoint: str, k: int = TOP, rerank: bool = False) -> StreamingQuery:
    """Writes the candidates of each micro-batch of query records as one more set of files; a batch that is tried again replaces its own.

    kept: an index that was made once (blocking.index, kept by sources.tsv.write_postings) and is only probed here.
    """

    def write(batch: DataFrame, number: int) -> None:
        pairs = search(entities(batch), kept, k, rerank)
        pairs.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
