"""Labelled extension: incremental ingest of documents with Structured Streaming.

New files of a folder become rows of the token table (term, doc_id, pos), appended exactly once: the sink writes each micro-batch to a folder
named by its number, so a batch that runs again replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import words


def tokens_of(documents: DataFrame) -> DataFrame:
    """term, doc_id, pos, for batch and stream alike."""
    return documents.select("doc_id", F.posexplode(words("text")).alias("pos", "term")).select("term", F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("long").alias("pos"))


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Appends what is new in ``folder`` (Parquet files) to ``target/batch=N`` and stops when all of it is read."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = tokens_of(spark.readStream.schema(schema).parquet(folder))
    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(spark: SparkSession, folder: str, checkpoint: str, name: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Occurrences of each word so far, kept as streaming state; the result is the in-memory table ``name``."""
    counts = tokens_of(spark.readStream.schema(schema).parquet(folder)).groupBy("term").agg(F.count("*").alias("cf"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
