"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> documents, or the last one's rows.

Filtering stages keep all columns and all documents that they don't reject.  A row is a document: where ids are null or repeated, rows are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import written as stored
from . import decontaminate, mixing, shingles, token_files, toxicity
from .frames import filter_blocks, shared_folder

SHINGLE_WORDS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.train(toxicity.labelled(spark, sf_dir, docs))
    symbol, weights = model.symbol, model.weights
    return filter_blocks(docs, lambda data, borders: toxicity.scores(data, borders, symbol, weights)[0] < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the least doc_id: texts link whose sets of five-word shingles are similar by 0.8 or more."""
    return shingles.without_near_copies(docs, SHINGLE_WORDS).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; of equal rows (doc_id and text), one stands for all."""
    by_row = mixing.mix(docs).groupBy("doc_id", "digest").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    taken = stored(by_row.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("copies").alias("_copies"), "n"), "mix")

    def with_copies(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(of, rows["doc_id"].cast("long").eqNullSafe(of["_id"]) & (mixing.digest(rows) == of["_digest"]))

    name = max(docs.columns, key=len) + "_copy"  # longer than every name of a column

    def repeated(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), of["_copies"])).alias(name)).drop(name)

    single, several = taken.where("n = 1"), taken.where("n > 1")
    out = repeated(with_copies(docs, single), single)
    if several.limit(1).count():
        out = out.union(repeated(with_copies(docs, several).dropDuplicates(["_id", "_digest"]), several))
    return out


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The records of the token files, read back."""
    entries = token_files.write_shards(docs, token_files.tokenizer_json(), shared_folder(spark, "token-files"))
    return token_files.read_shards(spark, entries).select("doc_id", "start", "n_tokens", "ids_crc32")
