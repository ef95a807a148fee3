"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, token files.

Every stage works on all that the one before it kept; what a stage returns is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phraseloom.llm import stages
from phraseloom.sources.store import written as stored

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("benchmark_decontamination", stages.drop_leaks),
    ("mixing", stages.mix_sources),
    ("token_files", stages.write_tokens),
]

#: SQL can't express the classifier and the tokenizer; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
