"""BM25 scores of postings and upper bounds by term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import bm25
from ..sources.corpus import Corpus


def scores(corpus: Corpus, terms: DataFrame | None = None) -> DataFrame:
    """term, doc_id, tf, score of every posting, or of those of ``terms`` (column term); the totals are one row."""
    postings, stats = corpus.postings, corpus.term_stats.select("term", "df")
    if terms is not None:
        postings, stats = postings.join(terms, "term", "left_semi"), stats.join(terms, "term", "left_semi")
    rows = postings.join(stats, "term").crossJoin(F.broadcast(corpus.totals.select("n_docs", "avg_len")))  # a posting carries the length of its document
    return rows.select("term", "doc_id", "tf", bm25(F.col("n_docs"), F.col("df"), F.col("tf"), F.col("n_tokens"), F.col("avg_len")).alias("score"))


def bounds(corpus: Corpus) -> DataFrame:
    """term, max_score, max_doc_weight (0 with BM25)."""
    return scores(corpus).groupBy("term").agg(F.max("score").alias("max_score")).withColumn("max_doc_weight", F.lit(0.0))
