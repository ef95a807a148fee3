"""Requests and replies of the query service, as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import Corpus
from . import search


def conjunctive_replies(corpus: Corpus, patterns: DataFrame, most: int = 10) -> DataFrame:
    """(pid, reply): JSON with qid, complete and the first ``most`` ids; a pattern with an unknown word is incomplete and has no ids."""
    hits = search.conjunctive_by_masks(corpus, patterns)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    near = hits.withColumn("_r", F.row_number().over(Window.partitionBy("pid", part).orderBy("doc_id"))).where(F.col("_r") <= most)
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy("pid").orderBy("doc_id"))).where(F.col("_r") <= most)
    ids = first.groupBy("pid").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    known = search.exploded(patterns).join(corpus.term_stats.select("term", "df"), "term", "left").groupBy("pid").agg(F.min(F.col("df").isNotNull()).alias("complete"))
    rows = known.join(ids, "pid", "left").select("pid", "complete", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))
    return rows.select("pid", F.to_json(F.struct(F.col("pid").alias("qid"), "complete", "ids")).alias("reply"))
