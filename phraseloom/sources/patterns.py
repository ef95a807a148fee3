"""Readers and writers of query and pattern files, and the result sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of a pattern line, and of the older kind.
FIELDS = ["id", "bucket", "m", "sp", "ep", "ndoc", "nocc", "list_size_sum", "min_list_size", "tokens"]
OLD_FIELDS = ["bucket", "ndoc", "m", "sp", "ep", "nocc", "tokens"]
#: Columns of a benchmark's result sheet.
RESULT_FIELDS = ["type", "id", "len", "ndoc", "nocc", "list_sum", "min_list_len", "bucket", "time_ns"]


def _typed(name: str):
    return F.split(name, ",").cast("array<int>").alias(name) if name == "tokens" else F.col(name).cast("long").alias(name)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id;bucket;m;sp;ep;ndoc;nocc;list_size_sum;min_list_size;t,t,...``."""
    return spark.read.schema(", ".join(f"{f} string" for f in FIELDS)).csv(path, sep=";").select(*map(_typed, FIELDS))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1) and value of the lines of text files, however they are split: each split's lines are counted, and the splits before it in its file are added up.

    Lines that are read one after another have ids one after another, so a line's place in its split is its id less the split's first.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "split", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return lines.join(F.broadcast(splits), ["file", "split"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("number"), "value")


def read_old_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``bucket;ndoc;m;sp;ep;nocc;t,t,...``; id is the number of the line in its file, from 1; empty lines are counted and left out."""
    parts = numbered_lines(spark, path).where("value <> ''").select(F.col("number").alias("id"), F.split("value", ";").alias("p"))
    return parts.select("id", *(F.col("p")[i].alias(f) for i, f in enumerate(OLD_FIELDS))).select("id", *map(_typed, OLD_FIELDS))


def write_patterns(patterns: DataFrame, path: str) -> None:
    patterns.select(F.concat_ws(";", *(F.col(f).cast("string") for f in FIELDS[:-1]), F.concat_ws(",", F.col("tokens").cast("array<string>"))).alias("value")).write.text(path)


def write_results(results: DataFrame, path: str) -> None:
    results.select(*RESULT_FIELDS).write.csv(path, sep=";", header=True)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``qid;word word ...`` as (qid, words)."""
    parts = F.split("value", ";", 2)
    return spark.read.text(path).where("value <> ''").select(parts[0].cast("long").alias("qid"), F.filter(F.split(parts[1], " "), lambda x: x != "").alias("words"))


def parse_queries(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(qid, words) to (qid, complete, ids, missing): ids of the words before the first unknown one; complete if none is unknown."""
    rows = queries.select("qid", F.posexplode_outer("words").alias("off", "term")).join(dictionary, "term", "left")
    known = F.min(F.when(F.col("term").isNotNull() & F.col("term_id").isNull(), F.col("off"))).over(Window.partitionBy("qid"))
    rows = rows.withColumn("stop", known)
    at = F.array_sort(F.collect_list(F.when(F.col("term_id").isNotNull() & (F.col("stop").isNull() | (F.col("off") < F.col("stop"))), F.struct("off", "term_id"))))
    missing = F.array_sort(F.collect_list(F.when(F.col("term_id").isNull() & F.col("term").isNotNull(), F.struct("off", "term"))))
    out = rows.groupBy("qid").agg(F.max("stop").isNull().alias("complete"), at.alias("a"), missing.alias("b"))
    return out.select("qid", "complete", F.col("a.term_id").alias("ids"), F.col("b.term").alias("missing"))
