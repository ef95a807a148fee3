"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words.  A source gives at most
``MAX_EPOCHS`` times its words; what is above is shared again by weight.  With the sources ordered by size per weight, the ones at
their limit are the first few, so prefix sums over the table of sources find the final shares in one step.

A source takes ``floor(target / size)`` complete epochs, then part of one more: documents in ascending order of the
exponential key -ln(u) / quality until the rest of the target is used up; the last one is cut there.  u is a hash of doc_id and text, so reruns agree; the
quality weight of a document is the share of letters among its characters that aren't white space (0.05 at least).

No source is ever sorted in one task: keys fall into bins of a fixed range of ln(key), words are summed by source and bin before the shuffle, the prefix sums run over
that small table, and only rows of one bin are put in order together.  Whatever the qualities are, at most a share of 1 / e of the documents lies in any range of 1 of
ln(key), so a bin has about ``BIN_DOCS`` documents at most.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of its own; without any word every target
is 0; rows with equal doc_id and text are interchangeable.  Extra columns are ignored.
"""

from __future__ import annotations

from math import e

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written as stored
from .frames import map_blocks, sums_by, texts_of
from .textkernel import SPACE, word_spans

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
MIN_QUALITY = 0.05
BIN_DOCS = 1_000
#: Fewest bins of a range of 1 of ln(key).
MIN_BINS = 16

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, the quality weight and the text's MD5, of whole texts."""

    def kernel(rows, data, borders):
        _, _, first = word_spans(data, borders, ~SPACE)
        letters, solid = (sums_by(table[data].astype(np.int64), borders) for table in (_LETTER, ~SPACE))
        return [rows.column(0), rows.column(2), np.diff(first), np.maximum(MIN_QUALITY, letters / np.maximum(solid, 1)), rows.column(3)]

    return map_blocks(texts_of(docs, F.col("source").cast("string").alias("source"), digest(docs).alias("digest")), kernel, "doc_id long, source string, size long, quality double, digest string")


def digest(docs: DataFrame):
    """MD5 of a row's text, of a null as of an empty one."""
    return F.md5(F.encode(F.coalesce(docs["text"].cast("string"), F.lit("")), "UTF-8"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size), a small table."""
    name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(name) - 1) % len(weights) + 1).cast("long")
    limit = F.col("source_size") * most
    fill = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest_words = F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0))
    rest_weight = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    above = (limit.cast("double") * rest_weight < rest_words.cast("double") * F.col("weight")).cast("int")
    ordered = sizes.withColumn("weight", w).withColumn("total", F.sum("source_size").over(everything)).withColumn("above", above)
    full = ordered.withColumn("full", F.min("above").over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.col("total") - F.sum(F.when(F.col("full") == 1, limit).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("full") == 0, F.col("weight")).otherwise(0)).over(everything)
    target = F.when(F.col("full") == 1, limit.cast("double")).otherwise((left * F.col("weight")).cast("double") / open_weight.cast("double"))
    return full.select("source", "source_size", target.alias("target"))


def binned(sized: DataFrame, n: int) -> DataFrame:
    """The n measured rows with their key and its bin."""
    bins = max(MIN_BINS, round(n / e / BIN_DOCS))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("digest"))
    u = (F.conv(F.substring(F.md5(F.encode(named, "UTF-8")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return sized.withColumn("key", -F.log(u) / F.col("quality")).withColumn("bin", F.floor(F.log("key") * bins).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """Every document with doc_id, source, size, source_size, target, taken (words), copies (whole texts, the cut one rounded) and digest of its text."""
    sized = stored(measured(docs), "sizes")
    n = sized.count()
    keyed = binned(sized, n)
    by_bin = stored(keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    aims = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    spent = F.coalesce(F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = by_bin.select(F.col("source").alias("s"), "bin", "bin_size").join(aims, F.col("s").eqNullSafe(F.col("source")))
    table = same.withColumn("spent", spent).select("s", F.col("bin").alias("b"), "source_size", "target", "spent")
    joined = keyed.join(table, keyed.source.eqNullSafe(table.s) & (keyed.bin == table.b))
    before = Window.partitionBy("s", "b").orderBy("key", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("spent") + F.coalesce(F.sum("size").over(before), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("rest")).cast("long") - F.col("at")))
    out = joined.withColumn("at", at).withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("part", part)
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        F.when(F.col("size") > 0, F.col("epochs") + (F.col("part") * 2 >= F.col("size")).cast("long")).otherwise(0).alias("copies"),
        "digest",
    )


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(documents: str = "documents") -> str:
    """DuckDB SQL of ``mix``, with a row of all columns for each document."""
    return rf"""
sized AS (
  SELECT doc_id, source, n AS size, greatest({MIN_QUALITY}, letters / greatest(solid, 1)::DOUBLE) AS quality,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || digest), 1, 12))::BIGINT + 0.5) / {1 << 48}::DOUBLE AS u, digest
  FROM (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n,
    strlen(regexp_replace(coalesce(text, ''), '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS letters,
    strlen(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS solid FROM {documents}) m),
sources AS (
  SELECT source, source_size, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight,
    sum(source_size) OVER () AS total
  FROM (SELECT source, sum(size) AS source_size FROM sized GROUP BY source) s),
marked AS (
  SELECT *, CASE WHEN ({MAX_EPOCHS} * source_size)::DOUBLE * sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    < (total - coalesce(sum({MAX_EPOCHS} * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE * weight THEN 1 ELSE 0 END AS above
  FROM sources),
filled AS (SELECT *, min(above) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM marked),
aims AS (
  SELECT source, source_size::BIGINT AS source_size, CASE WHEN done = 1 THEN ({MAX_EPOCHS} * source_size)::DOUBLE
    ELSE ((total - sum(CASE WHEN done = 1 THEN {MAX_EPOCHS} * source_size ELSE 0 END) OVER ()) * weight)::DOUBLE / (sum(CASE WHEN done = 0 THEN weight ELSE 0 END) OVER ())::DOUBLE END AS target
  FROM filled),
ordered AS (
  SELECT d.doc_id, d.source, d.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.quality, d.doc_id, d.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
mixed AS (
  SELECT doc_id, source, size, source_size, target, (epochs * size + part)::BIGINT AS taken, CASE WHEN size > 0 THEN epochs + CASE WHEN part * 2 >= size THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies
  FROM (SELECT *, greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - behind))::BIGINT AS part FROM ordered) p)"""


OP3_SQL = f"WITH {mix_sql().strip()} SELECT doc_id, size, source_size, target, taken FROM mixed"
