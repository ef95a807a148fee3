"""n-gram statistics, workload buckets, and pattern evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import Corpus
from ..sources.store import released, rows_at_a_time, running_total
from . import search, suffixes

#: Document counts [from, to] of the buckets 0 to 7; all others are bucket -1.
BUCKETS = [(0, 24), (50, 100), (250, 500), (1_000, 5_000), (10_000, 25_000), (100_000, 250_000), (1_000_000, 2_500_000), (10_000_000, 25_000_000)]


def bucket(ndoc: Column) -> Column:
    return F.coalesce(*(F.when(ndoc.between(lo, hi), F.lit(i)) for i, (lo, hi) in enumerate(BUCKETS)), F.lit(-1)).cast("long")


def bucket_sql(ndoc: str) -> str:
    return "CASE " + " ".join(f"WHEN {ndoc} BETWEEN {lo} AND {hi} THEN {i}" for i, (lo, hi) in enumerate(BUCKETS)) + " ELSE -1 END::BIGINT"


def gram_stats(corpus: Corpus, least: int = 2, columns: tuple[str, ...] = ("nocc", "ndoc", "sp", "head")) -> DataFrame:
    """m, gram, nocc, ndoc, sp, head (or the columns asked for) of the right-maximal n-grams (two or more different continuations) of 2 to 10 words that occur ``least`` times or more, all from one pass over the suffixes in order."""
    return suffixes.batch_grams(corpus, least, *columns).select("m", "gram", *columns)


def first_per_bucket(patterns: DataFrame, n: int, most_bucket: int = 6, order: tuple[str, ...] = ("pid",)) -> DataFrame:
    """The first ``n`` patterns of each bucket in order, buckets 0 to ``most_bucket``.

    Two steps, so that a full bucket isn't sorted in one task: the first n of each of 64 parts, then the first n of those.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    near = patterns.where(F.col("bucket").between(0, most_bucket)).withColumn("_r", F.row_number().over(Window.partitionBy("bucket", part).orderBy(*order))).where(F.col("_r") <= n)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("_r") <= n).drop("_r")


#: Fixed value: the seed of the draw.
SEED = "4711"
#: Deviations by which the bound of a bucket's hashes lies above the draw.
SLACK = 10
#: Documents whose texts are compressed at a time.
DOCUMENTS = 2_048


def generated(corpus: Corpus, most: int) -> DataFrame:
    """id (from 1, by bucket, size and words), bucket, m, gram, ids, ndoc, nocc, sp, ep: the right-maximal n-grams, at most ``most`` of each bucket.

    A full bucket keeps those with the lowest hash of seed and words, a draw over all sizes alike.  Places travel to the texts, and only n-grams whose hash is below their bucket's bound come back.
    """
    found = suffixes.batch_places(corpus, 2).withColumn("bucket", bucket(F.col("ndoc"))).where("bucket >= 0")
    drawn = first_per_bucket(_drawn(corpus, found, most), most, len(BUCKETS) - 1, ("draw", "gram"))
    place = ["m", "doc_id", "pos"]  # at a place, m words are one n-gram
    chosen = found.join(F.broadcast(drawn.select(*place, "gram")), place).drop("doc_id", "pos").withColumn("one", F.lit(1)).withColumn("ep", F.col("sp") + F.col("nocc") - 1)
    return running_total(chosen, ["bucket", "m", "gram"], "one", "before", "generated").withColumn("id", F.col("before") + 1).withColumn("ids", suffixes.ids("head", "m")).drop("one", "before", "head")


def _drawn(corpus: Corpus, found: DataFrame, most: int) -> DataFrame:
    """m, doc_id, pos, bucket, gram, draw of somewhat more than the ``most`` lowest hashes of each bucket, from n-grams (m, doc_id, pos, bucket); all of a bucket that has no more.

    The bound of a bucket's hashes follows from its size, as hashes are even: ``SLACK`` deviations above ``most``.  Where fewer lie below it after all, it is raised, so the draw is exact.
    """
    size = {r.bucket: r.n for r in found.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # one row a bucket
    asked = most + SLACK * most**0.5
    while True:
        bounds = [F.when(F.col("bucket") == b, F.lit(f"{int(asked / n * 16**12):012x}")) for b, n in size.items() if asked < n]
        drawn = suffixes.batch_texts(corpus, found.select("m", "doc_id", "pos", "bucket"), "doc_id", "pos", "bucket")
        drawn = drawn.withColumn("draw", F.md5(F.encode(F.concat(F.lit(f"{SEED} "), "gram"), "UTF-8"))).where(F.col("draw") < F.coalesce(*bounds, F.lit("g")))  # "g" stands behind every hash
        with rows_at_a_time(corpus.spark, DOCUMENTS):
            drawn = released(drawn, "drawn")
        got = {r.bucket: r.n for r in drawn.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        if all(got.get(b, 0) >= min(n, most) for b, n in size.items()):
            return drawn
        asked *= 2


def old_lines(patterns: DataFrame) -> DataFrame:
    """id and line ``bucket;ndoc;m;sp;ep;nocc;t,t,...``, with the pattern's interval of the suffix table."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return patterns.select("id", F.concat_ws(";", "bucket", "ndoc", "m", "sp", "ep", "nocc", ids).alias("line"))


def from_old_lines(lines: DataFrame) -> DataFrame:
    """id, the fields of the line, and tokens, an array of term ids."""
    parts = F.split("line", ";")
    fields = ["bucket", "ndoc", "m", "sp", "ep", "nocc"]
    return lines.select("id", *(parts[i].cast("long").alias(f) for i, f in enumerate(fields)), F.split(parts[len(fields)], ",").cast("array<long>").alias("tokens"))


def new_lines(patterns: DataFrame, corpus: Corpus) -> DataFrame:
    """id and line ``id;bucket;m;sp;ep;ndoc;nocc;list_size_sum;min_list_size;t,t,...``."""
    sizes = corpus.dictionary.join(corpus.term_stats.select("term", "cf"), "term").select("term_id", "cf")
    lists = patterns.select("id", F.explode("tokens").alias("term_id")).join(sizes, "term_id").groupBy("id").agg(F.sum("cf").alias("list_size_sum"), F.min("cf").alias("min_list_size"))
    tokens = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return patterns.join(lists, "id").select("id", F.concat_ws(";", "id", "bucket", "m", "sp", "ep", "ndoc", "nocc", "list_size_sum", "min_list_size", tokens).alias("line"))


def list_stats(corpus: Corpus, patterns: DataFrame) -> DataFrame:
    """pid, list_size_sum, min_list_size over the position lists of a pattern's words."""
    sizes = search.exploded(patterns).join(corpus.term_stats, "term", "left").select("pid", F.coalesce("cf", F.lit(0)).alias("cf"))
    return sizes.groupBy("pid").agg(F.sum("cf").alias("list_size_sum"), F.min("cf").alias("min_list_size"))


def result_stats(starts: DataFrame, patterns: DataFrame) -> DataFrame:
    """pid, ndoc, nocc; 0 for patterns without a match."""
    found = search.frequencies(starts).groupBy("pid").agg(F.count("*").alias("ndoc"), F.sum("freq").alias("nocc"))
    return patterns.select("pid").join(found, "pid", "left").select("pid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("ndoc", "nocc")))


def evaluated(corpus: Corpus, patterns: DataFrame) -> DataFrame:
    """The pattern sheet: pid, bucket, m, sp, ep, ndoc, nocc, list_size_sum, min_list_size; sp and ep are 0."""
    stats = result_stats(search.phrase_starts(corpus, patterns), patterns)
    out = patterns.select("pid", F.size("tokens").cast("long").alias("m")).join(stats, "pid").join(list_stats(corpus, patterns), "pid")
    zero = F.lit(0).cast("long")
    return out.select("pid", bucket(F.col("ndoc")).alias("bucket"), "m", zero.alias("sp"), zero.alias("ep"), "ndoc", "nocc", "list_size_sum", "min_list_size")


def bigram_intervals(corpus: Corpus) -> DataFrame:
    """t1, t2, nocc, sp, ep: the suffix-array interval of every bigram.

    Suffixes that start at a separator or the terminator come first; a last word of a document sorts before the same word with a successor.
    """
    pairs = corpus.bigram_positions.groupBy("t1", "t2").agg(F.count("*").alias("nocc"))
    ends = corpus.split.where(F.size("w") > 0).select(F.element_at("w", -1).alias("t1")).groupBy("t1").agg(F.count("*").alias("nocc")).select("t1", F.lit("").alias("t2"), "nocc")
    ranked = running_total(pairs.unionByName(ends), ["t1", "t2"], "nocc", "before", "bigram-order").where("t2 <> ''")
    return ranked.crossJoin(F.broadcast(corpus.totals.select("n_docs"))).select("t1", "t2", "nocc", (F.col("before") + F.col("n_docs") + 1).alias("sp"), (F.col("before") + F.col("n_docs") + F.col("nocc")).alias("ep"))
