"""Phrase collocation mining: which phrases of two or three words stand together far more often than their parts do.

1. Pieces.  Texts are cut at punctuation and line ends; identical pieces of a language become one row with a multiplicity (counted before and after the shuffle, so a piece that a
   third of the corpus shares is one row of a task).
2. Counts.  About 2 MB of distinct pieces at a time, numpy adds up equal words, and equal pairs with their third word, weighted by multiplicity, and sends every hash bucket one
   compressed Arrow stream.  A bucket is chosen by the hash of a phrase's first two words, so a pair's count is the sum over its third words there.  The task of a bucket streams its
   parts into duckdb, which adds them up out of core: beyond ``DUCKDB_MEMORY`` it spills to a scratch folder that is removed with the task.
   Only what occurs ``LEAST`` times or more leaves the bucket: a part of a candidate occurs as often as the candidate at least, so no part is missed.
3. Parts.  Every cut of a candidate is a request for the counts of both sides, shuffled to where the counts are; the lowest score of its cuts is kept.
4. Pairs inside a longer candidate that makes up half of their occurrences go; the first ``TOP`` of each language are chosen in 64 parts, then together.

Scores are exact: quotients of decimals of up to 38 digits.  Phrases are compared as bytes everywhere, never by hash alone.

Defined cases: a null text is empty, a null language ``und``; empty texts and pieces have no words; repeated rows count again; ties are in the UTF-8 order of phrases; an empty table gives no
rows.  Extra columns are ignored, doc_id is not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .frames import map_arrow, schema_of
from .textkernel import LOWER, WORD_HASH, blocks, equal_groups, mix64, owners, strings, word_spans

LEAST = 10
TOP = 2_000
#: A pair goes when a longer candidate has so many hundredths of its occurrences.
COVERED = 50
#: Bytes of text or pieces that are added up at a time.
PIECE = 2 << 20
DUCKDB_MEMORY = "256MB"

#: Bytes at which pieces end: . , ; : ! ? and 0x0A-0x0D; words also end at 0x20 and 0x09.
ENDS = np.zeros(256, bool)
ENDS[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORDS = ~ENDS
WORDS[[0x20, 0x09]] = False
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[0x20] = False

_PARTS = pa.schema([("lang", pa.string()), ("pair", pa.large_string()), ("third", pa.large_string()), ("f", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (lower-cased words with single spaces), m (how often it stands in the texts)."""
    target = schema_of(docs.sparkSession, "lang string, piece string")

    def run(batches):
        for batch in batches:
            for lo, hi, data, borders in blocks(batch.column(1), PIECE):
                data = LOWER[data]
                starts, ends, first = word_spans(data, borders, WORDS)
                if not len(starts):
                    continue
                doc = owners(first, np.arange(len(starts)))
                number = np.cumsum(ENDS[data])[starts] + doc  # grows at every end of a piece and of a document
                size = ends - starts + 1
                at = np.zeros(len(size) + 1, np.int64)
                np.cumsum(size, out=at[1:])
                text = data[np.minimum(np.repeat(starts - at[:-1], size) + np.arange(at[-1]), len(data) - 1)]
                text[at[1:] - 1] = 0x20
                new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                after = np.append(new[1:], len(starts))
                langs = batch.column(0).slice(lo, hi - lo).take(pa.array(doc[new]))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([langs, strings(text, at[new], at[after] - 1)], target, strict=True)], schema=target)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_arrow(texts, run, "lang string, piece string").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, piece, m) put together until they hold about ``PIECE`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PIECE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _stream(columns: list) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _PARTS, strict=True)], schema=_PARTS)
    with pa.ipc.new_stream(sink, _PARTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _added_up(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, its part of the counts) of the words, pairs and triples of a batch of pieces."""
    langs = batch.column(0).dictionary_encode()
    salt = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs.dictionary.to_pylist()], np.uint64)
    code, weight = langs.indices.to_numpy().astype(np.int64), batch.column(2).to_numpy()
    for lo, hi, data, borders in blocks(batch.column(1), 1 << 62):
        starts, ends, first = word_spans(data, borders, _NOT_SPACE)
        n, piece = len(starts), owners(first, np.arange(len(starts))) + lo
        lang, m = code[piece], weight[piece]
        word = WORD_HASH.words(data, starts, ends)
        has = np.zeros((2, n + 2), bool)  # whether one and two more words follow in the piece
        has[0, : n - 1], has[1, : max(n - 2, 0)] = piece[1:] == piece[:-1], piece[2:] == piece[:-2]
        follow = lambda values, k: np.append(values[k:], np.zeros(k, values.dtype))
        pair = mix64(word * np.uint64(0x9E3779B97F4A7C15) + follow(word, 1)) ^ salt[lang]
        triple = mix64(pair * np.uint64(0x9E3779B97F4A7C15) + np.where(has[1, :n], follow(word, 2), np.uint64(1)))
        i = np.flatnonzero(has[0, :n])
        # words
        order, at = equal_groups(mix64(word ^ salt[lang]), data, starts, ends, lang)
        one = order[at]
        found = [(mix64(word ^ salt[lang])[one], lang[one], strings(data, starts[one], ends[one]), pa.nulls(len(one), pa.large_string()).fill_null(""), np.add.reduceat(m[order], at))]
        if len(i):
            stop = np.where(has[1, i], ends[np.minimum(i + 2, n - 1)], ends[np.minimum(i + 1, n - 1)])
            order, at = equal_groups(triple[i], data, starts[i], stop, lang[i])
            one = i[order[at]]
            third = np.where(has[1, one], np.minimum(one + 2, n - 1), one)  # an empty run where there is no third word
            tail = strings(data, starts[third], np.where(has[1, one], ends[third], starts[third]))
            found.append((pair[one], lang[one], strings(data, starts[one], ends[one + 1]), tail, np.add.reduceat(m[i][order], at)))
        dealt = np.concatenate([(f[0] % np.uint64(buckets)).astype(np.int64) for f in found])
        order = np.argsort(dealt, kind="stable")
        cuts = np.searchsorted(dealt[order], np.arange(buckets + 1))
        of = [langs.dictionary.take(pa.array(np.concatenate([f[1] for f in found])[order]))]
        of += [pa.chunked_array([f[c] for f in found]).combine_chunks().take(pa.array(order)) for c in (2, 3)]
        of.append(pa.array(np.concatenate([f[4] for f in found])[order]))
        for b in range(buckets):
            if cuts[b] < cuts[b + 1]:
                yield b, _stream([c.slice(cuts[b], cuts[b + 1] - cuts[b]) for c in of])


_COUNT = """SELECT lang, pair AS gram, CASE WHEN contains(pair, ' ') THEN 2 ELSE 1 END::INT AS k, sum(f)::BIGINT AS f FROM g GROUP BY lang, pair HAVING sum(f) >= {least}
UNION ALL SELECT lang, pair || ' ' || third, 3, f FROM g WHERE third <> '' AND f >= {least}
UNION ALL SELECT lang, '', 0, sum(f)::BIGINT FROM g WHERE NOT contains(pair, ' ') GROUP BY lang"""


def gram_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, gram, k (its words), f for the phrases of 1 to 3 words that occur ``least`` times; with k = 0 the occurrences of all words, in parts."""
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * docs.rdd.getNumPartitions())
    target = schema_of(docs.sparkSession, "lang string, gram string, k int, f long")

    def send(batches):
        for batch in _gathered(batches):
            for bucket, part in _added_up(batch, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.binary())], ["bucket", "part"])

    def count(batches):
        def parts():
            for batch in batches:
                for part in batch.column(1):
                    yield from pa.ipc.open_stream(pa.BufferReader(part.as_buffer()))

        with tempfile.TemporaryDirectory() as scratch, duckdb.connect() as con:  # scratch of this task alone
            for name, value in (("memory_limit", DUCKDB_MEMORY), ("temp_directory", scratch), ("threads", 1), ("preserve_insertion_order", False)):
                con.execute(f"SET {name} = {value!r}")
            con.register("parts", pa.RecordBatchReader.from_batches(_PARTS, parts()))
            con.execute("CREATE TABLE g AS SELECT lang, pair, third, sum(f)::BIGINT AS f FROM parts GROUP BY lang, pair, third")
            for batch in con.execute(_COUNT.format(least=least)).to_arrow_reader(100_000):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, target, strict=True)], schema=target)

    sent = map_arrow(pieces(docs).select("lang", "piece", "m"), send, "bucket int, part binary")
    return map_arrow(sent.repartitionById(buckets, "bucket"), count, "lang string, gram string, k int, f long")


def cuts(grams: DataFrame) -> DataFrame:
    """lang, gram, a and, of the cut with the lowest score (the first of equal ones), score, cut, l, r."""
    w = F.split("gram", " ")
    joined = lambda lo, n: F.array_join(F.slice(w, lo, n), " ")
    at = lambda k, size: F.struct(F.lit(k).alias("cut"), joined(1, k).alias("left"), joined(k + 1, size - k).alias("right"))
    asked = grams.where("k >= 2").select("lang", "gram", F.col("f").alias("a"), F.explode(F.when(F.col("k") == 2, F.array(at(1, 2))).otherwise(F.array(at(1, 3), at(2, 3)))).alias("x"))
    asked = asked.select("lang", "gram", "a", "x.*")
    for side, name in (("left", "l"), ("right", "r")):
        there = grams.where("k between 1 and 2").select("lang", F.col("gram").alias(side), F.col("f").alias(name))
        asked = asked.join(there, ["lang", side])
    whole = lambda x: f"cast({x} as decimal(16, 0))"
    score = F.expr(f"cast(1000000 as decimal(7, 0)) * ({whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b")
    return asked.groupBy("lang", "gram", "a").agg(best).select("lang", "gram", "a", "b.*")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score; see the module's text."""
    grams = written(gram_counts(docs, least), "grams")
    w = F.split("gram", " ")
    inside = F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " "))
    longer = grams.where("k = 3").select("lang", F.explode(inside).alias("gram"), "f").groupBy("lang", "gram").agg(F.max("f").alias("longest"))
    kept = cuts(grams).join(longer, ["lang", "gram"], "left").where((F.size(w) == 3) | (100 * F.coalesce("longest", F.lit(0)) < covered * F.col("a")))
    kept = kept.select("lang", F.col("gram").alias("phrase"), "a", "l", "r", "score")
    order, part = (F.desc("score"), F.desc("a"), "phrase"), F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = grams.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, m, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, piece, count(*) AS m FROM p GROUP BY lang, piece) x),
n AS (SELECT lang, sum(m * len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, gram, sum(m)::BIGINT AS f FROM (
  {" UNION ALL ".join(f"SELECT lang, {k} AS k, m, array_to_string(w[i:i + {k - 1}], ' ') AS gram FROM (SELECT lang, m, w, unnest(range(1, len(w) + {2 - k})) AS i FROM w WHERE len(w) >= {k}) x{k}" for k in (1, 2, 3))}) e
  GROUP BY lang, k, gram HAVING sum(m) >= {LEAST}),
c AS (SELECT lang, k, gram, f AS a, string_split(gram, ' ') AS s FROM g WHERE k >= 2),
q AS (SELECT c.*, cut, array_to_string(s[1:cut], ' ') AS x, array_to_string(s[cut + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c),
v AS (SELECT q.lang, q.k, q.gram, q.a, q.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * q.a * q.a) // (l.f::HUGEINT * r.f) AS score
  FROM q JOIN g l ON l.lang = q.lang AND l.gram = q.x JOIN g r ON r.lang = q.lang AND r.gram = q.y),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) AS i FROM v) z WHERE i = 1),
o AS (SELECT lang, gram, max(a) AS longest FROM (SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS gram FROM c WHERE k = 3) t GROUP BY lang, gram),
k AS (SELECT b.lang, b.gram AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN o ON b.lang = o.lang AND b.gram = o.gram WHERE b.k = 3 OR 100 * coalesce(o.longest, 0) < {COVERED} * b.a)
SELECT k.lang, k.rank::BIGINT AS rank, k.phrase, k.a, k.l, k.r, n.n, k.score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) k JOIN n ON k.lang = n.lang WHERE k.rank <= {TOP}""".strip()
