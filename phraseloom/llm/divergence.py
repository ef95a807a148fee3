"""Source divergence audit: how the vocabulary of a source differs from that of its language and of the language's other sources.

The vocabulary of a language is the terms of at least ``MIN_DOCS`` of its documents.  Every group (lang, source), and every language, gives a term the smoothed share
p = 1 + floor(10^9 (count + 5) / (N + 5 V)); sums and quotients are exact (decimals in Spark, integers below 2^53 in numpy).

* Counting: one pass over whole texts; a task sends a row for each (lang, source, term) of about 8 MB of text, with occurrences and documents.  As a document has one source, document counts of
  the sources add up to those of the language.
* Part ``term`` by radix select (``radix_top``): histograms over ten bits of the values at a time find each group's k-th value; rows with that very value are told
  apart by histograms over the next two UTF-8 bytes.  A histogram has at most 65,537 rows for each group, whatever the group holds, and is added up before the shuffle.
* Part ``pair``: every pair of sources has the sum of abs(p - q) over all terms.  A term that neither source holds adds the difference of their baselines (the shares at
  count 0), so V times that difference is corrected by the terms that one of them holds, and once more by those that both hold.  Terms are dealt in blocks of ``BLOCK`` rows; a block adds
  all its corrections up before it sends a row for each pair.  Sources are taken ``TILE`` at a time, so a block never has more than two tiles' pairs in memory.

Defined cases: null lang, source and text are ''; a group without terms has its row of pairs (its shares are all the baseline); in a language without vocabulary pairs have value 0
and there is no ``term`` row; ties are in the UTF-8 order of items; repeated rows are documents of their own; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .frames import map_arrow, schema_of
from .textkernel import LOWER, WORD_HASH, blocks, equal_groups, mix64, owners, strings, word_spans

MIN_DOCS = 30
TOP = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of text from which a task adds terms up at a time.
PIECE = 8 << 20
BLOCK = 250_000
TILE = 256
#: Ties that are put in order by a window once the histograms have left no more.
FEW = 4_096

#: Bytes of terms: A-Z, a-z and everything outside ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), over whole texts."""
    target = schema_of(docs.sparkSession, _COUNTS)

    def run(batches):
        for batch in batches:
            for lo, hi, data, borders in blocks(batch.column(2), PIECE):
                langs, sources = (batch.column(i).slice(lo, hi - lo).dictionary_encode() for i in (0, 1))
                group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                data = LOWER[data]
                starts, ends, first = word_spans(data, borders, LETTERS)
                if not len(starts):
                    continue
                doc = owners(first, np.arange(len(starts)))
                tag = group[doc]
                order, at = equal_groups(mix64(WORD_HASH.words(data, starts, ends) ^ mix64(tag.astype(np.uint64) + np.uint64(1))), data, starts, ends, tag)
                new = np.ones(len(order), np.int64)  # the first word of a document in its group of equal words
                new[1:] = doc[order][1:] != doc[order][:-1]
                new[at] = 1
                one = order[at]
                lang, source = np.divmod(tag[one], len(sources.dictionary))
                columns = [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), strings(data, starts[one], ends[one])]
                columns += [pa.array(np.diff(np.append(at, len(order)))), pa.array(np.add.reduceat(new, at))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return map_arrow(texts, run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, total: str = "total", terms: str = "terms") -> Column:
    """p of a count, of the words of all terms and the number of terms; 0 without terms."""
    n = n if isinstance(n, str) else n._jc.toString()
    of = f"(cast({total} as decimal(19, 0)) + {PRIOR} * cast({terms} as decimal(18, 0)))"
    return F.expr(f"if({terms} = 0, 0L, 1L + cast({SCALE} as decimal(10, 0)) * (cast({n} as decimal(19, 0)) + {PRIOR}) div {of})")


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int, few: int = FEW) -> DataFrame:
    """The ``k`` rows of each group with the largest values (0 or more), and its rank from 1; equal values in the UTF-8 order of ``item``, whose values are distinct in a group.

    ``rows`` is read once for each histogram, so it should be a written table.
    """
    most = rows.agg(F.max(value)).first()[0]
    shift = -(-max(int(most or 0).bit_length(), 1) // 10) * 10
    down = Window.partitionBy(*keys).orderBy(F.desc("digit"))
    state = None
    while shift:
        width, shift = 10, shift - 10
        digit = F.shiftright(value, shift)
        near = rows if state is None else rows.join(state, keys).where(F.shiftright(value, shift + width) == F.col("prefix"))
        need = F.lit(k).cast("long") if state is None else F.col("need")
        hist = near.withColumn("need", need).groupBy(*keys, digit.alias("digit")).agg(F.count("*").alias("n"), F.max("need").alias("need"))
        hist = hist.withColumn("above", F.sum("n").over(down) - F.col("n")).where("above < need")
        state = hist.groupBy(*keys).agg(F.min("digit").alias("prefix"), F.min(F.col("need") - F.col("above")).alias("need"), F.min_by("n", "digit").alias("there"))
        state = written(state, "radix")
    limits = state.withColumn("head", F.lit("").cast("binary"))
    above = rows.join(state, keys).where(F.col(value) > F.col("prefix"))
    ties, depth, up = rows.join(state, keys).where(F.col(value) == F.col("prefix")).drop("prefix", "need", "there"), 0, Window.partitionBy(*keys).orderBy("digit")
    if limits.where(F.col("there") > F.greatest(F.col("need"), F.lit(few))).isEmpty():
        chosen = ties.join(limits, keys)
    else:
        ties, before = written(ties.withColumn("raw", F.encode(item, "UTF-8")), "ties"), None
        while True:
            within = F.substring("raw", 1, depth) == F.col("head")
            head = F.substring("raw", 1, depth + 2)
            hist = ties.join(limits, keys).where(within).groupBy(*keys, head.alias("digit")).agg(F.count("*").alias("n"), F.max("need").alias("need"))
            hist = hist.withColumn("below", F.sum("n").over(up) - F.col("n")).where("below < need")
            after = written(hist.groupBy(*keys).agg(F.max("digit").alias("head"), F.min(F.col("need") - F.col("below")).alias("need"), F.max_by("n", "digit").alias("there")), "radix")
            # rows whose bytes come before the head are in, those with the head stay in question
            sure = ties.join(limits.select(*keys, F.col("head").alias("old")), keys).join(after.select(*keys, "head"), keys)
            sure = sure.where((F.substring("raw", 1, depth) == F.col("old")) & (F.substring("raw", 1, depth + 2) < F.col("head"))).select(rows.columns)
            before = sure if before is None else before.unionByName(sure)
            limits, depth = after, depth + 2
            if limits.where(F.col("there") > F.greatest(F.col("need"), F.lit(few))).isEmpty():
                break
        chosen = ties.join(limits, keys).where(F.substring("raw", 1, depth) == F.col("head"))
        above = above.select(rows.columns).unionByName(before)
    last = chosen.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(item))).where("at <= need")
    found = above.select(rows.columns).unionByName(last.select(rows.columns))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), item)))


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b)


def pair_sums(term: np.ndarray, of: np.ndarray, p: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The corrections of a block for all pairs of sources: the sum of abs(p - q) - abs(baselines' difference) over the terms.

    term: a number for each row's term; of: its source; p: its share; base: shares of the sources at count 0.
    """
    n = len(base)
    alone = np.zeros((n, n))  # a term's holder (row) against a source that is taken to have its baseline (column)
    for t in range(n):
        alone[:, t] = np.bincount(of, _differences(p, base[t]) - _differences(base[of], base[t]), n)
    order = np.lexsort((of, term))
    term, of, p = term[order], of[order], p[order]
    both, lag = np.zeros(n * n), 1
    while lag < len(term):
        i = np.flatnonzero(term[lag:] == term[:-lag])
        if not len(i):
            break
        j = i + lag
        more = _differences(p[i], p[j]) - _differences(p[i], base[of[j]]) - _differences(base[of[i]], p[j]) + _differences(base[of[i]], base[of[j]])
        both += np.bincount(of[i] * n + of[j], more, n * n)
        lag += 1
    both = both.reshape(n, n)
    return (alone + alone.T + both + both.T).astype(np.int64)


def divergence_pairs(rows: DataFrame, groups: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, a, b, value for every two sources of a language, a before b.

    rows: lang, source, term, p of the terms that a source holds; groups: lang, source, base (its share at count 0), terms (V of its language).
    """
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    tiled = groups.withColumn("place", place).withColumn("tile", F.floor(F.col("place") / tile))
    tiled = tiled.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)
    chunks = ceil(max(rows.count(), 1) / block)
    both = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    meet = lambda d: d.withColumn("other", both).withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other"))
    held = meet(rows.join(tiled.select("lang", "source", "place", "tile", "tiles"), ["lang", "source"]))
    held = held.select("lang", "x", "y", F.pmod(F.xxhash64("term"), F.lit(chunks)).alias("chunk"), "term", "place", "p")
    listed = meet(tiled).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("chunk", F.col("chunk").cast("long"))
    listed = listed.select(*(F.col(c).alias(c) for c in ("lang", "x", "y", "chunk", "place", "tile", "source", "base", "terms")))  # columns of its own, as both sides come from ``tiled``
    keys = ["lang", "x", "y", "chunk"]

    def sums(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("place")
        places, base, names, tiles = right["place"].to_numpy(), right["base"].to_numpy().astype(np.float64), right["source"].to_numpy(), right["tile"].to_numpy()
        found = pair_sums(pd.factorize(left["term"])[0], np.searchsorted(places, left["place"].to_numpy()), left["p"].to_numpy().astype(np.float64), base)
        if key[3] == 0:
            found += (_differences(base[:, None], base[None, :]).astype(np.int64)) * int(right["terms"].iloc[0])
        i, j = np.triu_indices(len(base), 1)
        if key[1] != key[2]:
            apart = tiles[i] != tiles[j]
            i, j = i[apart], j[apart]
        return pd.DataFrame({"lang": key[0], "a": names[i], "b": names[j], "value": found[i, j]})

    parts = held.groupBy(*keys).cogroup(listed.groupBy(*keys)).applyInPandas(sums, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank; see the module's text."""
    counts = written(term_counts(docs), "term-counts")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept-terms")
    held = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    there = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = there.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"])
    groups = written(groups.withColumn("base", share("0")), "groups")
    held = held.join(groups, ["lang", "source"])
    held = written(held.select("lang", "source", "term", share("n").alias("p"), share("all_n", "lang_total").alias("q")), "shares")

    over = written(held.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "over")
    terms = radix_top(over, ["lang", "source"], "value", "item", top)
    pairs = divergence_pairs(held.select("lang", "source", "term", "p"), groups)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", sides.alias("s")).select("lang", "s.source", "s.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    shape = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pairs, "pair").unionByName(shape(terms, "term"))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = f"1 + ({SCALE}::HUGEINT * ({{n}} + {PRIOR})) // ({{total}} + {PRIOR} * {{v}})"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
cnt AS MATERIALIZED (SELECT t.lang, t.source, t.term, count(*) AS n FROM tok t SEMI JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
lg AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(lg.v, 0) AS v, coalesce(lg.total, 0) AS lang_total, coalesce((SELECT sum(n) FROM cnt c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN lg ON x.lang = lg.lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", total="g.total", v="g.v")} AS p, {_P.format(n="k.n", total="g.lang_total", v="g.v")} AS q
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT, r::INT FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS r FROM p WHERE n > 0 AND p > q) z WHERE r <= {TOP}""".strip()
