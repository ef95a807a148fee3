"""Consistency checks: each gives one row, the number of mismatches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import WORDS
from ..functions.tokens import words
from ..sources.corpus import Corpus
from ..sources.store import written
from . import layouts, search, workload
from .windows import CHUNK


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one frame has more often than the other; both are added up in one shuffle."""
    both = left.withColumn("_n", F.lit(1)).unionByName(right.select(left.columns).withColumn("_n", F.lit(-1)))
    return both.groupBy(left.columns).agg(F.sum("_n").alias("_n")).agg(F.coalesce(F.sum(F.abs("_n")), F.lit(0)).cast("long").alias("mismatches"))


def _gathered():
    """The kernel for rows (doc_id, term, tf): doc_id, terms (joined by spaces), tfs, the rows of a document in one, about ``WORDS`` of them at a time."""
    limit = WORDS

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def gathered(held):
            table = pa.Table.from_batches(held).combine_chunks()
            docs = pc.fill_null(table["doc_id"], -(1 << 62)).to_numpy()
            order = docs.argsort(kind="stable")
            docs, table = docs[order], table.take(pa.array(order)).combine_chunks()
            first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            offsets = pa.array(np.append(first, len(docs)).astype(np.int32))
            names = pc.replace_substring(pc.fill_null(table["term"].cast(pa.string()), ""), " ", "\x01")  # such a term is no word, but one row
            terms = pc.binary_join(pa.ListArray.from_arrays(offsets, names.combine_chunks()), " ")
            found = pa.RecordBatch.from_arrays([pa.array(docs[first]), terms, pa.ListArray.from_arrays(offsets, table["tf"].combine_chunks())], ["doc_id", "terms", "tfs"])
            for lo in range(0, found.num_rows, 1_024):
                yield found.slice(lo, 1_024)

        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= limit:
                yield from gathered(held)
                held, n = [], 0
        if n:
            yield from gathered(held)

    return run


def _compared():
    """The kernel of a group: mismatches of the stored lists (doc_id, terms, tfs) with the words of the texts (doc_id, text), a document at a time."""

    def compared(texts, stored):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def apart(table, column):
            lists = pc.split_pattern(table[column].combine_chunks().cast(pa.string()), " ")
            return lists.flatten(), np.repeat(table["doc_id"].to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))

        (fresh, own), (kept, theirs) = apart(texts, "text"), apart(stored, "terms")
        of = np.concatenate([own, theirs])
        coded = pa.concat_arrays([fresh.cast(pa.string()), kept.cast(pa.string())]).dictionary_encode()
        tf = pc.fill_null(stored["tfs"].combine_chunks().flatten(), -1).to_numpy(zero_copy_only=False)  # a missing count is no count
        number, document = coded.indices.to_numpy().astype(np.int64), np.unique(of, return_inverse=True)[1]
        pair = np.unique(document * max(len(coded.dictionary), 1) + number, return_inverse=True)[1]
        n = int(pair.max()) + 1 if len(pair) else 0
        a, b = pair[: len(fresh)], pair[len(fresh) :]
        counted, rows, total = np.bincount(a, minlength=n), np.bincount(b, minlength=n), np.zeros(n, np.int64)
        np.add.at(total, b, tf)
        wrong = np.where((rows == 1) & (total == counted), 0, rows + (counted > 0))
        return pa.table({"wrong": pa.array([int(wrong.sum())], pa.int64())})

    return compared


def postings(corpus: Corpus) -> DataFrame:
    """Stored postings against counts from the texts: each document's rows travel as one list, its text as a text, and both are compared in groups of documents."""
    chunk = F.floor(F.col("doc_id") / CHUNK).alias("chunk")
    fresh = corpus.documents.select("doc_id", words("text").alias("w")).where(F.size("w") > 0).select(chunk, "doc_id", F.array_join("w", " ").alias("text"))
    stored = corpus.postings.select("doc_id", "term", "tf").mapInArrow(_gathered(), "doc_id long, terms string, tfs array<long>").select(chunk, "doc_id", "terms", "tfs")
    met = fresh.groupBy("chunk").cogroup(stored.groupBy("chunk")).applyInArrow(_compared(), "wrong long")
    return met.agg(F.coalesce(F.sum("wrong"), F.lit(0)).cast("long").alias("mismatches"))


def relative_positions(corpus: Corpus) -> DataFrame:
    """Decoded gaps against the positions of the words."""
    gaps = layouts.relative(corpus.places, ["term"]).select("term", "doc_id", "pos", F.col("pos").alias("ord"), "gap")
    return layouts.absolute(gaps, ["term"]).agg(F.count(F.when(~F.col("decoded").eqNullSafe(F.col("pos")), 1)).alias("mismatches"))


def bigrams(corpus: Corpus) -> DataFrame:
    """Every listed pair stands at its place in the text."""
    listed = corpus.bigram_positions.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "t1", "t2")).alias("listed"))
    rows = corpus.split.where("size(w) > 1").join(listed, "doc_id", "full")
    right = F.filter("listed", lambda x: F.coalesce((F.get("w", x["pos"].cast("int")) == x["t1"]) & (F.get("w", x["pos"].cast("int") + 1) == x["t2"]), F.lit(False)))
    met = rows.select(F.coalesce(F.size("w") - 1, F.lit(0)).alias("n"), F.coalesce(F.size("listed"), F.lit(0)).alias("k"), F.coalesce(F.size(F.array_distinct(F.transform(right, lambda x: x["pos"]))), F.lit(0)).alias("met"))
    return met.agg(F.coalesce(F.sum(F.col("n") + F.col("k") - 2 * F.col("met")), F.lit(0)).cast("long").alias("mismatches"))


def strategies(corpus: Corpus, patterns: DataFrame, longest: int) -> DataFrame:
    """The four phrase strategies against each other."""
    base = written(search.phrase_starts(corpus, patterns), "phrase-starts")
    others = [search.phrase_starts_chained(corpus, patterns, longest), search.phrase_starts_by_bigrams(corpus, patterns), search.phrase_starts_by_grams(corpus, patterns, longest)]
    found = [differing(base, o) for o in others]
    return found[0].unionAll(found[1]).unionAll(found[2]).agg(F.sum("mismatches").alias("mismatches"))


def counts(corpus: Corpus, patterns: DataFrame, longest: int) -> DataFrame:
    """ndoc and nocc of phrase queries against n-gram counts."""
    queried = workload.result_stats(search.phrase_starts(corpus, patterns), patterns)
    counted = workload.result_stats(search.phrase_starts_by_grams(corpus, patterns, longest), patterns)
    return differing(queried, counted)
