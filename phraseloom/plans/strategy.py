"""Choice of a phrase strategy for a batch of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search, suffixes
from ..sources.corpus import Corpus

#: A list as long as this many times the rarest word's makes aligning all lists dearer than a join for each word.
STEEP = 50


def costs(corpus: Corpus, patterns: DataFrame) -> dict[str, int]:
    """What the strategies would read for the batch, from the statistics of its words: all positions of all words (align), and those of each pattern's rarest word, once a word (chain)."""
    terms = search.ordered_terms(corpus, patterns).join(corpus.term_stats.select("term", "cf"), "term")
    by_pattern = terms.groupBy("pid", "m").agg(F.sum("cf").alias("all"), F.min("cf").alias("rarest"))
    row = by_pattern.agg(F.sum("all").alias("align"), F.sum(F.col("rarest") * F.col("m")).alias("chain"), F.max("m").alias("longest"), F.min("m").alias("shortest")).first()
    return {k: int(v or 0) for k, v in row.asDict().items()}


def choose(corpus: Corpus, patterns: DataFrame) -> str:
    """The strategy with the least to read.

    An interval of the suffix table holds just the matches, and pairs of words are far rarer than words: the first is taken where that table is there and the patterns are short enough,
    the second where the pair table is; else the statistics decide between aligning all lists at once and going on from the rarest word by one join a word.
    """
    if "ordered" in corpus.__dict__ and (patterns.agg(F.max(F.size("tokens"))).first()[0] or 0) < suffixes.DEPTH:
        return "suffix"
    if "bigram_positions" in corpus.__dict__:
        return "bigram"
    cost = costs(corpus, patterns)
    return "chain" if cost["chain"] and cost["align"] > STEEP * cost["chain"] else "align"


def phrase_starts(corpus: Corpus, patterns: DataFrame) -> DataFrame:
    """(pid, doc_id, pos) by the chosen strategy; all give the same rows."""
    chosen = choose(corpus, patterns)
    if chosen == "suffix":
        return suffixes.phrase_starts_by_suffixes(corpus, patterns)
    if chosen == "bigram":
        return search.phrase_starts_by_bigrams(corpus, patterns)
    if chosen == "chain":
        return search.phrase_starts_chained(corpus, patterns, costs(corpus, patterns)["longest"])
    return search.phrase_starts(corpus, patterns)
