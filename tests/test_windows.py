"""n-grams from packed windows against those of the suffix table."""

import random

import pytest

from phraseloom.operators import suffixes, windows, workload
from phraseloom.plans import catalog
from phraseloom.sources import corpus as corpora
from phraseloom.sources.corpus import Corpus


def corpus(spark, seed=11, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["a", "b", "é", "𐐀", "zz"]) for _ in range(rng.randint(0, 16))) for _ in range(n)]
    texts += [texts[3], texts[3] + " a", "", None, "a " * 40, "a " * 40, " ".join(f"u{i}" for i in range(30)), *["x y " + " ".join(f"q{i}" for i in range(14))] * 5]
    return Corpus(spark.createDataFrame([(7 * i - 50, t) for i, t in enumerate(texts)], "doc_id long, text string"))


@pytest.mark.parametrize("words, rows, frequent, chunk", [(5, 20, 3, 64), (1 << 19, 100, 0, 1_024), (1 << 19, 1 << 20, 1 << 16, 1_024)])
def test_windows_equal_table(spark, monkeypatch, words, rows, frequent, chunk):
    """A few words at a time, runs over the ends of many ranges, words by both tables; copies, ends of documents, ids below 0."""
    for k, v in {"WORDS": words, "ROWS": rows, "FREQUENT": frequent, "CHUNK": chunk}.items():
        monkeypatch.setattr(windows, k, v)
    c = corpus(spark)
    keep = lambda f: sorted((r.m, r.gram, r.nocc, r.ndoc, r.sp) for r in f.collect())
    got = keep(workload.gram_stats(c))
    assert "ordered" not in c.__dict__ and "postings" not in c.__dict__
    assert got == keep(suffixes.texts(c, suffixes.grams(c))) and {m for m, *_ in got} == set(range(2, 11))
    ids = {r.term: r.term_id for r in c.dictionary.collect()}
    for r in suffixes.texts(c, windows.grams(c)).select("m", "gram", suffixes.ids("head", "m").alias("ids")).collect():
        assert r.ids == [ids[w] for w in r.gram.split()]


@pytest.mark.parametrize("name", ["ngram_stats", "generated_sizes", "generated_result_stats"])
def test_query_builds_no_table(spark, data, monkeypatch, name):
    monkeypatch.setattr(corpora, "_opened", {})
    monkeypatch.setattr(Corpus, "ordered", property(lambda self: pytest.fail("the table of suffixes is built")))
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_empty_collection_has_no_grams(spark):
    c = Corpus(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert workload.gram_stats(c).count() == 0
