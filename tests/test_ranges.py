"""Ranks of suffixes from packed ranges against the plain order of the texts."""

import pytest
from test_windows import corpus

from phraseloom.operators import ranges, suffixes, windows
from phraseloom.plans import catalog
from phraseloom.sources import corpus as corpora
from phraseloom.sources.corpus import Corpus


@pytest.mark.parametrize("words, rows, frequent, depth", [(5, 20, 3, 10), (40, 30, 0, 2), (1 << 19, 1 << 19, 1 << 16, 10)])
def test_starts_equal_plain_order(spark, monkeypatch, words, rows, frequent, depth):
    """Ranges cut everywhere, keys that fill a range of their own and are dealt out, ids below 0, copies and ends of documents."""
    for module, k, v in [(windows, "WORDS", words), (ranges, "ROWS", rows), (ranges, "FEWEST", rows), (windows, "FREQUENT", frequent), (windows, "CHUNK", 8)]:
        monkeypatch.setattr(module, k, v)
    c = corpus(spark)
    texts = {r.doc_id: (r.text or "").split() for r in c.documents.collect()}
    keys = sorted(([w.encode() for w in t[p : p + depth]], d, p) for d, t in texts.items() for p in range(len(t)))
    first, want = {}, {}
    for i, (k, d, p) in enumerate(keys):
        want[d, p] = first.setdefault(tuple(k), len(texts) + 1 + i)
    rows = ranges.starts(c, depth).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.pos): r.start for r in rows} == want


def test_ranks_build_no_table(spark, data, monkeypatch):
    monkeypatch.setattr(corpora, "_opened", {})
    monkeypatch.setattr(Corpus, "ordered", property(lambda self: pytest.fail("the table of suffixes is built")))
    assert catalog.QUERIES["suffix_ranks"](spark, data).count() > 0


def test_empty_collection_has_no_ranks(spark):
    c = Corpus(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert suffixes.batch_heads(c).count() == 0
