"""The whole order of the suffixes in many rounds, groups and ranges, against the naive array."""

import random

import pytest
from test_suffixes import corpus, make, naive

from phraseloom.operators import order, ranges, suffixes, windows
from phraseloom.sources.corpus import Corpus


def test_small_groups_and_ranges(spark, monkeypatch):
    """Few documents in a chunk, few ranks in a range and a block; readers that begin in the middle of a document."""
    for module, k, v in [(windows, "CHUNK", 4), (order, "ROWS", 16), (ranges, "ROWS", 40), (ranges, "FEWEST", 40), (suffixes, "DEPTH", 2), (order, "AHEAD", 1)]:
        monkeypatch.setattr(module, k, v)
    texts = make(6, 30)
    c = corpus(spark, texts)
    monkeypatch.setattr(Corpus, "ordered", property(lambda self: pytest.fail("the table of keys is built")))
    rows = [tuple(r) for r in c.suffixes.orderBy("rank").select("rank", "doc_id", "pos").collect()]
    assert rows == naive(texts) and suffixes.disorder(c).first().mismatches == 0
    whole = c.suffixes.collect()
    random.Random(1).shuffle(whole)
    c.__dict__["suffixes"] = spark.createDataFrame(whole, "rank long, doc_id long, pos long, key long")
    assert suffixes.disorder(c).first().mismatches == 0
    swap = {47: 48, 48: 47}  # over the end of a block
    c.__dict__["suffixes"] = spark.createDataFrame([(swap.get(r["rank"], r["rank"]), *r[1:]) for r in whole], "rank long, doc_id long, pos long, key long")
    assert suffixes.disorder(c).first().mismatches > 0
