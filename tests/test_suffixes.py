"""The suffix table against a naive suffix array, and what is looked up in it against plain Python."""

import random
from collections import defaultdict

import pytest

from phraseloom.operators import search, suffixes
from phraseloom.sources.corpus import Corpus

COPY = "b a b b a c a b"


def make(seed, n, letters="abc", longest=12):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    return [*texts, COPY, COPY, COPY, "", None, COPY + " c", "a " * 70, "a " * 70]


def corpus(spark, texts):
    return Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def naive(texts):
    """(doc_id, pos) of the words in the order of the suffixes of the whole text, with their ranks."""
    vocabulary = {w: i + 2 for i, w in enumerate(sorted({w for t in texts for w in (t or "").split()}))}
    whole, at = [], []
    for d, t in enumerate(texts):
        words = (t or "").split()
        whole += [*(vocabulary[w] for w in words), 1]
        at += [*((d, p) for p in range(len(words))), None]
    whole, at = [*whole, 0], [*at, None]
    order = sorted(range(len(whole)), key=lambda i: whole[i:])
    return [(r, *at[i]) for r, i in enumerate(order) if at[i]]


@pytest.mark.parametrize("depth", [2, 3, 16])
def test_table_equals_naive_suffix_array(spark, monkeypatch, depth):
    """Copies, empty texts and runs of one word; few known symbols make many rounds."""
    monkeypatch.setattr(suffixes, "DEPTH", depth)
    texts = make(1, 40)
    c = corpus(spark, texts)
    assert [tuple(r) for r in c.suffixes.orderBy("rank").select("rank", "doc_id", "pos").collect()] == naive(texts)
    assert suffixes.disorder(c).first().mismatches == 0


def test_disorder_is_found(spark):
    c = corpus(spark, make(2, 10))
    rows = c.suffixes.selectExpr("case when rank = 30 then 31 when rank = 31 then 30 else rank end as rank", "doc_id", "pos", "key")
    c.__dict__["suffixes"] = rows
    assert suffixes.disorder(c).first().mismatches > 0


def test_empty_collection(spark):
    c = corpus(spark, [None, ""])
    assert c.suffixes.count() == 0 and suffixes.grams(c).count() == 0
    patterns = spark.createDataFrame([(1, ["a"])], "pid long, tokens array<string>")
    assert search.frequencies(suffixes.phrase_starts_by_suffixes(c, patterns)).count() == 0


def test_phrases_and_intervals(spark, monkeypatch):
    """Both suffix strategies give what aligning gives; intervals are those of the naive array; unknown words and too long phrases find nothing."""
    monkeypatch.setattr(suffixes, "FAN", 4)
    monkeypatch.setattr(suffixes, "BLOCK", 16)
    rng, texts = random.Random(3), make(3, 60)
    c = corpus(spark, texts)
    phrases = [[rng.choice("abc") for _ in range(rng.randint(1, 6))] for _ in range(50)] + [["a", "zz"], ["a"] * 10, ["c", "a", "b"]]
    patterns = spark.createDataFrame(list(enumerate(phrases)), "pid long, tokens array<string>")
    rows = lambda f: sorted(map(tuple, f.collect()))
    starts = search.phrase_starts(c, patterns)
    assert rows(suffixes.phrase_starts_by_suffixes(c, patterns)) == rows(starts)
    assert rows(suffixes.phrase_docs_by_listing(c, patterns)) == rows(search.frequencies(starts))
    want = {}
    for r, d, p in naive(texts):
        words = texts[d].split()
        for i, ph in enumerate(phrases):
            if words[p : p + len(ph)] == ph:
                want.setdefault(i, []).append(r)
    got = {r.pid: (r.sp, r.ep) for r in suffixes.intervals(c, suffixes.numbered(c, patterns)).collect()}
    assert got == {i: (min(x), max(x)) for i, x in want.items()}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_grams_of_all_sizes(spark, batch):
    """Counts, documents, intervals and right-maximality of all n-grams, with batches of three rows and of all."""
    texts = make(4, 50)
    c = corpus(spark, texts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.gram: (r.m, r.nocc, r.ndoc, r.sp) for r in suffixes.texts(c, suffixes.grams(c)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen, rank = defaultdict(list), {(d, p): r for r, d, p in naive(texts)}
    for d, t in enumerate(texts):
        words = (t or "").split()
        for m in range(2, 11):
            for p in range(len(words) - m + 1):
                seen[" ".join(words[p : p + m])].append((d, p, words[p + m] if p + m < len(words) else ""))
    want = {g: (len(g.split()), len(x), len({d for d, _, _ in x}), min(rank[d, p] for d, p, _ in x)) for g, x in seen.items() if len(x) > 1 and len({n for _, _, n in x}) > 1}
    assert got == want


def test_keys_are_written_and_shuffled_once(spark, monkeypatch):
    """The first order is written once, and n-grams are read from the listing without another exchange of keys."""
    names, plain = [], suffixes.released
    monkeypatch.setattr(suffixes, "released", lambda frame, name: names.append((name, frame)) or plain(frame, name))
    c = corpus(spark, ["a b c a b", "a b d"])
    suffixes.grams(c)
    assert [n for n, _ in names].count("suffixes-by-depth") == 1 and "suffixes-first" not in [n for n, _ in names]
    assert "Exchange" not in dict(names)["gram-runs"]._jdf.queryExecution().executedPlan().toString()


def test_keys_meet_one_exchange_and_neighbours_none(spark, monkeypatch):
    """The first order shuffles its keys by range alone; listings read the table that it has written."""
    frames, plain = {}, suffixes.released
    monkeypatch.setattr(suffixes, "released", lambda frame, name: frames.setdefault(name, frame) and None or plain(frame, name))
    c = corpus(spark, make(5, 10))
    patterns = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "pid long, tokens array<string>")
    starts = search.frequencies(search.phrase_starts(c, patterns))
    assert sorted(map(tuple, suffixes.phrase_docs_by_listing(c, patterns).collect())) == sorted(map(tuple, starts.collect()))
    plan = frames["suffixes-by-depth"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning(_part" not in plan
    assert "suffixes" not in c.__dict__ and "listing" not in c.__dict__


@pytest.mark.parametrize("words", [3, 1 << 17])
def test_chunks_and_ranges(spark, monkeypatch, words):
    """Documents numbered in many groups, a few words at a time, and equal keys over the ends of ranges; shared words are those with the document's neighbours."""
    monkeypatch.setattr(suffixes, "CHUNK", 2)
    monkeypatch.setattr(suffixes, "WORDS", words)
    texts = ["a a a a", "a a", "b a a b a", "", None, "a a a a", "a a a a"]
    rows = corpus(spark, texts).ordered.orderBy("rank").collect()
    keys = [(tuple(texts[r.doc_id].split()[r.pos : r.pos + 16]), r.doc_id, r.pos) for r in rows]
    assert keys == sorted(keys) and [r["rank"] for r in rows] == list(range(len(texts) + 1, len(texts) + 1 + len(rows)))
    first = {}
    for r, (k, _, _) in zip(rows, keys):
        assert r.start == first.setdefault(k, r["rank"]) and r.head == first.setdefault(k[:10], r.head) and r.tied == (sum(k == x for x, _, _ in keys) > 1)
    common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    for d in set(r.doc_id for r in rows):
        own = [(r, k) for r, (k, _, _) in zip(rows, keys) if r.doc_id == d]
        assert [r.place for r, _ in own] == list(range(1, len(own) + 1))
        assert [r.behind for r, _ in own] == [r.shared for r, _ in own[1:]] + [0] == [common(own[i][1], own[i + 1][1]) for i in range(len(own) - 1)] + [0]
