"""Results that filters, prefixes or samples must not cut."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from phraseloom.llm import chroma, frames, licenses, quality, shingles, simhash, stages, toxicity

SF = "/root/testdata/sf0.001"


def test_links_against_all_offsets(spark):
    """Of all pairs that are close at some offset, compared at every one, 0.9 or more are found; no other pair is; unrelated vectors hardly ever link.  The best match is one of the closest."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(200).toPandas()
    rng, x = np.random.default_rng(5), np.stack(rows.embedding.to_numpy()).astype(float)
    noise = lambda k: x[:100] + rng.normal(0, k, x[:100].shape) * np.abs(x[:100]).mean()
    shifted = np.concatenate([x[:100, 6:], rng.normal(0, 1, (100, 6)) * np.abs(x).mean()], axis=1)
    every = np.concatenate([x, noise(0.05), noise(0.2), shifted])
    codes, least = chroma.codes(every, chroma.SHORT), chroma.MIN_OVERLAP
    n = codes.shape[1]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "rec long, pcm array<double>")
    got = {r.id: r for r in chroma.align(frame, "rec", "pcm", chroma.SHORT, every=5).where("is_query").collect()}
    links = there = chance = 0
    for q, r in got.items():
        found = {}
        for shift in range(least - n, n - least + 1):
            lo, hi = max(0, -shift), min(n, n - shift)
            errors = np.bitwise_count(codes[q, lo:hi] ^ codes[:, lo + shift : hi + shift]).sum(axis=1) / (32 * (hi - lo))
            for m in np.flatnonzero(errors <= chroma.MAX_BIT_ERROR).tolist():
                found.setdefault(m, {})[shift] = errors[m]
        found.pop(q)
        assert r.n_links <= len(found)
        links, there, chance = links + r.n_links, there + len(found), chance + sum(m % 100 != q % 100 for m in found)
        assert not r.n_links or abs(found[r.best_match][r.shift] - r.bit_error) < 1e-9
    assert there > 150 and links >= 0.9 * there and chance < 0.01 * len(got) * len(every)


def test_wrapped_licenses(spark, tmp_path):
    """Headers with their usual line breaks, alone and far inside a longer document, through the registered query."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    gpl = "you can redistribute it and/or modify\nit under the terms of the GNU General\nPublic License as published"
    filler = "\n".join(f"w{i} w{i + 1} w{i + 2}" for i in range(200))
    texts = [bsd, gpl, *(f"{' x' * k}\n{filler}\n{t}\n{filler}" for t in (bsd, gpl) for k in range(0, 64, 9)), filler]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in licenses.op7_license_scan(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts[:-1]):
        assert ("bsd" if "forms" in text else "gpl") in got[i].labels.split(",") and got[i].n_blocks >= 1 and got[i].score >= licenses.CONTAINMENT
    assert (got[len(texts) - 1].labels, got[len(texts) - 1].n_blocks) == ("", 0)


def test_every_clause_with_a_reading_is_read():
    """Typographic punctuation, spaces outside ASCII, apostrophes and capitals: the same readings as with every word looked at."""
    symbol = toxicity.Symbols(["école", "дурак"], ["clod", "ünt"])
    texts = ["you “idiot”", "stupid—you", "a\u00a0fool\u00a0here", "«idiot»", "moron…", "ÉCOLE you", "ДУРАК", "clod's", "you \u212aill them", "Üntold", "idiot\u0301", "été – stupid", "é—école. nothing", "plain\u2014words", "clod", "日本idiot 日本", ""]
    raw = [t.encode() for t in texts]
    borders = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = toxicity._counts(np.frombuffer(b"".join(raw), np.uint8), borders, symbol)
    for text, counts in zip(texts, got):
        own = toxicity.LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes()
        expected = toxicity.document_kinds(own, [i for i in range(len(own)) if own[i : i + 1] not in (b".", b"!", b"?", b";", b":", b"\n")], symbol)
        assert {k: n for k, n in zip(toxicity.KINDS, counts) if n} == expected, text
    assert got.sum() == 13


def edited(rng, n_bases):
    """Texts with random edits, pairs on both sides of similarity 0.8, copies, short and empty texts, and a common passage."""
    make = lambda n: [f"w{rng.randint(0, 5_000)}" for _ in range(n)]
    texts, common = [None, "", " ", "one", "ONE", "two words", "two words"], make(30)
    for _ in range(n_bases):
        base = make(rng.randint(20, 300)) + common
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 35))):
                own[rng.randrange(len(own))] = "edit" + str(rng.random())
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def test_near_copies_by_shingle_similarity(spark, empty):
    """Against all pairs: no text below the similarity is linked, and hardly a link at or above it is missed."""
    texts = edited(random.Random(8), 150)
    own = [brute.shingles(t, 5) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if brute.similar(own[i], own[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = {r.doc_id: r["class"] for r in shingles.classes(docs, 5).collect()}
    assert all((marked[i] == marked[j]) == (own[i] == own[j]) for i in range(len(texts)) for j in range(i))
    nodes = shingles.classes(docs, 5).groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min_by("hash", "doc_id").alias("hash"), F.min("fp").alias("fp"), F.min("fp2").alias("fp2"))
    roots = {r.node: r.root for r in shingles.linked(docs, nodes, 5).collect()}
    top = [roots.get(marked[i], marked[i]) for i in range(len(texts))]
    found = sum(top[i] == top[j] for i, j in links)
    assert len(links) > 200 and found >= 0.97 * len(links)
    exact = brute.groups(list(range(len(texts))), lambda i, j: brute.similar(own[i], own[j]))
    assert all(exact[i] == exact[j] for i in range(len(texts)) for j in range(i) if top[i] == top[j])
    kept = {r.doc_id for r in stages.drop_near_copies(spark, docs, SF).collect()}
    assert kept >= set(exact) and len(kept) <= 1.03 * len(set(exact))
    assert stages.drop_near_copies(spark, empty, SF).count() == 0


def test_crowded_signatures_of_near_copies(spark, monkeypatch):
    """A few edits of one text each: all in one group, when every bucket is crowded."""
    monkeypatch.setattr(simhash, "HOT", 16)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 900)}" for _ in range(200)]
    texts = []
    for k in range(300):
        own = list(base)
        own[rng.randrange(200)] = f"edit{k}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in stages.drop_near_copies(spark, docs, SF).collect()] == [0]


def test_repeated_rows_and_rows_without_id(spark):
    """A row is a document: equal rows, equal ids with different texts, and ids that are null."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b c", 1.0)] * 3 + [(2, "a b c", 2.0), (None, "a b c", 3.0), (3, "x", 4.0), (3, "y", 5.0), (None, long, 6.0), (None, long + " more", 7.0), (None, "z", 8.0), (None, "z", 8.0), (4, None, 9.0), (None, "", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash double")
    got = [tuple(r) for r in stages.drop_near_copies(spark, docs, SF).collect()]
    assert sum(t[1] in (long, long + " more") for t in got) == 1
    assert sorted(t for t in got if t[1] != long and t[1] != long + " more" and t[0]) == [(1, "a b c", 1.0), (3, "x", 4.0), (3, "y", 5.0), (4, None, 9.0)]
    assert [t for t in got if t[1] == "z"] == [(None, "z", 8.0)] and len(got) == 6


def test_dictionary_rows_do_not_grow_with_the_labels(spark, monkeypatch):
    """Rows that are themselves a sample by hash are sampled again for the dictionaries."""
    seen = []
    monkeypatch.setattr(quality, "DICT_ROWS", 50)
    monkeypatch.setattr(quality, "dictionary", lambda texts: seen.append(len(texts)))
    rows = spark.range(8_000).selectExpr("id as doc_id", "concat('text number ', id) as text", "cast(id % 2 as int) as quality")
    quality.train(frames.hashed_sample(rows, 800))
    assert len(seen) == 2 and all(20 <= n <= 90 for n in seen)


def test_links_of_pairs_of_blocks():
    """Random sets on both sides of the similarity, in one block and in two: the same groups as all candidate pairs of different blocks give."""
    rng = np.random.default_rng(3)
    base = rng.choice(1 << 32, 400, replace=False).astype(np.uint32)
    grams = [np.unique(np.concatenate([rng.choice(base[: 100 * (1 + i % 3)], 90, replace=False), rng.integers(0, 1 << 32, int(rng.integers(0, 8)), dtype=np.uint32)])) for i in range(60)]
    grams[7] = grams[8]
    fp, node, root = np.zeros(60, np.uint64), np.arange(60), np.arange(60)
    root[20:30] = 20
    fp[50:] = np.uint64((1 << 64) - 1)  # no candidates of the others
    similar = lambda i, j: 5 * len(np.intersect1d(grams[i], grams[j])) >= 4 * len(np.union1d(grams[i], grams[j]))
    for side in (np.zeros(60, np.int32), np.arange(60, dtype=np.int32) % 2):
        one = len(set(side.tolist())) == 1
        joined = lambda i, j, side=side, one=one: root[i] == root[j] or fp[i] == fp[j] and (one or side[i] != side[j]) and similar(i, j)
        u, v = shingles._block_links(side, fp, fp, node, root, grams)
        assert len(u) and all(similar(i, j) and root[i] != root[j] for i, j in zip(u, v))
        links = set(zip(u, v)) | set(zip(v, u))
        assert brute.groups(range(60), lambda i, j, links=links: root[i] == root[j] or (i, j) in links) == brute.groups(range(60), joined)
