"""The trained models of op2, op4 and op6, text by text in plain Python; samples; labels of one kind only."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from phraseloom.llm import frames, language_id, quality, toxicity


def buckets(text):
    """Numbers of the hashed 1- to 3-grams of a text: letters, lower-cased, with one space for each run of others and around the text."""
    out, chars, mask = [], [], 0xFFFFFFFF
    for c in f" {text.lower()} ":
        if c.isalpha():
            chars.append(c)
        elif not chars or chars[-1] != " ":
            chars.append(" ")
    for order in (1, 2, 3):
        for i in range(len(chars) - order + 1):
            g, h = chars[i : i + order], 0
            if g == [" "]:
                continue
            for c, prime in zip(g, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                h = ((h ^ ord(c)) * prime) & mask
            h ^= h >> 15
            h = (h * 0x2C1B3C6D) & mask
            out.append((h >> 16) ^ (order * 0x5555 & 0xFFFF))
    return out


def test_language_by_plain_naive_bayes(spark, odd):
    """Counts, priors, matrix and posteriors from the definition; a tie goes to the language that sorts first."""
    texts = ["the cat and the hat", "der Hund und die Katze", "le chat et le chien", "DER HUND!", "étré 12 été", "und the et", "x" * 9_000, "1 2 3", "", None]
    langs = ["en", "de", "fr", "de", "fr", None, None, "en", "de", "fr"]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    count, share = {x: Counter() for x in ("de", "en", "fr")}, Counter()
    for t, x in zip(texts, langs):
        if x and t is not None:
            count[x].update(buckets(t))
            share[x] += 1
    model = language_id.train(docs)
    size = 1 << 16

    def posterior(text):
        logs = [math.log(share[x] / sum(share.values())) + sum(math.log(count[x][b] + 0.5) - math.log(count[x].total() + 0.5 * size) for b in buckets(text)) for x in sorted(count)]
        best = max(logs)
        return sorted(count)[logs.index(best)], 1 / sum(math.exp(v - best) for v in logs)

    assert model[0] == sorted(count)
    for r in language_id.predict(docs, *model).collect():
        if any(c.isalpha() for c in texts[r.doc_id] or ""):
            lang, score = posterior(texts[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - score) < 1e-3
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    tie = spark.createDataFrame([(0, "abc", "b"), (1, "abc", "a"), (2, "abc", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, round(r.score, 6)) for r in language_id.predict(tie, *language_id.train(tie)).collect()} == {("a", 0.5)}


def test_quality_by_plain_compression(spark, odd):
    """Every score from the two dictionaries, the sizes and the fitted weights."""
    rng = random.Random(3)
    good, bad = ([f"{x}{rng.randrange(200)}" for _ in range(300)] for x in ("wort", "junk"))
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(5, 400))), i % 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(docs)
    sizes = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in model.dictionaries]
    w = model.calibration
    for r in model.score(docs.select("doc_id", "text").union(odd.select(odd.doc_id + 1_000, "text"))).collect():
        text = (rows[r.doc_id][1] if r.doc_id < 1_000 else odd.where(f"doc_id = {r.doc_id - 1_000}").first().text) or ""
        raw = text.encode()
        if not raw:
            assert r.score == model.share
            continue
        g, b = (len(c.compress(raw)) for c in sizes)
        d, e, n = (b - g) / (b + g), (b - g) / len(raw), math.log1p(len(raw))
        z = w.weights[0] + sum((x - m) / s * k for x, m, s, k in zip((d, e, n, d * n, e * n, n * n), w.mean, w.scale, w.weights[1:]))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
    scores = {r.doc_id: r.score for r in model.score(docs).collect()}
    assert np.mean([(scores[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.95


def test_toxicity_by_plain_readings(spark):
    """Every score from the readings of all clauses and the fitted weights."""
    rng = random.Random(4)
    plain, hot = "river garden near house and the walk over".split(), "you idiot, they are clods; kill them! he said moron. not stupid\nclodhopper you".split(" ")
    rows = [(i, " ".join(rng.choice(hot if i % 3 == 0 and rng.random() < 0.4 else plain) for _ in range(rng.randint(0, 60))), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs)
    for r in model.score(docs).collect():
        found, text = Counter(), rows[r.doc_id][1]
        for clause in toxicity._CLAUSE_END.split(text.encode()):
            found.update(toxicity.readings([model.symbol(x) for x in toxicity._TOKEN.findall(clause.decode().lower())]))
        z = model.weights.weights[0] + sum(math.log1p(found[k]) * w for k, w in zip(toxicity.KINDS, model.weights.weights[1:]))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9 and r.n_readings == found.total()


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_kind(spark, label):
    """Nothing is learned from rows of one kind: clean texts stay clean, and quality is the share of good rows."""
    texts = ["the river and the garden near the house"] * 20 + ["a river near you"] * 20
    docs = spark.createDataFrame([(i, f"{t} {i}", label, label) for i, t in enumerate(texts)], "doc_id long, text string, toxic int, quality int")
    model = toxicity.train(docs)
    assert all(r.score < toxicity.THRESHOLD for r in model.score(docs).collect())
    insult = spark.createDataFrame([(1, "you are an idiot")], "doc_id long, text string")
    assert model.score(insult).first().score >= toxicity.THRESHOLD
    assert {r.score for r in quality.train(docs).score(docs).collect()} == {float(label)}


def test_samples_of_rows_without_ids(spark):
    """Rows without an id are drawn one by one, and the same ones in every run."""
    rows = spark.createDataFrame([(None, f"text {i}") for i in range(2_000)], "doc_id long, text string").repartition(3)
    for most in (300, 900):
        drawn = {r.text for r in frames.hashed_sample(rows, most).collect()}
        assert 0.8 * most < len(drawn) < 1.2 * most
        assert drawn == {r.text for r in frames.hashed_sample(rows.repartition(2), most).collect()}
