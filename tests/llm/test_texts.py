"""Language, toxicity, quality, licenses and decontamination."""

import random

import brute
import numpy as np
import pytest

from phraseloom.llm import decontaminate, language_id, licenses, quality, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, query, label, share):
    rows = query(spark, SF)
    docs = spark.read.parquet(f"{SF}/{'documents' if label == 'lang' else 'labels'}.parquet").select("doc_id", label)
    got = rows.join(docs, "doc_id").where("held_out").toPandas()
    assert rows.count() == 1_000
    assert (got[label] == got["lang_pred" if label == "lang" else "predicted"]).mean() >= share


def test_language_on_held_out_rows(spark):
    held_out(spark, language_id.op2_language_id, "lang", 0.97)


def test_toxicity_on_held_out_rows(spark):
    held_out(spark, toxicity.op4_toxicity, "toxic", 0.9)


def test_quality_on_held_out_rows(spark):
    held_out(spark, quality.op6_quality, "quality", 0.93)


def test_odd_texts(odd, empty):
    langs, priors, table = language_id.train(odd)
    got = {r.doc_id: r for r in language_id.predict(odd, langs, priors, table).collect()}
    assert langs == ["en"] and [got[i].lang_pred for i in (0, 1, 2, 3)] == ["und", "und", "und", "en"]
    assert language_id.predict(odd, *language_id.train(empty)).where("lang_pred <> 'und'").count() == 0
    for model in (toxicity.train(empty.withColumn("toxic", empty.n_chars)), quality.train(empty.withColumn("quality", empty.n_chars))):
        scores = [r.score for r in model.score(odd).collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
        assert model.score(empty).count() == 0


def test_score_does_not_depend_on_neighbours(odd):
    langs, priors, table = language_id.train(odd)
    whole = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.predict(odd, langs, priors, table).collect()}
    single = {(r.doc_id, r.lang_pred, round(r.score, 9)) for i in (3, 4, 12) for r in language_id.predict(odd.where(odd.doc_id == i), langs, priors, table).collect()}
    assert single <= whole


@pytest.mark.parametrize(
    ("clause", "expected"),
    [
        ("you are an idiot", ["insult+target"]),
        ("idiot", ["insult"]),
        ("that is not an idiot", ["insult+negated"]),
        ("not one two three four idiot", ["insult"]),
        ("the man said idiot", ["insult+reported"]),
        ("she never said you idiot", ["insult+negated+reported+target"]),
        ("kill them", ["threat+target"]),
        ("a plain clause", []),
    ],
)
def test_grammar(clause, expected):
    symbol = toxicity.Symbols([], [])
    assert toxicity.readings([symbol(w) for w in clause.split()]) == expected


def test_clauses_are_read_one_by_one():
    symbol = toxicity.Symbols([], ["clod"])
    text = b"Not here. idiot, he said; clodhopper! nothing"
    at = [text.index(b"idiot"), text.index(b"clod")]
    assert toxicity.document_kinds(text, at, symbol) == {"insult+target": 1, "slur": 1}


def license_labels(text, wrapped):
    """Labels and score of the method by the definition: every block against every template."""

    def common(x, y):
        rows = [[0] * (len(y) + 1)]
        for v in x:
            rows.append([0])
            for j, w in enumerate(y):
                rows[-1].append(rows[-2][j] + 1 if v == w else max(rows[-2][j + 1], rows[-1][j]))
        return rows[-1][-1]

    half, spread, least, found = licenses.WINDOW // 2, licenses.SPREAD, licenses.CONTAINMENT - 1e-9, {}
    for part in [*(text or "").split("\n"), *([text or ""] if wrapped else [])]:
        own = brute.letters(part)
        for a in range(0, max(len(own) - half, 1), half) if len(own) > licenses.WINDOW else [0]:
            block = own[a : a + licenses.WINDOW]
            for t, label, names in licenses.TEMPLATES:
                order = t.split()
                if len(set(block) & set(order)) >= least * len(set(order)):
                    spans = [block[k : k + spread * len(order)] for k in range(len(block))]
                    share = max(common(x, order) for x in spans if set(names.split()) <= set(x)) / len(order) if any(set(names.split()) <= set(x) for x in spans) else 0
                    if share >= least:
                        found[label] = max(share, found.get(label, 0))
    return found


@pytest.mark.parametrize("wrapped", [False, True])
def test_license_scan(spark, odd, empty, wrapped):
    rng = random.Random(2)
    words = "the this work is under a mit license apache cc by gnu general public licensed version 2 0 all rights reserved x y z".split()
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 4))) for _ in range(100)]
    for t, *_ in licenses.TEMPLATES:  # whole, over two lines, with words left out or put in, and in another order
        own = t.split()
        k, at = rng.randrange(len(own)), rng.randrange(300)
        other = [*own[:k], *rng.choices("x y z".split(), k=rng.randint(0, len(own))), *own[k + rng.randint(0, 3) :]]
        texts += [t, " ".join(own[:k]) + "\n" + " ".join(own[k:]), " ".join(["z"] * at + other + ["x"] * 200), " ".join(reversed(own)), t + "\n" + t]
    texts += ["MIT\nLicense", "x" * 10 + "CC-BY", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, wrapped=wrapped).collect()}
    for i, text in enumerate(texts):
        w, places, base = brute.letters(text), [], set()
        for p, label in licenses.PHRASES.items():
            p = p.split()
            hits = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += hits
            base |= {label} if hits else set()
        labels, r = license_labels(text, wrapped), got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None)), text
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | set(labels)))), text
        assert abs(r.score - (1 if base else max(labels.values(), default=0))) < 1e-9, text
    assert licenses.scan(odd, wrapped=wrapped).count() == odd.count() and licenses.scan(empty, wrapped=wrapped).count() == 0


def test_words_of_a_license_alone_are_none(spark):
    """Texts that share most words of a template, but not its order or its names."""
    texts = [
        "the software is released under the bsd license",
        "licensed under the license version 2 0 of eupl",
        "all seats reserved for all members who waived their rights",
        "released into the domain of science for public reading",
        "rights reserved by all",
        "public domain work has been released this into the",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.labels, r.score) for r in licenses.scan(docs, wrapped=True).collect()} == {("", 0.0)}


def test_decontamination(spark, odd, empty):
    rng = random.Random(4)
    make = lambda n: [f"w{rng.randint(0, 60)}" for _ in range(n)]
    items = [make(rng.randint(1, 45)) for _ in range(25)] + [[]]
    docs = [make(rng.randint(0, 150)) for _ in range(40)]
    for k in range(20):
        parts = items[k][: len(items[k]) // 2], items[k][len(items[k]) // 2 :]
        docs.append([*make(30), *parts[1], *make(rng.randint(0, 3)), *parts[0], *make(10)])  # reordered
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    frame = spark.createDataFrame([(i, " ".join(t).upper() + ".") for i, t in enumerate(docs)] + [(500, None)], "doc_id long, text string")
    expected = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            if item:
                covered = brute.tiled(doc, item, min(decontaminate.MIN_TILE, len(item)))
                if covered >= decontaminate.COVERAGE * len(item):
                    expected[d, i] = covered
    assert {(r.doc_id, r.item_id): r.covered for r in decontaminate.contamination(frame, bench).collect()} == expected
    kept = {r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()}
    assert kept == {*range(len(docs)), 500} - {d for d, _ in expected}
    assert decontaminate.contamination(odd, bench).count() == decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(frame, bench.limit(0)).count() == 0


def test_tiles_do_not_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(1, 5, n).astype(np.uint64) for n in rng.integers(1, 40, 2))
        tiles = decontaminate.tile(a, b, 3)
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in tiles)
        for k in (0, 1):
            used = [x for t in tiles for x in range(t[k], t[k] + t[2])]
            assert len(used) == len(set(used))
        assert max((n for _, _, n in tiles), default=0) == longest(a.tolist(), b.tolist(), [], [])
        assert longest(a.tolist(), b.tolist(), *([x for t in tiles for x in range(t[k], t[k] + t[2])] for k in (0, 1))) == 0  # nothing is left to mark
        if len(tiles) <= 1:
            assert sum(n for _, _, n in tiles) == brute.tiled(a.tolist(), b.tolist(), 3)


def longest(a, b, in_a, in_b, least=3):
    """Length of the longest common run outside the marked places; 0 below ``least``."""
    a, b = ([-k - 1 if i in held else x for i, x in enumerate(own)] for k, (own, held) in enumerate(((a, set(in_a)), (b, set(in_b)))))
    best = max((n for n in range(1, min(len(a), len(b)) + 1) if {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}), default=0)
    return best if best >= least else 0


def test_benchmark_in_slices(spark, monkeypatch):
    """A benchmark that is read in many parts gives the rows of one that is read at once."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate.slices, "__defaults__", (200,))
    assert decontaminate.slices(bench)[0] > 2
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect())) == whole
    assert decontaminate.decontaminate(docs, bench).count() == docs.count() - len({r[0] for r in whole})
