"""Mixing, token files, media fingerprints and the pipeline."""

import random
import zlib

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phraseloom.llm import chroma, decontaminate, mixing, registry, stages, token_files, toxicity

SF = "/root/testdata/sf0.001"


def reference_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, total, full = {}, sum(sizes.values()), set()
    while True:
        left, open_weight = total - sum(most * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / open_weight for s in names}
        above = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix_equals_sql(spark, odd, empty):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, mixing.op3_mix_sources(spark, SF).collect()))
    assert got == sorted(map(tuple, con.execute(mixing.OP3_SQL).fetchall()))
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 5, 50]), rng.choice([None, *"abcde"][: seed + 3]) if rng.random() < 0.7 else "z") for i in range(400)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    expected, taken = reference_targets(sizes), dict.fromkeys(sizes, 0)
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - expected[r.source]) < 1e-6 * max(1, expected[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)


def test_mix_bins_are_small_whatever_the_quality(spark):
    """Documents of digits, or without text, have the least quality; bins must not crowd."""
    for text in ("repeat('1 ', 1 + cast(id % 7 as int))", "cast(null as string)"):
        docs = spark.range(40_000).selectExpr("id as doc_id", f"{text} as text", "'s' as source")
        bins = mixing.binned(mixing.measured(docs), 40_000).groupBy("source", "bin").count().toPandas()["count"]
        assert bins.sum() == 40_000 and bins.max() <= 2.5 * max(mixing.BIN_DOCS, 40_000 / np.e / mixing.MIN_BINS)


def test_mix_tells_rows_apart_by_text(spark):
    rows = [(None, "w " * 5, "a")] * 4 + [(None, "w " * 7, "a"), (1, "q " * 30, "a"), (1, "q " * 30, "a"), (2, None, "b"), (3, "x y", "b"), (1, "z", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows) and abs(sum(r.taken for r in mixed if r.source == "a") - mixed[0].target) <= 1
    copies = {}
    for r in mixed:
        copies[r.doc_id, r.digest] = copies.get((r.doc_id, r.digest), 0) + r.copies
    got = stages.mix_sources(spark, docs, SF)
    assert got.columns == docs.columns
    found = {(r.doc_id, r.digest): r.n for r in got.select("doc_id", mixing.digest(got).alias("digest")).groupBy("doc_id", "digest").agg(F.count("*").alias("n")).collect()}
    assert found == {k: n for k, n in copies.items() if n}


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(token_files.tokenizer_json())
    return [[*e.ids, token_files.END_ID] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/shards"
    entries = token_files.write_shards(odd, token_files.tokenizer_json(), folder, n_shards=3)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    ids = encoded([r.text for r in rows])
    got = sorted(token_files.read_shards(spark, entries).collect(), key=lambda r: r.start)
    start = 0
    for r, row, own in zip(got, rows, ids, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    files = token_files.TokenFiles(folder)
    for key in {r.doc_id for r in rows}:
        assert [a.tolist() for a in files.get(key)] == [own for r, own in zip(rows, ids) if r.doc_id == key]
    assert files.get(10**9) == files.get(-5) == []
    assert token_files.write_shards(empty, token_files.tokenizer_json(), f"{folder}-none") == []
    assert token_files.read_shards(spark, []).count() == 0


def test_pieces_put_together_are_the_whole_encoding():
    rng, encode = random.Random(1), token_files.Encoder(token_files.tokenizer_json(), memo=40)
    parts = [" ", "  ", "\n", "a", "b's", "é", "1", ".", ",", "\t", " ", "<|endoftext|>", "日本", "'ll", "\x1c", "　", " ", "!!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3_000)]
    assert [np.frombuffer(encode(t), encode.type).tolist() for t in texts] == encoded(texts)


def test_pieces_of_many_texts():
    rng, encode = random.Random(2), token_files.Encoder(token_files.tokenizer_json(), memo=300)
    parts = [" ", "  ", "\n", "word", "b's", "é", "12", ".", " ", "\u3000", " \u2028", "ñandú", "Ünï", "ǅ", "×", "\x85", "x "]
    for _ in range(30):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(40)]
        raw = [t.encode() for t in texts]
        borders = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, lengths = encode.many(np.frombuffer(b"".join(raw), np.uint8), borders)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == encoded(texts)


def test_perfect_hash():
    for n in (0, 1, 2, 1_000, 30_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.int64)).view(np.uint64)
        assert sorted(token_files.PerfectHash.build(keys).find(keys).tolist()) == list(range(len(keys)))


def tone(notes, rate=11_025):
    return np.concatenate([np.sin(2 * np.pi * f * np.arange(rate // 2) / rate) + 0.3 * np.sin(4 * np.pi * f * np.arange(rate // 2) / rate) for f in notes])


def test_recordings_align(spark):
    rng = np.random.default_rng(2)
    song = tone(rng.choice([262, 294, 330, 349, 392, 440, 494], 40))
    other = tone(rng.choice([277, 311, 370, 415, 466], 40))
    hop = chroma.Audio().hop
    clips = [(0, song), (1, 0.2 * song + rng.normal(0, 0.01, len(song))), (2, song[10 * hop :]), (3, other), (4, song.copy())]
    rows = [(i, x.tolist()) for i, x in clips] + [(5, None), (6, []), (7, [0.5] * 10), (None, song.tolist())]
    got = {r.id: r for r in chroma.align(spark.createDataFrame(rows, "rec long, pcm array<double>"), "rec", "pcm", every=2).collect()}
    assert got[0].class_id == got[4].class_id == 0 and got[0].n_links == 2
    assert got[2].n_links == 2 and got[2].shift in (10, -10)
    assert got[3].n_links is None and got[3].class_id == 3
    assert all(got[i].class_id is None and got[i].n_codes == 0 for i in (5, 6, 7))


def test_pipeline_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], SF))
        assert steps[-1].columns == docs.columns
    kept = [s.select("doc_id", "text", "source").toPandas().sort_values("doc_id").reset_index(drop=True) for s in steps]
    model = toxicity.train(toxicity.labelled(spark, SF, docs))
    clean = {r.doc_id for r in model.score(docs).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert set(kept[1].doc_id) == clean
    own = [brute.shingles(t, stages.SHINGLE_WORDS) for t in kept[1].text]
    exact = set(brute.groups(kept[1].doc_id.tolist(), lambda i, j: brute.similar(own[i], own[j])))
    assert exact <= set(kept[2].doc_id) and len(kept[2]) <= 1.01 * len(exact)
    items = [brute.letters(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    seeds = {tuple(i[k : k + 5]) for i in items for k in range(len(i) - 4)}
    leaked = set()
    for d, text in zip(kept[2].doc_id, kept[2].text):
        w = brute.letters(text)
        if any(tuple(w[k : k + 5]) in seeds for k in range(len(w) - 4)):
            leaked |= {d} if any(brute.tiled(w, i, 5) >= decontaminate.COVERAGE * len(i) for i in items) else set()
    assert set(kept[3].doc_id) == set(kept[2].doc_id) - leaked
    copies = {r.doc_id: r.copies for r in mixing.mix(steps[3]).collect()}
    assert kept[4].doc_id.value_counts().to_dict() == {d: n for d, n in copies.items() if n}
    ids = encoded(kept[4].text)
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in zip(kept[4].doc_id, ids)]


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    extra = odd.withColumns({"copies": odd.n_chars, "id": odd.doc_id, "copy": odd.doc_id})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns and 0 < out.count() <= 3 * extra.count()
        assert stage(spark, empty, SF).count() == 0
    nobody = spark.createDataFrame([(None, f"some words number {i}", None, None, None) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [stage(spark, nobody, SF).count() for _, stage in corpus_pipeline.STAGES[:3]] == [3, 3, 3]


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_histograms_and_bit_errors():
    """Votes of every pair and offset, counted key by key, and errors counted bit by bit, for codes of several lengths; in one batch of votes and in many."""
    rng = np.random.default_rng(6)
    sizes = [(13, 20, 15), (20, 14, 30, 13)]
    left, right = ([rng.integers(0, 2**32, n).astype("<u4") for n in x] for x in sizes)
    right[0][2:15], right[2][:20], right[3][:] = left[0] ^ np.uint32(0x0000_1100), left[1] ^ np.uint32(0x8100_0000), left[2][1:14]
    right[1][3], left[2][4] = 7, 7
    index = chroma.Index([(i, c.tobytes()) for i, c in enumerate(left)])
    other = chroma.Flat(np.arange(4), [c.tobytes() for c in right])
    want = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            for k, u in enumerate(x):
                for m, v in enumerate(y):
                    n = sum((int(u) ^ int(v)) & ~(0xFF << 8 * band) & 0xFFFFFFFF == 0 for band in range(4))
                    s = m - k
                    if n and min(len(x), len(y) - s) - max(0, -s) >= chroma.MIN_OVERLAP:
                        want[i, j, s] = want.get((i, j, s), 0) + n
    assert (0, 0, 2) in want and (1, 2, 0) in want and (2, 3, -1) in want
    for votes in (chroma.VOTES, 5):
        before, chroma.VOTES = chroma.VOTES, votes
        a, b, shift, n = index.histogram(other)
        chroma.VOTES = before
        assert {(i, j, s): v for i, j, s, v in zip(a.tolist(), b.tolist(), shift.tolist(), n.tolist())} == want
    wrong, aligned = chroma.bit_errors(index.flat, a, other, b, shift)
    for i, j, s, w, n in zip(a, b, shift, wrong, aligned):
        pairs = [(k, k + s) for k in range(len(left[i])) if 0 <= k + s < len(right[j])]
        assert (w, n) == (sum(int(left[i][x] ^ right[j][y]).bit_count() for x, y in pairs), len(pairs))


def test_odd_recordings(spark):
    """NaN and infinite samples count as 0, an empty table has no rows, and other columns may have the operator's names."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 64).tolist()
    holes = [0.0 if k in (3, 9) else v for k, v in enumerate(x)]
    rows = [(0, x, 1, "a"), (1, holes, 1, "b"), (2, [*x[:3], float("nan"), *x[4:9], float("inf"), *x[10:]], 2, "c"), (3, [*x[:3], None, *x[4:9], float("-inf"), *x[10:]], 3, None), (None, x, 4, "d")]
    schema = "id long, pcm array<double>, node long, codes string"
    got = {r.id: r for r in chroma.align(spark.createDataFrame(rows, schema), "id", "pcm", chroma.SHORT).collect()}
    assert got[1].class_id == got[2].class_id == got[3].class_id == 1 and got[0].class_id == 0 and len(got) == 5
    assert chroma.align(spark.createDataFrame([], schema), "id", "pcm", chroma.SHORT).count() == 0


def test_histograms_of_a_batch_come_in_runs(monkeypatch):
    """No histogram holds more votes than the limit, unless of one class; links, best matches and their ties don't depend on it."""
    rng = np.random.default_rng(16)
    left = [rng.integers(0, 2**32, 20).astype("<u4") for _ in range(30)]
    right = [np.where(rng.random(20) < 0.9, left[rng.integers(30)], np.uint32(7)).astype("<u4") for _ in range(200)]
    index = chroma.Index([(1_000 + i, c.tobytes()) for i, c in enumerate(left)])
    nodes, raw = np.arange(200), [c.tobytes() for c in right]
    whole = chroma._best(index, chroma.Flat(nodes, raw))
    monkeypatch.setattr(chroma, "VOTES", 400)
    runs = list(index.runs(nodes, raw))
    votes = [int(index.histogram(chroma.Flat(*r))[3].sum()) for r in runs]
    assert len(runs) > 10 and all(v <= 400 or len(r[1]) == 1 for v, r in zip(votes, runs))
    assert [x for r in runs for x in r[1]] == raw and np.concatenate([r[0] for r in runs]).tolist() == nodes.tolist()
    held = None
    for r in runs:
        part = chroma._best(index, chroma.Flat(*r))
        held = part if held is None else chroma._merged(held, part)
    assert len(whole[0]) == 30 and all(x.tolist() == y.tolist() for x, y in zip(held, whole))
    assert list(index.runs(np.arange(0), [])) == [] and len(chroma._best(index, chroma.Flat(np.arange(1), [b""]))[0]) == 0
