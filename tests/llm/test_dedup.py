"""SimHash groups, repeated windows and components against plain versions."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from phraseloom.llm import components, shingles, simhash, substring_dedup


def test_simhash_groups(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    prints = [brute.simhash(r.text) for r in rows]
    expected = brute.groups([r.doc_id for r in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd, 4, 4).collect())
    assert got == sorted(zip([r.doc_id for r in rows], prints, expected))
    assert simhash.near_duplicates(empty, 4, 4).count() == 0


@pytest.mark.parametrize(("max_bits", "max_all", "hot"), [(4, 128, 4096), (4, 128, 8), (9, 128, 4096), (12, 25, 4096), (12, 25, 16), (13, 32, 4096)])
def test_links_are_complete(spark, max_bits, max_all, hot):
    rng = np.random.default_rng(max_bits)
    centres = rng.integers(0, 2**63, (40, 2), dtype=np.int64).view(np.uint64)
    values = []
    for _ in range(600):
        c = centres[rng.integers(0, 40)].copy()
        for half, flips in ((0, rng.integers(0, max_bits + 3)), (1, rng.integers(0, 20))):
            for b in rng.choice(64, flips, replace=False):
                c[half] ^= np.uint64(1) << np.uint64(b)
        values.append(c)
    values = np.unique(np.array(values), axis=0)
    near = lambda i, j: (d := int(np.bitwise_count(values[i, 0] ^ values[j, 0]))) <= max_bits and d + int(np.bitwise_count(values[i, 1] ^ values[j, 1])) <= max_all
    expected = brute.groups(list(range(len(values))), near)
    nodes = spark.createDataFrame([(i, int(np.int64(a)), int(np.int64(b))) for i, (a, b) in enumerate(values.view(np.int64))], "node long, fp long, fp2 long")
    roots = {r.node: r.root for r in components.components(simhash.near_edges(nodes, max_bits, max_all, hot)).collect()}
    assert [roots.get(i, i) for i in range(len(values))] == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (101, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}


@pytest.mark.parametrize("sent", [500_000, 0])
def test_groups_merge(spark, monkeypatch, sent):
    """Groups of earlier edges and links between their roots give what all edges give; both ways of joining, new nodes and no links."""
    monkeypatch.setattr(components, "SENT_ROWS", sent)
    frame = lambda edges: spark.createDataFrame(edges, "u long, v long")
    first = [(i, i + 1) for i in range(10, 30)] + [(40, k) for k in range(41, 60)] + [(70, 71)]
    roots = components.components(frame(first))
    links = [(10, 40), (5, 40), (80, 81), (10, 10)]
    got = components.merged(roots, frame(links)).collect()
    expected = {r.node: r.root for r in components.components(frame(first + links)).collect()}
    assert len(got) == len(expected) and {r.node: r.root for r in got} == expected
    assert components.merged(roots, frame(links).limit(0)).count() == roots.count()


def test_repeated_windows(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    expected = Counter((r.doc_id, *x) for r, x in zip(rows, brute.without_repeats([r.text for r in rows])))
    assert Counter(map(tuple, substring_dedup.remove_repeats(odd).collect())) == expected
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_index_remembers_earlier_batches(spark, tmp_path):
    rng = random.Random(3)
    make = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    passage = make(50)
    first = [(1, make(100)), (2, f"{make(20)} {passage}"), (3, make(40))]
    second = [(4, f"{passage} {make(30)}"), (5, make(60))]
    third = [(6, make(10) + " " + first[0][1]), (7, second[1][1])]
    index, got = str(tmp_path / "index"), {}
    for batch in (first, second, third):
        frame = spark.createDataFrame(batch, "doc_id long, text string")
        got |= {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame, index).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 50, 5: 0, 6: 100, 7: 60}


def test_runs_compact():
    rng, runs, seen = np.random.default_rng(5), substring_dedup.Runs(), Counter()
    for _ in range(11):
        batch = np.unique(rng.integers(0, 400, 90).astype(np.uint64))
        runs.append(batch, np.zeros(len(batch), bool))
        seen.update(batch.tolist())
        assert len(runs.runs) < substring_dedup.FANOUT
    keys = np.array(sorted(seen), np.uint64)
    assert runs.ask(keys).tolist() == [seen[k] > 1 for k in keys.tolist()]
    assert (substring_dedup.unpack(substring_dedup.pack(keys)) == keys).all()


def test_forests_connect_crowded_nodes():
    """Of the pairs of a crowded key, those marked as forest connect what all near pairs connect."""
    rng, n = np.random.default_rng(1), 200
    values = rng.integers(0, 2**63, (3, 2)).astype(np.uint64)[rng.integers(0, 3, n)]
    for i in range(n):
        for half in (0, 1):
            for b in rng.choice(64, rng.integers(0, 9), replace=False):
                values[i, half] ^= np.uint64(1) << np.uint64(b)
    found = simhash._Linker(13, 25).edges_of(np.zeros(n, np.int64), values[:, 0].copy(), values[:, 1].copy(), np.arange(n))
    u, v, d = (c.to_numpy() for c in found.columns)
    forest = (d < 2 * simhash.PARTIAL) & (u != v)
    links = set(zip(u[forest].tolist(), v[forest].tolist()))
    near = lambda i, j: (a := int(np.bitwise_count(values[i, 0] ^ values[j, 0]))) <= 13 and a + int(np.bitwise_count(values[i, 1] ^ values[j, 1])) <= 25
    assert len(links) < n < np.count_nonzero(u != v)
    assert brute.groups(list(range(n)), lambda i, j: (i, j) in links or (j, i) in links) == brute.groups(list(range(n)), near)


def _crowd(seed, n, flips):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 2**63, (3, 2)).astype(np.uint64)[rng.integers(0, 3, n)]
    for i in range(n):
        for half in (0, 1):
            for b in rng.choice(64, rng.integers(0, flips), replace=False):
                values[i, half] ^= np.uint64(1) << np.uint64(b)
    return np.unique(values, axis=0)


def test_a_pair_leaves_one_signature(spark):
    """Near pairs share many signatures; their edges come from the first one only, and connect what all near pairs connect."""
    values = _crowd(2, 60, 5)
    nodes = spark.createDataFrame([(i, int(np.int64(a)), int(np.int64(b))) for i, (a, b) in enumerate(values.view(np.int64))], "node long, fp long, fp2 long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a task merges what it finds twice, so several are needed
    try:
        found = [(r.u, r.v) for r in simhash.near_edges(nodes, 13, 25).collect() if r.d < simhash.PARTIAL and r.u != r.v]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found and len(found) == len(set(found))


@pytest.mark.parametrize("hot", [4096, 16])
def test_rounds_lose_no_link(spark, monkeypatch, hot):
    """Few rows in a round: each shuffles at most a part of the signatures, its shuffle files go, and the groups stay the same."""
    monkeypatch.setattr(simhash, "ROUND_ROWS", 10)
    values, shuffled = _crowd(3, 300, 9), []
    write = simhash.released
    monkeypatch.setattr(simhash, "released", lambda frame, name: shuffled.append(name) or write(frame, name))
    near = lambda i, j: (d := int(np.bitwise_count(values[i, 0] ^ values[j, 0]))) <= 13 and d + int(np.bitwise_count(values[i, 1] ^ values[j, 1])) <= 25
    nodes = spark.createDataFrame([(i, int(np.int64(a)), int(np.int64(b))) for i, (a, b) in enumerate(values.view(np.int64))], "node long, fp long, fp2 long")
    roots = {r.node: r.root for r in components.components(simhash.near_edges(nodes, 13, 25, hot)).collect()}
    assert [roots.get(i, i) for i in range(len(values))] == brute.groups(list(range(len(values))), near)
    rounds = shuffled.count("hot-keys")
    assert rounds > 2 and (shuffled.count("near") == rounds if hot == 4096 else shuffled.count("near") > rounds)


def test_blocks_in_rounds(spark, monkeypatch):
    """Crowded classes over several rounds of blocks give the groups that one round gives."""
    rng = random.Random(4)
    base = [str(rng.randint(0, 10**6)) for _ in range(200)]
    texts = [" ".join(w if rng.random() > 0.004 else "x" for w in base[: 180 + i % 20]) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = [r.doc_id for r in shingles.without_near_copies(docs, 5).collect()]
    seen, write = [], shingles.released
    monkeypatch.setattr(shingles, "released", lambda frame, name: seen.append(name) or write(frame, name))
    monkeypatch.setattr(shingles, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(shingles, "ROUND_BYTES", 1)
    assert [r.doc_id for r in shingles.without_near_copies(docs, 5).collect()] == expected
    sets = [brute.shingles(t) for t in texts]
    assert sorted(expected) == sorted(set(brute.groups(list(range(len(texts))), lambda i, j: brute.similar(sets[i], sets[j]))))
    assert len(seen) > 1, seen
