"""Word and window hashes, and the operators on texts that collide under every polynomial hash modulo 2**64."""

import hashlib
import zlib

import brute
import numpy as np
import pytest
from test_outputs import encoded

from phraseloom.llm import decontaminate, licenses, substring_dedup, textkernel, token_files

A = "a"
for _ in range(10):
    A += A.translate({97: 98, 98: 97})
#: The Thue-Morse sequence and its complement, 1,024 letters each.
B = A.translate({97: 98, 98: 97})


@pytest.mark.parametrize("hashed", [textkernel.WORD_HASH, textkernel.WORD_HASH_2])
def test_words_of_all_lengths(hashed):
    words = [bytes(bits) for n in range(11) for bits in np.random.default_rng(n).integers(0, 2, (40, n), dtype=np.uint8)] + [b"x" * n for n in range(200)] + [A.encode(), B.encode()]
    raw = b" ".join(words * 2)
    ends = np.cumsum([len(w) + 1 for w in words * 2]) - 1
    starts = ends - [len(w) for w in words * 2]
    found, data = hashed.words(np.frombuffer(raw, np.uint8), starts, ends), np.frombuffer(raw, np.uint8)
    n = len(words)
    assert (found[:n] == found[n:]).all() and len(set(found.tolist())) == len(set(words))
    assert textkernel.equal_runs(data, starts[:n], data, starts[n:], ends[:n] - starts[:n]).all()
    other = np.roll(np.arange(n), 1)
    size = np.minimum(ends - starts, (ends - starts)[other.tolist() * 2])[:n]
    same = textkernel.equal_runs(data, starts[:n], data, starts[:n][other], size)
    assert same.tolist() == [words[i][:k] == words[j][:k] for i, j, k in zip(range(n), other.tolist(), size.tolist())]


def test_windows_of_all_sizes():
    values = np.random.default_rng(1).integers(0, 2, 3_000).astype(np.uint64)
    for size in (1, 2, 3, 5, 8, 35, 64):
        found, seen = textkernel.WINDOW_HASH.runs(values, size), {}
        for i, h in enumerate(found.tolist()):
            assert seen.setdefault(tuple(values[i : i + size].tolist()), h) == h
        assert len(set(seen.values())) == len(seen)


def test_colliding_pieces_are_encoded_each(spark, tmp_path):
    texts = [f"x {A} y", f"x {B} y", f"{A} {B}"]
    entries = token_files.write_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), token_files.tokenizer_json(), f"file://{tmp_path}/shards", n_shards=1)
    got = sorted(token_files.read_shards(spark, entries).collect(), key=lambda r: r.start)
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in encoded(texts)]


def test_equal_hashes_of_unequal_pieces():
    """With a hash of 50 values almost every piece meets another of equal hash."""

    class Weak:
        def words(self, *spans):
            return textkernel.WORD_HASH.words(*spans) % np.uint64(50)

    rng, encode = np.random.default_rng(3), token_files.Encoder(token_files.tokenizer_json(), memo=60)
    encode.hash = Weak()
    for _ in range(20):
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 80, rng.integers(0, 40))) for _ in range(10)]
        borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        ids, lengths = encode.many(np.frombuffer("".join(texts).encode(), np.uint8), borders)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == encoded(texts)


def test_colliding_words_are_not_repeats(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    texts = [f"{A} {rest}", f"{B} {rest}"]
    got = sorted(substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [tuple(r)[1:] for r in got] == brute.without_repeats(texts) == [(35, 0, hashlib.sha256(t.encode()).hexdigest()) for t in texts]


def test_colliding_words_are_no_leak(spark):
    item = " ".join([A] * 12)
    docs = spark.createDataFrame([(0, " ".join([B] * 12)), (1, f"so {item} on")], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.covered) for r in found] == [(1, 7, 12)]


def test_colliding_runs_of_words_are_compared():
    """Karp-Rabin hashes of the two sequences of words are equal; their tiles aren't."""
    a, b = (np.array([5 if c == "a" else 9 for c in x], np.uint64) for x in (A, B))
    tiles = decontaminate.tile(a, b, 20)
    assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in tiles) and max(n for _, _, n in tiles) < 1_024


def test_colliding_words_are_no_license(spark):
    docs = spark.createDataFrame([(0, f"{B} license"), (1, f"{A} license")], "doc_id long, text string")
    got = {r.doc_id: (r.n_base, r.labels) for r in licenses.scan(docs, templates=[(f"{A} license", "own")], phrases={f"{A} license": "own"}).collect()}
    assert got == {0: (0, ""), 1: (1, "own")}
