"""The generator's draw: exact, and only n-grams near the bound leave the texts."""

import hashlib
from collections import defaultdict

import pytest
from test_windows import corpus

from phraseloom.operators import windows, workload
from phraseloom.sources.corpus import Corpus

MOST = 10


def lowest(rows):
    """Of (bucket, gram) the ``MOST`` lowest hashes of each bucket from 0 on."""
    found = defaultdict(list)
    for b, gram in rows:
        if b >= 0:
            found[b].append((hashlib.md5(f"{workload.SEED} {gram}".encode()).hexdigest(), gram))
    return {(b, gram) for b, all_ in found.items() for _, gram in sorted(all_)[:MOST]}


@pytest.mark.parametrize("slack", [10, -2.5])
@pytest.mark.parametrize("table", [False, True])
def test_draw_is_exact(spark, monkeypatch, slack, table):
    """Also where the first bound is too low, and with the table of suffixes."""
    monkeypatch.setattr(workload, "SLACK", slack, raising=False)
    c = corpus(spark, n=250)
    if table:
        c.ordered  # noqa: B018
    every = {r.gram: r for r in workload.gram_stats(c).withColumn("bucket", workload.bucket(workload.F.col("ndoc"))).collect()}
    ids = {r.term: r.term_id for r in c.dictionary.collect()}
    rows = workload.generated(c, MOST).collect()
    assert {(r.bucket, r.gram) for r in rows} == lowest((r.bucket, r.gram) for r in every.values()) and len({r.bucket for r in rows}) == 2
    assert [r.id for r in sorted(rows, key=lambda r: (r.bucket, r.m, r.gram.encode()))] == list(range(1, len(rows) + 1))
    for r in rows:
        e = every[r.gram]
        assert (r.m, r.nocc, r.ndoc, r.sp, r.ep) == (e.m, e.nocc, e.ndoc, e.sp, e.sp + e.nocc - 1) and r.ids == [ids[w] for w in r.gram.split()]


def test_few_ngrams_leave_the_texts(spark, monkeypatch):
    c, seen, first = corpus(spark, n=250), [], workload.first_per_bucket

    def counted(patterns, *rest):
        seen.append(patterns.groupBy("bucket").count().collect())
        return first(patterns, *rest)

    monkeypatch.setattr(workload, "first_per_bucket", counted)
    n = workload.gram_stats(c).count()
    assert workload.generated(c, MOST).count() == 2 * MOST and n > 500
    (sizes,) = seen
    assert all(r["count"] <= 4 * (MOST + 10 * MOST**0.5) for r in sizes) and sum(r["count"] for r in sizes) < n / 2


def test_texts_travel_compressed(spark):
    rows = windows.texts_in_groups(Corpus(spark.createDataFrame([(i, "some words again and again " * 200) for i in range(50)], "doc_id long, text string"))).collect()
    assert sum(sum(len(x) for x in r if isinstance(x, (str, bytes, bytearray))) for r in rows) < 50_000  # 270,000 bytes of words


@pytest.mark.parametrize("first", [0, -(1 << 60) - 700, (1 << 60) - 700])
def test_ids_beyond_doubles(spark, monkeypatch, first):
    monkeypatch.setattr(windows, "FREQUENT", 0)
    c = Corpus(spark.createDataFrame([(first + i, f"a b{i % 3} c d{i % 2}") for i in range(1_400)], "doc_id long, text string"))
    got = {r.gram: (r.nocc, r.ndoc) for r in workload.gram_stats(c, 2, ("nocc", "ndoc")).collect()}
    assert got == {f"b{j} c": (n, n) for j, n in enumerate((467, 467, 466))} | {f"a b{j} c": (n, n) for j, n in enumerate((467, 467, 466))}
