"""op11 against DuckDB and against plain Python."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from phraseloom.llm import divergence


def plain(rows, least, top):
    """lang, source, part, item, value, rank by the definition; rows are (lang, source, text)."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t in {t for d in own for t in d[2]} if sum(t in d[2] for d in own) >= least]
        count = lambda ds: {t: sum(d[2].count(t) for d in ds) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, sources = share(count(own)), sorted({d[1] for d in own}, key=lambda s: s.encode())
        counts = {s: count([d for d in own if d[1] == s]) for s in sources}
        p = {s: share(counts[s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found)]
    return sorted(out)


def test_equals_sql(spark, data):
    frame = divergence.op11_source_divergence(spark, data)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({divergence.OP11_SQL}) q").fetchall()
    assert sorted(map(tuple, frame.select(columns).collect())) == sorted(sql)


def test_odd_tables(odd, empty):
    """Nulls, empty and very long texts, repeated rows and clashing names; and an empty table."""
    got = divergence.audit(odd, least=3, top=7)
    rows = [(r.lang, r.source, r.text) for r in odd.select("lang", "source", "text").collect()]
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 7)
    assert divergence.audit(empty).count() == 0


def test_groups_without_terms(spark):
    """A source without kept terms has its pairs; a language without vocabulary has pairs of value 0."""
    rows = [("en", "a", "x x y"), ("en", "b", "x"), ("en", "c", None), ("de", "a", "z"), ("de", None, "w"), (None, "a", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted(map(tuple, divergence.audit(docs, least=2).collect()))
    assert got == plain(rows, 2, 50)
    assert {r[4] for r in got if r[0] == "de"} == {0} and any(r[:2] == ("en", "c") for r in got)


@pytest.mark.parametrize("tile, block", [(2, 3), (3, 40), (256, 10)])
def test_tiles_and_blocks(spark, odd, tile, block):
    """Pairs are the same however sources and terms are dealt."""
    rng = np.random.default_rng(3)
    rows = [("l", f"s{rng.integers(9)}", " ".join(rng.choice(list("abcdefghij"), rng.integers(1, 9)))) for _ in range(120)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    counts = divergence.term_counts(docs)
    kept = counts.groupBy("term").agg(F.sum("n").alias("x")).count()
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = total.withColumn("terms", F.lit(kept).cast("long")).withColumn("base", divergence.share("0"))
    held = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", divergence.share("n").alias("p"))
    got = {(r.a, r.b): r.value for r in divergence.divergence_pairs(held, groups, block, tile).collect()}
    want = {(r[1], r[3]): r[4] for r in plain(rows, 1, 0) if r[2] == "pair" and r[1] < r[3]}
    assert got == want and len(got) == 36


@pytest.mark.parametrize("few", [0, 3, 4096])
def test_radix_top(spark, few):
    """Ties at the last rank, refined by bytes beyond the first round; groups smaller than k; equal to a sort."""
    rng = np.random.default_rng(5)
    words = sorted({"ä" * int(rng.integers(0, 4)) + "".join(rng.choice(list("ab"), rng.integers(0, 6))) for _ in range(60)})
    rows = [(g, int(rng.choice([0, 5, 7, 1_000_000_001])), w) for g in ("x", "y", "z") for w in words] + [("few", 1, "w")]
    frame = spark.createDataFrame(rows, "g string, v long, item string")
    got = sorted((r.g, r["rank"], r.v, r.item) for r in divergence.radix_top(frame, ["g"], "v", "item", 20, few).collect())
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:20]
        want += [(g, i + 1, v, w) for i, (_, v, w) in enumerate(own)]
    assert got == sorted(want)
