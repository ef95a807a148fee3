"""op12 against DuckDB and against plain Python."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from phraseloom.llm import collocations


def plain(rows, least, top):
    """lang, rank, phrase, a, l, r, n, score by the definition; rows are (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = []
        for g, a in count.items():
            if len(g) < 2 or a < least:
                continue
            if len(g) == 2 and any(len(x) == 3 and b >= least and g in (x[:2], x[1:]) and 100 * b >= 50 * a for x, b in count.items()):
                continue
            score, _, le, ri = min((10**6 * a * a // (count[g[:k]] * count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
            found.append((score, a, " ".join(g), le, ri))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, phrase, a, le, ri, n[lang], score) for i, (score, a, phrase, le, ri) in enumerate(found[:top])]
    return sorted(out, key=str)


def test_equals_sql(spark, data):
    frame = collocations.op12_collocations(spark, data)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({collocations.OP12_SQL}) q").fetchall()
    assert sorted(map(tuple, frame.select(columns).collect())) == sorted(sql) != []


@pytest.mark.parametrize("least, top, piece", [(2, 2000, 8 << 20), (3, 9, 300)])
def test_odd_tables(odd, empty, monkeypatch, least, top, piece):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names, in one batch or many; and an empty table."""
    monkeypatch.setattr(collocations, "PIECE", piece)
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert sorted(map(tuple, collocations.mine(odd, least, top).collect()), key=str) == plain(rows, least, top)
    assert collocations.mine(empty).count() == 0


def test_borders_and_spaces(spark):
    """Pieces end at punctuation, lines and documents; tabs and runs of spaces are one space; words of 70 letters and letters outside ASCII."""
    long = "x" * 70
    texts = ["a  b\tc. a b c,É b;a b", "a b\x0bc a b\x0cÉ b", f"{long} {long}y {long}", f"{long} {long}y {long}", "c", "a\x00b a\x00b a\x00b", " ", ".", "a b c É"]
    rows = [(None if i % 3 else "en", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(map(tuple, collocations.mine(docs, 1).collect()), key=str) == plain(rows, 1, 2000)
