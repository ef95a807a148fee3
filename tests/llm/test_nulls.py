"""Rows without doc_id, ties and repeated rows in the operators that give a row for each document."""

import zlib

import numpy as np
import pytest

from phraseloom.llm import components, decontaminate, simhash, substring_dedup, token_files

TEXT = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nulls"))
    rows = [(None, TEXT), (None, TEXT), (3, TEXT), (None, "x y"), (4, "x y"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_components_of_rows_without_id(spark, folder):
    """They take the component of the rows with their fingerprint, null where none has an id."""
    got = sorted(((r.doc_id, r.component_id) for r in simhash.op5_simhash_dedup(spark, folder).collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (3, 3), (None, 4), (4, 4), (None, None)], key=str)
    edges = spark.createDataFrame([(1, 2), (2, 5), (None, 1), (7, None), (9, 9), (1, 2)], "u long, v long")
    assert sorted(map(tuple, components.components(edges).collect())) == [(1, 1), (2, 1), (5, 1)]
    assert components.components(edges.where("u = 9")).count() == 0


def test_windows_of_rows_without_id(spark, folder):
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.op10_substring_dedup(spark, folder).collect()), key=str)
    assert got == sorted([(None, 60, 60), (None, 60, 60), (3, 60, 60), (None, 2, 0), (4, 2, 0), (None, 0, 0)], key=str)


def test_token_files_of_rows_without_id(spark, folder):
    """They come first; every row's ids are read back."""
    rows = sorted(token_files.op8_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 4 + [3, 4]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    assert sorted(r.n_tokens for r in rows)[0] == 1 and zlib.crc32(np.array([2], "<u4").tobytes()) in {r.ids_crc32 for r in rows}


def test_repeated_rows_and_items_of_decontamination(spark):
    """Repeated documents are matched each, repeated items too."""
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a b {passage} c"), (1, f"a b {passage} c"), (2, "a b c"), (None, passage)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (7, passage), (8, passage)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_tiles, r.covered, r.coverage) for r in decontaminate.contamination(docs, items).collect()), key=str)
    each = [(1, i, 1, 12, 1.0) for i in (7, 7, 8)]
    assert got == sorted([*each, *each, *((None, *r[1:]) for r in each)], key=str)
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [2]
