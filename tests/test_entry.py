"""The driver contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["pid", "doc_id", "freq"] and frame.count() > 0


def test_sql_belongs_to_queries():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("gone", [["phraseloom/llm"], ["phraseloom/llm", "corpus_pipeline.py"]])
def test_entry_without_llm(gone, tmp_path):
    """The core queries load when the subpackage is deleted, with the pipeline or without."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 60 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
