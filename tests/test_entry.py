"""The entry point with and without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tuplewise import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("tuplewise/llm", "tests/llm"), ("tuplewise/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for path in gone:
        shutil.rmtree(copy / path) if (copy / path).is_dir() else (copy / path).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(' '.join(e.queries()), '|', ' '.join(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout
    names, sql = (set(part.split()) for part in out.split("|"))
    assert set(catalogue.QUERIES) <= names and set(catalogue.ORACLE_SQL) <= sql
    assert "pipeline" not in names and ("op1_media" in names) == ("tuplewise/llm" not in gone and "op1_media" in entry.queries())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
