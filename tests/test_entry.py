import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from seriesloom import queries

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_a_stable_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.dtypes == [("mit", "bigint"), ("value", "double")] and df.count() > 0


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_imports_without_the_text_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone, "__pycache__", ".git", "tests"))
    tmp_path = tmp_path / "repo"
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "seriesloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "seriesloom.llm" not in path.read_text(encoding="utf-8"), path
