"""The entry points, with and without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(q.startswith('op') for q in e.queries()))"


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline_too):
    from strata.queries import oracle_sql, queries

    gone = ["llm", "__pycache__", ".git", *(["corpus_pipeline.py"] if pipeline_too else [])]
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*gone))
    run = subprocess.run([sys.executable, "-c", NAMES], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    assert run.stdout.split() == [str(len(queries())), str(len(oracle_sql())), "False", "False"]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "strata").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "strata.llm" not in path.read_text()
