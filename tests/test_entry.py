"""The entry with and without the folders of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from gridloom.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); print('SQL', len(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_imports_without_llm_folders(tmp_path, pipeline):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", "metastore_db", "*.json", "*.txt", "llm")
    shutil.copytree(ROOT, copy, ignore=skip)
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert not (copy / "gridloom/llm").exists() and not (copy / "tests/llm").exists()
    said = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names, sql = said.stdout.splitlines()
    assert names.split()[1:] == sorted(catalog.queries())
    assert sql == f"SQL {len(catalog.oracle_sql())}"
