"""The entry imports and lists its queries where the training-data folders are not there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "stratalens", tmp_path / "stratalens", ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    check = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q, q; "
    check += "assert set(e.oracle_sql()) <= set(q) and len(q) > 100"
    done = subprocess.run(
        [sys.executable, "-B", "-c", check],
        cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)},
        capture_output=True, text=True, timeout=100,
    )
    assert done.returncode == 0, done.stderr
