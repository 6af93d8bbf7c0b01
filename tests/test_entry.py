"""The driver contract holds where the corpus operators were left out of the installation."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_without_corpus_operators(tmp_path, pipeline_stays):
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline_stays and (TOP / "corpus_pipeline.py").exists())):
        shutil.copy(TOP / name, tmp_path)
    shutil.copytree(TOP / "varsift", tmp_path / "varsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr
