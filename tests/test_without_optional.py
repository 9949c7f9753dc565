"""The library without its optional package, as a copy of the repository."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_optional_package(tmp_path):
    copy = tmp_path / "copy"
    left_out = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm")
    shutil.copytree(ROOT, copy, ignore=left_out)
    assert not (copy / "seqloom" / "llm").exists() and (copy / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(s) <= set(q), len(q); assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    run = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout + run.stderr
