"""The entry works with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def _names(folder):
    out = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=folder, capture_output=True, text=True, timeout=120,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert not out.returncode, out.stderr
    return [line.split() for line in out.stdout.splitlines()[-2:]]


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/riskframe", tmp_path / "riskframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names, sql = _names(tmp_path)
    assert "d4_relative_risk" in names and not [n for n in names if n.startswith("op")] and "pipeline" not in names
    assert set(sql) <= set(names)
