"""The registry works with and without the text operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def _names(root: str) -> tuple[int, int]:
    done = subprocess.run([sys.executable, "-c", LIST], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    return tuple(map(int, done.stdout.split()))


def _copy(tmp_path) -> str:
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))


def test_registry_without_text_operators(tmp_path):
    root = _copy(tmp_path)
    core = None
    for gone in (["logweave/llm", "tests/llm"], ["corpus_pipeline.py"]):
        for name in gone:
            path = os.path.join(root, name)
            shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else os.path.exists(path) and os.remove(path)
        n, text = _names(root)
        assert text == 0 and n > 70
        assert core in (None, n)
        core = n


def test_registry_with_left_over_caches(tmp_path):
    root = _copy(tmp_path)
    shutil.rmtree(os.path.join(root, "logweave/llm"), ignore_errors=True)
    os.makedirs(os.path.join(root, "logweave/llm/__pycache__"))
    assert _names(root)[1] == 0
