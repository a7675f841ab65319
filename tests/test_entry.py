"""The entry works with the training-data operators and without them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

LOOK = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q; print('pipeline' in q, len(q))"


def _looked(folder):
    return subprocess.run([sys.executable, "-c", LOOK], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True)


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_training_data_operators(tmp_path, left_out):
    for name in ("trustfold", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if name in left_out or not os.path.exists(source):
            continue
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *left_out))
        else:
            shutil.copy(source, tmp_path / name)
    seen = _looked(tmp_path)
    assert seen.returncode == 0, seen.stderr
    assert seen.stdout.split()[0] == "False" and int(seen.stdout.split()[1]) > 70
