from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "score", "depth"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "latticeframe", tmp_path / "latticeframe", ignore=ignore)
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=ignore)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_exact_cosine' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    some = ["tests/test_language.py", "tests/test_plans.py", "tests/test_entry.py::test_entry"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", *some], cwd=tmp_path, env=env, check=True)
