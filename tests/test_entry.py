"""The entry module with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from mediaquarry.operators import graph

ROOT = Path(__file__).parent.parent


def names(where, gone=()):
    said = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    run = subprocess.run([sys.executable, "-c", said], cwd=where, capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


@pytest.mark.parametrize("gone", [("mediaquarry/llm", "corpus_pipeline.py"), ("mediaquarry/llm",)])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    left = names(copy)
    assert left and not any(n.startswith("op") or n == "pipeline" for n in left)


def test_staged_tables_are_forgotten(spark):
    table = graph.stage(spark.range(3), "numbers")
    assert table.count() == 3 and Path(graph.shared_dir(spark)).exists()
    graph.forget(spark)
    assert not Path(graph.shared_dir(spark)).exists()
