import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tapeline import plans

ROOT = Path(__file__).resolve().parents[1]
SAYS = """
import __spark_entry__ as e
print("NAMES", *sorted(e.queries()))
print("SQL", *sorted(e.oracle_sql()))
import pkgutil, importlib, tapeline
for m in pkgutil.walk_packages(tapeline.__path__, "tapeline."):
    importlib.import_module(m.name)
"""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [("tapeline/llm", "tests/llm"), ("tapeline/llm", "tests/llm", "corpus_pipeline.py"), ("tapeline/llm/*", "corpus_pipeline.py")])
def test_the_rest_works_without_the_training_data_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for path in gone:
        for found in copy.glob(path):
            shutil.rmtree(found) if found.is_dir() else found.unlink()
    out = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0, out.stderr
    lines = dict(line.split(" ", 1) for line in out.stdout.splitlines() if line.startswith(("NAMES ", "SQL ")))
    assert lines["NAMES"].split() == sorted(plans.QUERIES)
    assert lines["SQL"].split() == sorted(plans.ORACLE)
