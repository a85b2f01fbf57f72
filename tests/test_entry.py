"""The entry module with and without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__  # noqa: F401
from workbook.registry import QUERIES

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["episcope/llm", "corpus_pipeline.py"], ["episcope/llm"], ["corpus_pipeline.py"]])
def test_import_without_the_subpackage(tmp_path, gone):
    for name in ("episcope", "workbook"):
        shutil.copytree(f"{REPO}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *[os.path.basename(g) for g in gone]))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and os.path.exists(f"{REPO}/{name}"):
            shutil.copy(f"{REPO}/{name}", tmp_path)
    found = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), *e.queries())"],
                           cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr[-500:]
    count, *names = found.stdout.split()
    assert int(count) >= 177 and set(names) == set(QUERIES)


def test_other_missing_modules_are_errors(tmp_path):
    for name in ("episcope", "workbook"):
        shutil.copytree(f"{REPO}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    found = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path,
                           env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert found.returncode and "no_such_module" in found.stderr
