"""The driver contract, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/heddle", tmp_path / "heddle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True).stdout.split()
    assert int(out[0]) > 60 and out[2] == "False"


def test_no_library_module_imports_the_optional_part():
    for folder, _, files in os.walk(f"{ROOT}/heddle"):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "heddle.llm" not in open(f"{folder}/{f}").read()
