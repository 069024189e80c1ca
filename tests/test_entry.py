"""The registered queries of a copy without the optional subpackage."""

import json
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_subpackage(tmp_path, pipeline):
    copy = tmp_path / "copy"
    left_out = [".git", "__pycache__", "llm", "tests"] + ([] if pipeline else ["corpus_pipeline.py"])
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(*left_out))
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    queries, oracles = json.loads(done.stdout)
    own = {name for module in entry._modules() if module.__name__.startswith("workloads.") for name in module.QUERIES}
    assert set(queries) == own and set(oracles) <= own and len(own) > 80
