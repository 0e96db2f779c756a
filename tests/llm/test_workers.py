"""Workers need no package: the driver alone imports it from a folder that no worker searches."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from stairwell.session import build_session
spark = build_session(2)
hidden = F.udf(lambda _: __import__("importlib.util").util.find_spec("stairwell") is None, "boolean")
assert spark.range(1).select(hidden("id")).first()[0]
from stairwell.llm import queries
for name in {names!r}:
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
"""


@pytest.mark.parametrize("names", [["op1_toxicity", "op10_quality_votes"], ["op11_subword_lattice", "op12_periodic_runs", "op13_merkle_manifest"]])
def test_package_hidden_from_workers(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO), names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=500)
    assert done.returncode == 0, done.stderr[-3000:]
