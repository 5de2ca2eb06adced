"""Executors that don't have the package installed run the corpus queries."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from skerry.llm import queries
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name, f in queries.queries().items():
    print("RAN", name, f(spark, {data!r}).count())
"""


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_all(tmp_path):
    from skerry.llm import queries

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), data=DATA)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.count("RAN") == len(queries.queries()), done.stderr[-2000:]
