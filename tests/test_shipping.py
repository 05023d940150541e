"""The library's modules reach Python workers that don't have them on their path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from evispark.plans.catalogue import QUERIES
print("ROWS", QUERIES["chunk_structured"](spark, "/root/testdata/sf0.001").count(), QUERIES["unified_sources"](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    rows = [line.split()[1:] for line in said.stdout.splitlines() if line.startswith("ROWS")]
    assert rows and all(int(n) > 0 for n in rows[0]), said.stderr[-2000:]
