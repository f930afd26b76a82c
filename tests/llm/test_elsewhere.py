"""All text queries from an empty folder, where only the driver can import the package."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
s.sparkContext.setLogLevel("ERROR")
for name, q in e.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, q(s, {sf!r}).count(), flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_where_executors_lack_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE.format(root=root, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0, got.stderr[-3000:]
    found = dict(line.split() for line in got.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert len(found) == 14 and all(int(n) > 0 for n in found.values())
