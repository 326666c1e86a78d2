"""Workers need no copy of the package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from gridloom import facade
df = spark.range(5).selectExpr("id AS n", "concat('t', id) AS t")
folder = facade.write_parts(df, sys.argv[2] + "/books", "ods", rows=2, assoc=True)
print("ROWS", facade.read(spark, folder, format="ods", assoc=True).count())
"""


def test_no_package_on_workers(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 5" in done.stdout, done.stderr[-2000:]
