"""Workers need no copy of the package: models travel to them by value."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from gridloom.llm import language_id, toxicity
docs = spark.range(40).selectExpr("id AS doc_id", "if(id % 2 = 0, 'the cat and the dog', 'der hund und die katze') AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
print("LANGS", language_id.identify(docs, language_id.fit(language_id.training_rows(docs))).filter("lang_pred <> 'und'").count())
print("SCORES", toxicity.score(docs, toxicity.fit(docs, labels)).count())
"""


def test_no_package_on_workers(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "LANGS 40" in done.stdout and "SCORES 40" in done.stdout, done.stderr[-2000:]
