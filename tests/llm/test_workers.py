import os
import subprocess
import sys

from conftest import ROOT, SMALL

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as contract
for name in ("op9_secret_scan", "op5_packing", "op3_language_id"):
    assert contract.queries()[name](spark, {small!r}).count() >= 200
print("done")
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=ROOT, small=SMALL)
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
