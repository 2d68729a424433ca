"""Python workers need no copy of the package: every query runs from a folder without it."""

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF001

CODE = """
import importlib.util, json, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .getOrCreate())
print("ROWS", json.dumps({n: q(spark, sys.argv[2]).count() for n, q in entry.queries().items() if n.startswith("op") and "_" in n[:5]
                          and n[2].isdigit()}))
"""


def test_all_operators_run_in_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, ROOT, SF001], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    rows = json.loads(next(x for x in done.stdout.splitlines() if x.startswith("ROWS"))[5:])
    assert len(rows) == 13 and all(n > 0 for name, n in rows.items() if name != "op10_decontamination"), rows
