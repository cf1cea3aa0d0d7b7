"""Executors need no copy of the package: the tasks of every operator carry what they use."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", {entry!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("surface_training_run", "local_outliers_suppliers", "isolation_forest_filter", "network_early_stop",
             "linear_support_vector_errors", "gaussian_process_errors", "neighbour_imputation"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all done")
"""


def test_run_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "elsewhere.py"
    script.write_text(SCRIPT.format(entry=os.path.join(root, "__spark_entry__.py")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all done" in done.stdout, done.stderr[-3000:]
