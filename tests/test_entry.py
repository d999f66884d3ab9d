"""The driver loads __spark_entry__ from its own working directory: queries
whose work runs in Python workers must still import the package there."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
q = m.queries()
print("ROWS", q["normality_flags"](spark, "/root/testdata/sf0.001").count(),
      q["knn_join"](spark, "/root/testdata/sf0.001").count(), m.entry(spark).count())
"""


def test_python_stages_run_from_foreign_cwd(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=900)
    line = [x for x in out.stdout.splitlines() if x.startswith("ROWS")]
    assert line, out.stderr[-2000:]
    n_norm, n_knn, n_entry = map(int, line[0].split()[1:])
    assert n_norm > 0 and n_knn > 0 and n_entry > 0
