"""Kernels and broadcasts travel by value: workers that can't import the package run all queries."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[3]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def there(_):
    try:
        import moraine
        return [True]
    except ImportError:
        return [False]
assert not any(spark.sparkContext.parallelize(range(4), 4).mapPartitions(there).collect()), "the workers have the package"
sys.path.insert(0, sys.argv[1])
from moraine.llm import catalog
for name, query in catalog.queries().items():
    rows = query(spark, sys.argv[2]).count()
    assert rows > 0, name
    print("ran", name, rows)
"""


def test_workers_without_the_package(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("SPARK")}
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", SCRIPT, root, sf_dir, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == 10
