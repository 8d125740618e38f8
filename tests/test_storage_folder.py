"""Tables of an application go at release; the package works from another folder."""

import os
import subprocess
import sys

from routeloom.storage import new_folder, release, stored

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").config("spark.checkpoint.dir", {folder!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
sys.path.remove({root!r})
print("ROWS", entry.queries()["chunk_search"](spark, "/root/testdata/sf0.001").count())
"""


def test_another_folder_and_workers_without_the_package(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=ROOT, folder=f"file://{tmp_path}/shared")
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr
    assert not list(tmp_path.glob("shared/routeloom-*"))


def test_release(spark):
    path = new_folder(spark)
    table = stored(spark.range(5).toDF("x"))
    assert table.count() == 5
    own = os.path.dirname(path).removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(own)
    release(spark)
    assert not os.path.isdir(own)
