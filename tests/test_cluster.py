"""Queries on executors in processes of their own, which share no memory with the driver."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import pytest

RUN = """
from pyspark.sql import SparkSession
import __spark_entry__, sys
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "700m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
rows = __spark_entry__.queries()[sys.argv[1]](spark, "/root/testdata/sf0.001").collect()
print("\\n".join(sorted("|".join(map(str, r)) for r in rows)))
spark.stop()
"""


@pytest.fixture
def on_cluster(tmp_path):
    home = tmp_path / "home"  # the executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    repo = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"PYTHONPATH": repo, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}

    def run(name):
        done = subprocess.run([sys.executable, "-c", RUN, name, str(tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        return done.stdout.splitlines()

    return run


def test_database_source_is_read_by_other_processes(on_cluster):
    assert on_cluster("rml_database_source") == [f'<http://ex/R/{k}> <http://ex/label> "{n}" .' for k, n in ((2, "ASIA"), (3, "EUROPE"), (4, "MIDDLE EAST"))]
