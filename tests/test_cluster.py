"""Queries on executors that are processes of their own, where nothing but the shared folder is common to them and the driver."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import json, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tessera import registry
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{sys.argv[2]}/shared", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
registry.load_plans()
print("rows", json.dumps({n: registry.QUERIES[n](spark, "/root/testdata/sf0.001").count() for n in sys.argv[3:]}))
spark.stop()
"""


@pytest.fixture(scope="module")
def rows(tmp_path_factory):
    at = tmp_path_factory.mktemp("cluster")
    (at / "home").mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (at / "home" / p.name).symlink_to(p)
    names = "s11_jdbc_strides s12_jdbc_predicates s13_jdbc_append s14_jdbc_dialect s37_jdbc_ranges".split()
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_")} | {"SPARK_HOME": f"{at}/home", "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", RUN, ROOT, at, *names], env=env, cwd=at, capture_output=True, text=True, timeout=300)
    found = [x for x in done.stdout.splitlines() if x.startswith("rows ")]
    assert found, done.stderr[-2000:]
    return json.loads(found[0][5:])


@pytest.mark.parametrize("name,n", [("s11_jdbc_strides", 25), ("s12_jdbc_predicates", 10), ("s13_jdbc_append", 50), ("s14_jdbc_dialect", None), ("s37_jdbc_ranges", 19)])
def test_embedded_database(rows, name, n):
    assert rows[name] == n if n else rows[name] > 0
