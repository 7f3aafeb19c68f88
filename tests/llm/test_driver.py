"""What the driver holds after a statement, in a process of its own: other tests would leave theirs."""

import os
import subprocess
import sys

HELD = """
import gc, time
from pyspark.sql import SparkSession, functions as F
from citeweave.llm import pii

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
spark.createDataFrame([(1, "x", "y")], "doc_id bigint, text string, more string").createOrReplaceTempView("t")
docs, vm = spark.table("t"), spark._jvm.java.lang.Runtime.getRuntime()

def held():
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
    return (vm.totalMemory() - vm.freeMemory()) / 1e6

docs.withColumn("n", F.expr("transform(split(text, ''), x -> concat(x, more))")).collect()
before = held()
names = pii.stage(spark, docs, "").columns
print("GROWN", held() - before, spark.conf.get("spark.sql.parser.parserDfaCacheFlushThreshold"), *names)
"""


def test_long_sql_is_forgotten():
    out = subprocess.run([sys.executable, "-c", HELD], env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, text=True, timeout=300)
    grown, threshold, *names = out.stdout.rpartition("GROWN")[2].split()
    assert float(grown) < 30 and int(threshold) < 0 and names == ["doc_id", "text", "more"]
