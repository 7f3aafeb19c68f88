"""Tables that cut the lineage of iterations, in the folder that the cluster shares; and ranks without a group in one task."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of so many rows at the most are broadcast.
BROADCAST_ROWS = 100_000
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs in this process, else one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_citeweave"
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="citeweave-ops-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class Steps:
    """Tables of one run of an operator. Those that a result reads stay; others are dropped when a later one replaces them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, f"citeweave_{re.sub('[^a-z]', '', tag)}_{uuid.uuid4().hex}"
        self.base = f"{shared_folder(spark)}/{self.tag}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def save_by(self, df: DataFrame, name: str, *columns: str) -> DataFrame:
        """The same, in as many buckets by `columns` as shuffles have partitions: joins on them don't move the table."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        full = f"{self.tag}_{name}"
        df.repartition(n, *columns).write.bucketBy(n, *columns).option("path", f"{self.base}/{name}").format("parquet").saveAsTable(full)
        return self.spark.table(full)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.tag}_{name}`")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def small(df: DataFrame) -> DataFrame:
    """`df` to be broadcast if it has few rows, by their count."""
    return F.broadcast(df) if few(df) else df


def top_of(df: DataFrame, keys: list[str], order: list[str | Column], k: int, name: str = "position", salts: int = 32) -> DataFrame:
    """The first k rows of each key, with their place (int, from 1) as `name`. Best lists merge: each task keeps k rows of a
    key, then each of `salts` parts of it, and only these k * salts meet; so a key of any size is spread over tasks. Rows that
    tie in all of `order` come in any order."""
    held = [c for c in df.columns if c != name]
    plain = [c for c, kind in df.dtypes if c in held and c not in keys and not kind.startswith(("map", "array", "struct"))]
    dealt = df.select(*held).withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
    part = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    few_of = dealt.withColumn("_r", part).where(F.col("_r") <= k)
    return few_of.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k).select(*held, name)


def ranked(df: DataFrame, key: str, order: list[str | Column], name: str, steps: Steps) -> DataFrame:
    """Adds `name`, the row's place (int, from 0) in the order of its key. Rows are dealt out by ranges of key and order, so
    that a key with many rows is spread over tasks; each task's count then gives the places at which the others start."""
    keyed = df.select("*", *[c.alias(f"_o{i}") if isinstance(c, Column) else F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    by = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]
    dealt = steps.save(keyed.repartitionByRange(key, *by).withColumn("_part", F.spark_partition_id()), f"dealt_{name}")
    counts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(key, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*by))
    out = dealt.withColumn("_own", own).join(small(starts), [key, "_part"])
    return out.select(*df.columns, (F.col("_start") + F.col("_own") - 1).cast("int").alias(name))
