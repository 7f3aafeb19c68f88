"""A keyed table in a folder that jobs write to again and again: one row a key, whole versions or none.

Rows lie by the first characters of their key. A write makes new folders for the prefixes it touches and then names them in a
new list; readers follow the newest list, so that they see a write whole or not at all, and a task that runs twice adds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """schema: of the rows, as text; its first column is `key`, hexadecimal. prefix: so many characters part the rows (2: 256 parts)."""

    def __init__(self, spark: SparkSession, root: str, schema: str, prefix: int = 2):
        self.spark, self.root, self.schema, self.prefix = spark, root.rstrip("/"), schema, prefix

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _newest(self) -> tuple[int, dict[str, str]]:
        """Number and contents (prefix to folder) of the newest list; 0 and nothing before the first write."""
        path, fs = self._path("lists")
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()] if fs.exists(path) else []
        if not numbers:
            return 0, {}
        return max(numbers), json.loads(self.spark.read.text(f"{self.root}/lists/{max(numbers)}", wholetext=True).first()[0])

    def _at(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in sorted(folders)])

    def read(self) -> DataFrame:
        return self._at([*self._newest()[1].values()])

    def upsert(self, rows: DataFrame) -> None:
        """Rows take the place of those with their keys. Of several rows with one key the smallest by its values counts; rows without
        a key are dropped. If another writer was first, the write is made anew on top of it."""
        columns = rows.columns
        once = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(*[c for c in columns if c != "key"])).alias("_r")).select(*[c if c == "key" else F.col("_r")[c].alias(c) for c in columns])
        part = F.substring("key", 1, self.prefix)
        while True:
            number, folders = self._newest()
            version = f"rows/{uuid.uuid4().hex}"
            touched = [r[0] for r in once.select(part).distinct().collect()]  # as many as there are prefixes, at most
            if not touched:
                return
            old = self._at([folders[p] for p in touched if p in folders]).join(once.select("key"), "key", "left_anti")
            merged = old.select(*columns).unionByName(once).withColumn("_p", part)
            merged.repartition("_p").write.partitionBy("_p").parquet(f"{self.root}/{version}")
            if self._publish(number + 1, folders | {p: f"{version}/_p={p}" for p in touched}):
                return

    def _publish(self, number: int, folders: dict[str, str]) -> bool:
        """Whether list `number` is this one now: it is written aside and renamed, which fails where the name is taken."""
        aside, fs = self._path(f"lists/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        out.close()
        target, _ = self._path(f"lists/{number}")
        if not fs.exists(target) and fs.rename(aside, target):
            return True
        fs.delete(aside, False)
        return False

    def clean(self) -> None:
        """Removes folders and lists that the newest list doesn't name; for times without readers of older ones."""
        number, folders = self._newest()
        used = {f.split("/")[1] for f in folders.values()}
        for top, keep in (("rows", used), ("lists", {str(number)})):
            path, fs = self._path(top)
            for f in fs.listStatus(path) if fs.exists(path) else []:
                if f.getPath().getName() not in keep:
                    fs.delete(f.getPath(), True)
