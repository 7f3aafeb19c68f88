"""Saved payloads of paper services as a data source: folders by provider, mode and topic, of which a query reads what it asks for.

Modes: search (what a topic's query found, in order), cited_by (the references of the paper named in `of`) and cites (what cites
it). save() writes them; the source `citeweave_payloads` reads them, a partition a folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from citeweave.sources import parsers

LAYOUT = ("provider", "mode", "topic")
SCHEMA = "provider string, mode string, topic string, of string, page int, payload string"
MODES = ("search", "cited_by", "cites")
_NULL = "__HIVE_DEFAULT_PARTITION__"


def save(rows: DataFrame, path: str) -> None:
    """Rows of SCHEMA, added to the folder. Rows of one topic lie together."""
    rows.select("provider", "mode", "topic", F.col("of").cast("string").alias("of"), F.col("page").cast("int").alias("page"), "payload").repartition(*LAYOUT).write.mode("append").partitionBy(*LAYOUT).parquet(path)


class Folder(InputPartition):
    def __init__(self, path: str, values: tuple):
        super().__init__(0)
        self.path, self.values = path, values


class PayloadReader(DataSourceReader):
    """Takes over equality and membership on the three columns of the layout; the rest is left to Spark."""

    def __init__(self, path: str):
        self.path, self.wanted = path, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in LAYOUT:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = values & self.wanted.get(name, values)

    def _folders(self) -> Iterator[Folder]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path)
        level = [(top, ())]
        for name in LAYOUT:
            below = []
            for path, values in level:
                for info in store.get_file_info(fs.FileSelector(path)):
                    key, _, value = info.base_name.partition("=")
                    value = None if value == _NULL else unquote(value)
                    if info.type == fs.FileType.Directory and key == name and (name not in self.wanted or value in self.wanted[name]):
                        below.append((info.path, (*values, value)))
            level = below
        for path, values in level:
            yield Folder(path, values)

    def partitions(self) -> list[Folder]:
        return sorted(self._folders(), key=lambda f: f.path) or [Folder("", ())]

    def read(self, partition: Folder):
        if not partition.path:
            return
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        files = [i.path for i in store.get_file_info(fs.FileSelector(partition.path)) if i.base_name.endswith(".parquet")]
        for batch in ds.dataset(files, filesystem=store, format="parquet").to_batches(columns=["of", "page", "payload"], batch_size=256):
            own = [pa.array([v] * batch.num_rows, pa.string()) for v in partition.values]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns], names=[*LAYOUT, "of", "page", "payload"])


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "citeweave_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        path = self.options["path"]
        return PayloadReader(path if "://" in path or path.startswith("file:") else f"file://{path}")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """All saved payloads; conditions on provider, mode and topic decide which folders are read."""
    spark.dataSource.register(PayloadSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("citeweave_payloads").load(path)


def records(spark: SparkSession, path: str, provider: str, mode: str = "search", topics: list[str] | None = None, limit: int | None = None, page_size: int = 25) -> DataFrame:
    """Papers of one provider's payloads: topic, of, and the parser's columns, rank counted over pages of `page_size`; of each topic
    (and paper asked about) the first `limit`. Unknown providers and modes, and modes that the provider hasn't, are errors."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; known: {', '.join(MODES)}")
    if provider not in parsers.sources([provider], "search" if mode == "search" else "citations"):
        raise ValueError(f"{provider} has no {mode}")
    rows = payloads(spark, path).where((F.col("provider") == provider) & (F.col("mode") == mode))
    if topics is not None:
        rows = rows.where(F.col("topic").isin(*topics))
    found = parsers.REGISTRY[provider][0](rows, keep=("topic", "of", "page")).withColumn("rank", F.col("page") * page_size + F.col("rank")).drop("page")
    return found if limit is None else found.where(F.col("rank") <= limit)


def links(found: DataFrame, mode: str) -> DataFrame:
    """(topic, citing_id, cited_id, provider) of records() in mode cited_by or cites, by each record's first external id."""
    own = F.get("external_ids", F.lit(0))["value"]
    citing, cited = (F.col("of"), own) if mode == "cited_by" else (own, F.col("of"))
    return found.select("topic", citing.alias("citing_id"), cited.alias("cited_id"), "provider").where("citing_id IS NOT NULL AND cited_id IS NOT NULL")
