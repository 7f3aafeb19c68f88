"""Entity resolution: which raw records are one paper, and the merged papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.ids import canonical_id
from citeweave.functions.text import title_fingerprint
from citeweave.operators.components import connected_components
from citeweave.operators.steps import Steps

#: Titles of fewer letters don't merge records.
LEAST_TITLE = 12


def saver(spark: SparkSession, tag: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a table into the folder that the cluster shares and reads it again."""
    return Steps(spark, tag).save


def _to_lowest(keyed: DataFrame, *keys: str) -> DataFrame:
    """Edges from every row to the lowest row of its key, so a key costs as many edges as it has rows."""
    lowest = keyed.groupBy(*keys).agg(F.min("row_id").alias("v"))
    return keyed.join(lowest, list(keys)).where("row_id <> v").select(F.col("row_id").alias("u"), "v")


def _components(rows: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
    """(row_id, root) for all rows; root is the lowest row_id of the component."""
    found = connected_components(edges, saver(rows.sparkSession, tag))
    return rows.select("row_id").join(found.withColumnRenamed("node", "row_id"), "row_id", "left").select("row_id", F.coalesce("component", "row_id").alias("root"))


def resolve_entities(records: DataFrame) -> DataFrame:
    """(topic, row_id, root): records of one topic that share an external id, or a title within a year of each other on
    both sides (so up to two years apart), are one paper; undated ones join the only dated paper of their title.

    records: topic, row_id (unique, in input order), title, year, external_ids (array of ns, value, in normal form).
    """
    ids = records.select("topic", "row_id", F.explode("external_ids").alias("id")).select("topic", "row_id", F.col("id.ns").alias("ns"), F.col("id.value").alias("value"))
    # Fingerprints are made once, and known by 32 bytes from there on.
    titled = records.select("topic", "row_id", "year", title_fingerprint(F.col("title")).alias("fp")).where(F.length("fp") >= LEAST_TITLE)
    titled = saver(records.sparkSession, "titled")(titled.withColumn("fp", F.unhex(F.sha2("fp", 256))), "titled")
    spread = titled.where("year IS NOT NULL").select("topic", "row_id", "fp", F.explode(F.expr("sequence(year - 1, year + 1)")).alias("near"))
    edges = _to_lowest(ids, "topic", "ns", "value").union(_to_lowest(spread, "topic", "fp", "near"))
    first = _components(records, edges, "resolve")
    undated = titled.where("year IS NULL").select("topic", "fp", "row_id")
    dated = titled.where("year IS NOT NULL").join(first, "row_id").groupBy("topic", "fp").agg(F.min("root").alias("only"), F.max("root").alias("last"))
    joined = undated.join(dated, ["topic", "fp"], "left")
    absorbed = joined.where("only = last").select(F.col("row_id").alias("u"), F.col("only").alias("v"))
    among = _to_lowest(joined.where("only IS NULL").select("topic", "fp", "row_id"), "topic", "fp")
    again = first.where("row_id <> root").select(F.col("row_id").alias("u"), F.col("root").alias("v"))
    return records.select("topic", "row_id").join(_components(records, again.union(absorbed).union(among), "absorb"), "row_id").select("topic", "row_id", "root")


def merge_papers(records: DataFrame, roots: DataFrame) -> DataFrame:
    """One row for each root: first title; first present abstract, venue and links; least year; most citations and depth;
    all ids; and the canonical id. records may lack optional columns."""
    have = set(records.columns)
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("row_id"))).alias(c)
    aggs = [F.min_by("title", "row_id").alias("title"), F.min("year").alias("year")]
    aggs += [first(c, F.col(c).isNotNull()) for c in ("abstract", "venue", "pdf_url", "landing_url") if c in have]
    if "authors" in have:
        aggs.append(first("authors", F.size("authors") > 0))
    aggs += [F.max(c).alias(c) for c in ("citation_count", "depth") if c in have]
    aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("external_ids")))).alias("external_ids"))
    merged = records.join(roots.select("row_id", "root"), "row_id").groupBy("topic", "root").agg(*aggs)
    return merged.withColumn("paper_id", canonical_id(F.col("external_ids"), F.col("title"), F.col("year")))
