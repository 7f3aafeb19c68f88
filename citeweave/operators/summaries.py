"""What is shown of papers and paths: counts for notes, eras, parts and spans of a path, rows of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First year of what counts as recent.
RECENT = 2015
#: Characters of a text shown in each kind of prompt.
SHOWN = {"explain": 400, "judge": 350, "anchor": 1200, "rerank": 600}


def shown(text: Column, kind: str) -> Column:
    """A text as a prompt of this kind shows it: its first characters, nothing for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, SHOWN[kind])


def shown_year(year: Column) -> Column:
    return F.coalesce(year.cast("string"), F.lit("n.d."))


def era(year: Column) -> Column:
    return F.when(year.isNull(), "undated").when(year < RECENT, "earlier").otherwise("recent")


def notes(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(topic, papers, undated, discovered, edges) of nodes (topic, paper_id, year), their edges and the searched seeds."""
    found = nodes.join(seeds.select("topic", "paper_id", F.lit(True).alias("seed")), ["topic", "paper_id"], "left")
    counts = found.groupBy("topic").agg(F.count("*").alias("papers"), F.count_if(F.col("year").isNull()).alias("undated"), F.count_if(F.col("seed").isNull()).alias("discovered"))
    return counts.join(edges.groupBy("topic").agg(F.count("*").alias("edges")), "topic", "left").fillna(0, ["edges"])


def parts(path: DataFrame) -> DataFrame:
    """(topic, part, steps, first_position, first_year, last_year): steps by stage, or by level where the path has none."""
    ways = ([F.col("stage")] if "stage" in path.columns else []) + ([F.concat(F.lit("level "), F.col("level"))] if "level" in path.columns else [])
    part = F.coalesce(*ways, F.lit("path"))
    return path.groupBy("topic", part.alias("part")).agg(F.count("*").alias("steps"), F.min("position").alias("first_position"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def other_prerequisites(path: DataFrame) -> DataFrame:
    """The path with others: prerequisites (array) that aren't the step before."""
    before = F.lag("paper_id").over(Window.partitionBy("topic").orderBy("position"))
    return path.withColumn("others", F.array_except("prerequisites", F.array(before)))


def judged(edges: DataFrame) -> DataFrame:
    """(topic, judged): whether all edges (topic, source) of a topic that has any are a model's."""
    return edges.groupBy("topic").agg(F.bool_and(F.col("source") == "llm_judgment").alias("judged"))
