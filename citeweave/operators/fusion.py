"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.steps import top_of


def reciprocal_rank_fusion(hits: DataFrame, k: int = 60) -> DataFrame:
    """(topic, paper_id, score, found_by, ranks) of hits (topic, provider, paper_id, rank): the sum of 1 / (k + rank) over
    providers, each by its best rank for the paper. Added up in the order of providers, so the sum is the same anywhere."""
    best = hits.groupBy("topic", "paper_id", "provider").agg(F.min("rank").alias("rank"))
    rows = F.array_sort(F.collect_list(F.struct("provider", "rank")))
    fused = best.groupBy("topic", "paper_id").agg(rows.alias("r"))
    score = F.aggregate("r", F.lit(0.0), lambda a, x: a + 1.0 / (k + x["rank"]))
    return fused.select("topic", "paper_id", score.alias("score"), F.transform("r", lambda x: x["provider"]).alias("found_by"), F.map_from_entries("r").alias("ranks"))


def top_per_topic(fused: DataFrame, limit: int, *more: str) -> DataFrame:
    """The `limit` best of each topic with their position from 1: by score, number of providers, then `more` and the id."""
    return top_of(fused.withColumn("_n", F.size("found_by")), ["topic"], [F.desc("score"), F.desc("_n"), *map(F.col, more), F.col("paper_id")], limit).drop("_n")
