"""Selection of papers under quotas, and of candidate prerequisite pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators.steps import Steps, top_of


def has_topic_evidence() -> Column:
    """Condition on (co_citations, in_degree): two seeds cite the paper, or two papers of the subgraph do."""
    return (F.col("co_citations") >= 2) | (F.col("in_degree") >= 2)


def select_papers(papers: DataFrame, budget: int = 24, least: int = 3) -> DataFrame:
    """(topic, paper_id, reason) of at most `budget` papers a topic.

    papers: topic, paper_id, seed_rank (null unless a search found it), co_citations, in_degree, z. First foundations (by
    co-citations) and then seeds (by rank), each up to 2/5 of the budget, then the rest with evidence by z.
    """
    quota, key = max(1, budget * 2 // 5), ["topic", "paper_id"]
    steps = Steps(papers.sparkSession, "select")  # what several steps use is written once
    rows = steps.save(papers.select(*key, "seed_rank", "co_citations", "in_degree", "z"), "rows")
    best = lambda df, by, k: top_of(df, ["topic"], [*by, F.col("paper_id")], k, "r")
    foundations = best(rows.where(F.col("co_citations") >= least), [F.desc("co_citations"), F.desc("z")], quota).select(*key, F.lit("foundation").alias("reason"))
    left = rows.join(foundations, key, "left_anti")
    surface = best(left.where("seed_rank IS NOT NULL"), [F.col("seed_rank")], quota).select(*key, F.lit("surface").alias("reason"))
    first = steps.save(foundations.unionByName(surface), "first")
    taken = first.groupBy("topic").agg(F.count("*").alias("taken"))
    rest = best(rows.where(has_topic_evidence()).join(first, key, "left_anti"), [F.desc("z")], budget).join(taken, "topic", "left")
    rest = rest.where(F.col("r") <= budget - F.coalesce("taken", F.lit(0))).select(*key, F.lit("evidence").alias("reason"))
    return first.unionByName(rest)


def candidate_pairs(selected: DataFrame, edges: DataFrame, limit: int = 60) -> DataFrame:
    """(topic, prerequisite_id, dependent_id, co_citations, position): citations among the selected papers (topic, paper_id,
    year, co_citations, z), without those of newer papers, by co-citations and z of the cited."""
    side = lambda end: selected.select("topic", F.col("paper_id").alias(f"{end}_id"), *(F.col(c).alias(f"{end}_{c}") for c in ("year", "co_citations", "z")))
    pairs = edges.where("citing_id <> cited_id").join(side("citing"), ["topic", "citing_id"]).join(side("cited"), ["topic", "cited_id"])
    pairs = pairs.where("citing_year IS NULL OR cited_year IS NULL OR cited_year <= citing_year")
    pairs = top_of(pairs, ["topic"], [F.desc("cited_co_citations"), F.desc("cited_z"), F.col("cited_id"), F.col("citing_id")], limit)
    return pairs.select("topic", F.col("cited_id").alias("prerequisite_id"), F.col("citing_id").alias("dependent_id"), F.col("cited_co_citations").alias("co_citations"), "position")
