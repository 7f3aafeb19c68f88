"""Citation-graph expansion: edge cleaning, co-citation, ancestors and three passes over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.steps import top_of


def clean_edges(citations: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (topic, citing_id, cited_id) without loops, with both ends among nodes (topic, paper_id) if given."""
    edges = citations.where("citing_id <> cited_id").select("topic", "citing_id", "cited_id").distinct()
    if nodes is None:
        return edges
    for end in ("citing_id", "cited_id"):
        edges = edges.join(nodes.select("topic", F.col("paper_id").alias(end)), ["topic", end], "left_semi")
    return edges.select("topic", "citing_id", "cited_id")


def remap_edges(citations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between raw rows as edges between the papers that rows (row_id, paper_id) became; loops go."""
    for end in ("citing", "cited"):
        citations = citations.join(mapping.select(F.col("row_id").alias(f"{end}_row"), F.col("paper_id").alias(f"{end}_id")), f"{end}_row")
    return clean_edges(citations)


def co_citations(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(topic, paper_id, n): how many distinct seeds cite the paper."""
    citing = edges.join(seeds.select("topic", F.col("paper_id").alias("citing_id")), ["topic", "citing_id"], "left_semi")
    return citing.groupBy("topic", F.col("cited_id").alias("paper_id")).agg(F.countDistinct("citing_id").alias("n"))


def ancestors(counts: DataFrame, seeds: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """Papers that enough seeds cite and that aren't seeds; of each topic the `most` most cited, with position from 1."""
    others = counts.where(F.col("n") >= least).join(seeds.select("topic", "paper_id"), ["topic", "paper_id"], "left_anti")
    return top_of(others, ["topic"], [F.desc("n"), F.col("paper_id")], most)


def backward(citations: DataFrame, starts: DataFrame) -> DataFrame:
    return citations.join(starts.select("topic", F.col("paper_id").alias("citing_id")), ["topic", "citing_id"], "left_semi")


def forward(citations: DataFrame, starts: DataFrame, papers: DataFrame | None = None, about=None) -> DataFrame:
    """Citations of `starts`; with papers and a condition on them, by citing papers that meet it (on the topic)."""
    edges = citations.join(starts.select("topic", F.col("paper_id").alias("cited_id")), ["topic", "cited_id"], "left_semi")
    if papers is None or about is None:
        return edges
    return edges.join(papers.where(about).select("topic", F.col("paper_id").alias("citing_id")), ["topic", "citing_id"], "left_semi")


def limited(edges: DataFrame, end: str, most: int | None, papers: DataFrame | None = None) -> DataFrame:
    """Of the edges of each paper at `end` (citing_id: its references, cited_id: what cites it) `most` at the most: those whose other
    paper is cited most, by papers (topic, paper_id, citation_count), unknown counts last; ties, and all without papers, by the
    smaller id. Papers cited by very many are spread over tasks."""
    if most is None:
        return edges
    other = "cited_id" if end == "citing_id" else "citing_id"
    rows, by = edges.select("topic", "citing_id", "cited_id").distinct(), [F.col(other)]
    if papers is not None:
        rows = rows.join(papers.select("topic", F.col("paper_id").alias(other), F.col("citation_count").alias("_cited")), ["topic", other], "left")
        by = [F.desc_nulls_last("_cited"), *by]
    return top_of(rows, ["topic", end], by, most, "_place").select("topic", "citing_id", "cited_id")


def expand(
    citations: DataFrame, seeds: DataFrame, least: int = 3, most: int = 20, ancestor_seeds: int = 12, forward_seeds: int = 6,
    references_per_paper: int | None = None, citations_per_paper: int | None = None, papers: DataFrame | None = None,
) -> DataFrame:
    """Edges (topic, citing_id, cited_id, passes) of three passes: references of seeds, references of their ancestors,
    and citations of the first ancestors. The limits per paper are those of limited(); None takes all."""
    one = limited(backward(citations, seeds), "citing_id", references_per_paper, papers)
    found = ancestors(co_citations(one, seeds), seeds, least, most)
    two = limited(backward(citations, found.where(F.col("position") <= ancestor_seeds)), "citing_id", references_per_paper, papers)
    three = limited(forward(citations, found.where(F.col("position") <= forward_seeds)), "cited_id", citations_per_paper, papers)
    parts = [e.select("topic", "citing_id", "cited_id", F.lit(i).alias("p")) for i, e in enumerate((one, two, three), 1)]
    return parts[0].union(parts[1]).union(parts[2]).where("citing_id <> cited_id").groupBy("topic", "citing_id", "cited_id").agg(F.array_sort(F.collect_set("p")).alias("passes"))


def discovered(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Papers of the edges that no search had found."""
    nodes = edges.select("topic", F.explode(F.array("citing_id", "cited_id")).alias("paper_id")).distinct()
    return nodes.join(seeds.select("topic", "paper_id"), ["topic", "paper_id"], "left_anti")


def outcomes(calls: DataFrame) -> DataFrame:
    """(provider, ok, requests, papers_added, last_error) of calls (provider, seq, error, papers)."""
    return calls.groupBy("provider").agg(
        F.bool_and(F.col("error").isNull()).alias("ok"), F.count("*").alias("requests"), F.sum("papers").alias("papers_added"),
        F.max_by(F.col("error"), F.when(F.col("error").isNotNull(), F.col("seq"))).alias("last_error"),
    )
