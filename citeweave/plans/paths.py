"""Whole requests over many topics at once: ranked candidates, and reading paths from structure alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.text import band, provenance_stamp
from citeweave.operators import curriculum, expansion, graph, identity, judgment, ordering, resolver, selection
from citeweave.operators.fusion import reciprocal_rank_fusion, top_per_topic
from citeweave.operators.judgment import structural_role, with_median_year
from citeweave.sources import parsers
from citeweave.sources.settings import Settings


def search(records: DataFrame, hits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(topic, position, paper_id, title, year, score, found_by, ranks): records resolved to papers, and their ranks fused.

    records: topic, row_id, title, year, external_ids, ...; hits: topic, provider, row_id, rank.
    """
    roots = identity.resolve_entities(records)
    papers = identity.merge_papers(records, roots)
    of = roots.select("topic", "row_id", "root").join(papers.select("root", "paper_id"), "root")
    fused = reciprocal_rank_fusion(hits.where(F.col("rank") <= settings.candidates_per_provider).join(of.select("row_id", "paper_id"), "row_id"), settings.rrf_k)
    named = fused.join(papers.select("topic", "paper_id", "title", "year"), ["topic", "paper_id"])
    return top_per_topic(named.withColumn("_t", F.lower("title")), settings.max_candidates, "_t").drop("_t")


def structural_paths(papers: DataFrame, citations: DataFrame, seeds: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(topic, position, level, paper_id, title, year, role, reason, prerequisites, explanation, provenance) of one path a topic.

    papers: topic, paper_id, title, year and, for the limits per paper, citation_count if known; citations: topic, citing_id, cited_id; seeds: topic, paper_id, seed_rank. A topic
    without seeds has no path.
    """
    g, e = settings.graph, settings.expansion
    save = identity.saver(papers.sparkSession, "paths")  # what several steps use is written once
    counted = papers if "citation_count" in papers.columns else papers.withColumn("citation_count", F.lit(None).cast("long"))
    papers, citations, seeds = save(counted.select("topic", "paper_id", "title", "year", "citation_count"), "papers"), save(citations, "citations"), save(seeds, "seeds")
    first = seeds.where(F.col("seed_rank") <= e.seed_papers)
    ancestor_seeds, forward_seeds = e.ancestor_seeds if e.expand_ancestors else 0, e.forward_seeds if e.forward_enabled else 0
    edges = save(expansion.expand(citations, first, e.min_co_citations, e.max_ancestors, ancestor_seeds, forward_seeds, e.references_per_paper, e.citations_per_paper, papers), "expanded")
    ends = edges.select("topic", F.explode(F.array("citing_id", "cited_id")).alias("paper_id"))
    nodes = save(ends.union(seeds.select("topic", "paper_id")).distinct().join(papers, ["topic", "paper_id"]), "nodes")
    edges = save(expansion.clean_edges(edges, nodes), "edges")
    degrees = graph.degrees(nodes, edges)
    ranked = graph.pagerank(nodes, edges, g.damping, g.iterations, g.tolerance)
    z = graph.age_rescale(nodes.join(ranked, ["topic", "paper_id"]).select("topic", "paper_id", "year", "pagerank"), "pagerank", g.cohort_years, g.min_cohort)
    counts = expansion.co_citations(edges, seeds).withColumnRenamed("n", "co_citations")
    facts = nodes.join(degrees, ["topic", "paper_id"]).join(z.select("topic", "paper_id", "z"), ["topic", "paper_id"]).join(counts, ["topic", "paper_id"], "left").join(seeds, ["topic", "paper_id"], "left")
    facts = save(facts.fillna(0, ["co_citations"]), "facts")
    chosen = save(facts.join(selection.select_papers(facts, g.max_path_papers), ["topic", "paper_id"]), "chosen")
    pairs = selection.candidate_pairs(chosen, edges)
    claimed = judgment.structural_edges(pairs)
    roles = with_median_year(chosen).withColumn("role", structural_role()).withColumn("discovered", F.col("seed_rank").isNull()).withColumn("explanation", judgment.structural_explanation())
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("z"), F.desc("co_citations"), F.coalesce("year", F.lit(9999)), "paper_id"))
    order = ordering.order_paths(chosen.withColumn("rank", rank), expansion.clean_edges(edges, chosen), claimed)
    return order.join(roles.select("topic", "paper_id", "title", "year", "role", "reason", "explanation"), ["topic", "paper_id"]).select("topic", "position", "level", "paper_id", "title", "year", "role", "reason", "prerequisites", "explanation", provenance_stamp(F.lit("citation-graph"), F.lit(None), F.lit(None)).alias("provenance"))


#: Names that build_path() takes.
STRATEGIES = ("structural", "syllabus", "anchor", "rerank", "hybrid")
REFERENCES_SHOWN, CITERS_SHOWN = 40, 30


def build_path(strategy: str, papers: DataFrame, citations: DataFrame, seeds: DataFrame, plan: DataFrame | None = None, answers: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """One path a topic, by `strategy`.

    structural: structural_paths(). The others return (topic, position, paper_id, year, stage, concept, approximate, level,
    prerequisite_id, role, why_for_you, confidence, band, reasons). plan: topic, step, title, year, stage, concept, as a model has
    planned it; answers: topic, paper_id, position, stage, concept, as a model has chosen among what it was shown (without
    answers, anchor takes the most cited; rerank needs them). Titles that aren't found are dropped and cost confidence.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}: one of {', '.join(STRATEGIES)}")
    if strategy == "structural":
        return structural_paths(papers, citations, seeds, settings)
    budget, e = settings.graph.max_path_papers, settings.expansion
    lost = seeds.select("topic").limit(0)
    if strategy == "rerank":
        first = seeds.where(F.col("seed_rank") <= e.seed_papers)
        offered = curriculum.shortlist(expansion.co_citations(citations, first), seeds)
        steps = curriculum.rerank_steps(offered, answers, papers, budget)
    else:
        resolved = identity.saver(papers.sparkSession, "plan")(resolver.resolve_titles(plan, papers), "resolved")
        found = resolved.where("accepted")
        lost = plan.select("topic", "step").join(found.select("topic", "step"), ["topic", "step"], "left_anti").select("topic")
        syllabus = curriculum.syllabus_steps(plan, resolved, papers, budget)
        if strategy == "syllabus":
            steps = syllabus
        else:
            named = plan.where("stage = 'anchor'").select("topic", "step", "concept").join(found.select("topic", "step", "paper_id"), ["topic", "step"])
            number = F.row_number().over(Window.partitionBy("topic").orderBy("step"))
            anchors = named.join(papers.select("topic", "paper_id", "year"), ["topic", "paper_id"]).withColumn("position", number).where("position <= 2")
            one = anchors.where("position = 1")
            pick = lambda stage: None if answers is None else answers.where(F.col("stage") == stage)
            before = curriculum.answered(curriculum.most_cited(citations, papers, one, "cited_id", REFERENCES_SHOWN), pick("prerequisite"), "its references")
            after = curriculum.answered(curriculum.most_cited(citations, papers, one, "citing_id", CITERS_SHOWN), pick("followup"), "what cites it")
            steps = curriculum.anchor_steps(before, anchors, after, budget)
            if strategy == "hybrid":
                steps = curriculum.hybrid(syllabus, steps)
    path = curriculum.assemble(steps)
    return path.join(curriculum.confidence(steps, lost).withColumn("band", band(F.col("confidence"))), "topic")


#: Digits of numbers in JSON.
DIGITS = {"score": 6, "pagerank": 8, "z": 4, "confidence": 2}


def to_json(path: DataFrame) -> DataFrame:
    """(topic, json): a path as one document a topic, its numbers rounded."""
    path = path.withColumns({c: F.round(c, n) for c, n in DIGITS.items() if c in path.columns})
    rows = F.array_sort(F.collect_list(F.struct(*[c for c in ("position", *[x for x in path.columns if x not in ("topic", "position")])])))
    return path.groupBy("topic").agg(F.to_json(F.struct(rows.alias("steps"))).alias("json"))


def to_markdown(path: DataFrame, papers: DataFrame) -> DataFrame:
    """(topic, markdown): a heading and a numbered line for each step."""
    named = path.select("topic", "position", "paper_id", "year", "role").join(papers.select("topic", "paper_id", "title"), ["topic", "paper_id"])
    line = F.format_string("%d. %s (%s): %s", F.col("position") + 1, F.coalesce("title", F.lit("untitled")), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), "role")
    rows = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return named.groupBy("topic").agg(F.concat(F.lit("# "), F.first("topic"), F.lit("\n\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("markdown"))


def write_report(path: DataFrame, papers: DataFrame, folder: str, run: str, strategy: str, model: str) -> None:
    """Folders <folder>/<run>/<strategy>__<model>.json and .md: lines of JSON, one for each topic, and Markdown as plain text."""
    base = f"{folder}/{run}/{strategy}__{model}"
    to_json(path).select(F.col("json").alias("value")).write.mode("overwrite").text(f"{base}.json")
    to_markdown(path, papers).select("markdown").write.mode("overwrite").option("lineSep", "\n\n").text(f"{base}.md")


def health(settings: Settings = Settings()) -> dict:
    """What a service reports of itself: its sources with what they can do, and its strategies."""
    return {"status": "ok", "strategy": settings.strategy, "strategies": list(STRATEGIES), "sources": {name: sorted(can) for name, (_, can) in parsers.REGISTRY.items()}}
