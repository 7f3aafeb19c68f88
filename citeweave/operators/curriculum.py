"""Planned paths: steps from a plan, their assembly, confidence and chronology, and the planner strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.text import title_fingerprint


def syllabus_steps(plan: DataFrame, resolved: DataFrame, papers: DataFrame, budget: int = 24) -> DataFrame:
    """(topic, position, paper_id, year, stage, concept, approximate) of a plan (topic, step, title, stage, concept):
    resolved titles in the plan's order, each paper and each title once, `budget` at most."""
    hits = plan.select("topic", "step", "stage", "concept").join(resolved.where("accepted"), ["topic", "step"]).join(papers.select("topic", "paper_id", "title", "year"), ["topic", "paper_id"])
    hits = hits.withColumn("fp", title_fingerprint(F.col("title")))
    for key in ("paper_id", "fp"):
        hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("topic", key).orderBy("step"))).where("r = 1")
    number = F.row_number().over(Window.partitionBy("topic").orderBy("step"))
    return hits.withColumn("position", number - 1).where(F.col("position") < budget).select("topic", "position", "paper_id", "year", "stage", "concept", (~F.col("confident")).alias("approximate"))


def why_for_you() -> Column:
    """Over stage and concept."""
    return F.when(F.col("stage") == "prerequisite", F.concat(F.lit("Read first: "), "concept")).when(F.col("stage") == "anchor", F.concat(F.lit("The topic itself: "), "concept")).otherwise(F.concat(F.lit("Goes on from there: "), "concept"))


def assemble(steps: DataFrame) -> DataFrame:
    """Steps with level, prerequisite_id (the step before) and role by stage."""
    order = Window.partitionBy("topic").orderBy("position")
    role = F.when(F.col("stage") == "prerequisite", "foundation").when(F.col("stage") == "anchor", "breakthrough").otherwise("extension")
    return steps.withColumn("level", F.row_number().over(order) - 1).withColumn("prerequisite_id", F.lag("paper_id").over(order)).withColumn("role", role).withColumn("why_for_you", why_for_you())


def chronology(steps: DataFrame) -> DataFrame:
    """(topic, dated, inversions, backwards): dated steps, those over two years older than the dated one before, and
    whether these are a third of them."""
    dated = steps.where("year IS NOT NULL").withColumn("before", F.lag("year").over(Window.partitionBy("topic").orderBy("position")))
    out = dated.groupBy("topic").agg(F.count("*").alias("dated"), F.count_if(F.col("year") < F.col("before") - 2).alias("inversions"))
    return out.withColumn("backwards", (F.col("inversions") > 0) & (F.col("inversions") >= F.floor(F.col("dated") / 3)))


def confidence(steps: DataFrame, dropped: DataFrame) -> DataFrame:
    """(topic, confidence, reasons) of steps; dropped: (topic) where a planned title wasn't found."""
    agg = steps.groupBy("topic").agg(
        F.count_if(F.col("stage") == "anchor").alias("anchors"), F.count_if(F.col("stage") == "prerequisite").alias("prerequisites"),
        F.count_if("approximate").alias("near"), F.count("*").alias("n"),
    )
    agg = agg.join(chronology(steps).select("topic", "backwards"), "topic", "left").join(dropped.select("topic").distinct().withColumn("lost", F.lit(True)), "topic", "left")
    rules = [
        (F.col("anchors") == 0, F.lit(0.45), "no step is about the topic itself"), (F.col("prerequisites") == 0, F.lit(0.20), "nothing to read first"),
        (F.col("near") > 0, F.least(F.lit(0.30), 0.10 * F.col("near")), "some steps only come close to the plan"), (F.coalesce("lost", F.lit(False)), F.lit(0.15), "part of the plan wasn't found"),
        (F.col("n") < 5, F.lit(0.15), "few steps are left"), (F.coalesce("backwards", F.lit(False)), F.lit(0.10), "mostly goes back in time"),
    ]
    score = F.lit(1.0)
    for test, cost, _ in rules:
        score = score - F.when(test, cost).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(test, text) for test, _, text in rules]))
    return agg.select("topic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"), reasons.alias("reasons"))


def shortlist(ancestors: DataFrame, seeds: DataFrame, least: int = 2, first_seeds: int = 20, limit: int = 40) -> DataFrame:
    """(topic, paper_id, position): ancestors (topic, paper_id, n) by co-citations, then the first seeds (topic, paper_id,
    seed_rank), each paper once."""
    a = ancestors.where(F.col("n") >= least).select("topic", "paper_id", F.lit(0).alias("k"), (-F.col("n")).cast("long").alias("o"))
    b = seeds.where(F.col("seed_rank") <= first_seeds).select("topic", "paper_id", F.lit(1).alias("k"), F.col("seed_rank").cast("long").alias("o"))
    both = a.union(b).withColumn("r", F.row_number().over(Window.partitionBy("topic", "paper_id").orderBy("k", "o"))).where("r = 1")
    return both.withColumn("position", F.row_number().over(Window.partitionBy("topic").orderBy("k", "o", "paper_id"))).where(F.col("position") <= limit).select("topic", "paper_id", "position")


def anchor_steps(prerequisites: DataFrame, anchors: DataFrame, followups: DataFrame, budget: int = 24) -> DataFrame:
    """Steps of anchors (at most two), what to read before (up to half the budget) and after, each (topic, paper_id, year,
    concept, position)."""
    parts = [(prerequisites, "prerequisite", max(2, budget // 2)), (anchors, "anchor", 2), (followups, "followup", budget)]
    rows = None
    for i, (df, stage, most) in enumerate(parts):
        part = df.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("position", "paper_id"))).where(F.col("r") <= most)
        part = part.select("topic", "paper_id", "year", "concept", F.lit(stage).alias("stage"), F.lit(i).alias("k"), "r")
        rows = part if rows is None else rows.unionByName(part)
    once = rows.withColumn("d", F.row_number().over(Window.partitionBy("topic", "paper_id").orderBy("k", "r"))).where("d = 1")
    out = once.withColumn("position", F.row_number().over(Window.partitionBy("topic").orderBy("k", "r")) - 1).where(F.col("position") < budget)
    return out.select("topic", "position", "paper_id", "year", "stage", "concept", F.lit(False).alias("approximate"))


def hybrid(syllabus: DataFrame, anchor: DataFrame) -> DataFrame:
    """By topic: the syllabus if it has four steps and an anchor, else the anchor path, else the syllabus."""
    good = syllabus.groupBy("topic").agg(F.count("*").alias("n"), F.max((F.col("stage") == "anchor").cast("int")).alias("a")).where("n >= 4 AND a = 1").select("topic")
    other = anchor.join(good, "topic", "left_anti")
    return syllabus.join(good, "topic", "left_semi").unionByName(other).unionByName(syllabus.join(good, "topic", "left_anti").join(other.select("topic").distinct(), "topic", "left_anti"))


def most_cited(edges: DataFrame, papers: DataFrame, of: DataFrame, end: str, most: int) -> DataFrame:
    """(topic, paper_id, year, position): of the papers at the other `end` (cited_id or citing_id) of edges from those in
    `of` (topic, paper_id), the `most` that are cited most often, ties to smaller ids."""
    here = "citing_id" if end == "cited_id" else "cited_id"
    met = edges.join(of.select("topic", F.col("paper_id").alias(here)), ["topic", here]).select("topic", F.col(end).alias("paper_id")).distinct()
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("citation_count"), "paper_id"))
    return met.join(papers.select("topic", "paper_id", "year", "citation_count"), ["topic", "paper_id"]).withColumn("position", rank).where(F.col("position") <= most).select("topic", "paper_id", "year", "position")


def answered(offered: DataFrame, answers: DataFrame | None, concept: str) -> DataFrame:
    """Offered papers (topic, paper_id, year, position) as a model's answers (topic, paper_id, position, concept) order
    them: what wasn't offered goes, what wasn't answered too. Without answers all stay in their order."""
    if answers is None:
        return offered.withColumn("concept", F.lit(concept))
    once = answers.groupBy("topic", "paper_id").agg(F.min(F.struct(F.col("position").cast("int").alias("position"), F.col("concept").alias("concept"))).alias("a"))
    return offered.drop("position").join(once, ["topic", "paper_id"]).select("topic", "paper_id", "year", "a.position", F.coalesce("a.concept", F.lit(concept)).alias("concept"))


def rerank_steps(offered: DataFrame, answers: DataFrame, papers: DataFrame, budget: int = 24) -> DataFrame:
    """Steps of shortlisted papers (topic, paper_id, position) in the order of answers (topic, paper_id, position, stage,
    concept): what wasn't offered goes, each paper once, `budget` at most; an unknown stage is a followup."""
    once = answers.withColumn("p", F.col("position").cast("int")).withColumn("r", F.row_number().over(Window.partitionBy("topic", "paper_id").orderBy("p", "stage"))).where("r = 1")
    rows = offered.select("topic", "paper_id").join(once, ["topic", "paper_id"]).join(papers.select("topic", "paper_id", "year"), ["topic", "paper_id"])
    number = F.row_number().over(Window.partitionBy("topic").orderBy("p", "paper_id")) - 1
    stage = F.when(F.col("stage").isin("prerequisite", "anchor"), F.col("stage")).otherwise("followup")
    return rows.withColumn("position", number).where(F.col("position") < budget).select("topic", "position", "paper_id", "year", stage.alias("stage"), "concept", F.lit(False).alias("approximate"))
