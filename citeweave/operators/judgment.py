"""Roles, prerequisite edges, explanations and subtopics from structure alone, and what models' answers change in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.text import upper_median
from citeweave.functions.titles import CRITIQUE, SURVEY
from citeweave.operators.model_calls import prompt

LEAST_CONFIDENCE = 0.6


def with_median_year(papers: DataFrame) -> DataFrame:
    median = papers.where("year IS NOT NULL").groupBy("topic").agg(upper_median(F.collect_list("year")).alias("median_year"))
    return papers.join(median, "topic", "left")


def structural_role() -> Column:
    """Over title, year, median_year, co_citations, z and out_degree."""
    old = F.coalesce(F.col("year") < F.col("median_year"), F.lit(False))
    return (
        F.when(F.col("title").rlike(SURVEY), "survey").when(F.col("title").rlike(CRITIQUE), "critique").when((F.col("co_citations") >= 3) & old, "foundation")
        .when(F.col("z") >= 1.0, "breakthrough").when((F.col("out_degree") > 0) & ~old, "extension").otherwise("unclassified")
    )


def structural_edges(pairs: DataFrame) -> DataFrame:
    """Candidate pairs whose cited paper has at least the upper median of co-citations, and 2, as prerequisites."""
    median = pairs.groupBy("topic").agg(F.greatest(F.lit(2), upper_median(F.collect_list("co_citations"))).alias("least"))
    kept = pairs.join(median, "topic").where("co_citations >= least")
    return kept.select("topic", "prerequisite_id", "dependent_id", F.lit("co_citation").alias("source"), F.lit("citation-graph").alias("asserted_by"), F.lit(None).cast("double").alias("confidence"))


def structural_facts() -> Column:
    return F.format_string("%d of the topic's papers cite it; %d citations inside the topic; %+.2f against its age", F.col("co_citations"), F.col("in_degree"), F.round("z", 2))


def structural_explanation() -> Column:
    """Struct of four texts over co_citations, z, in_degree, out_degree, role and discovered."""
    why = (
        F.when(F.col("co_citations") >= 2, F.format_string("Shared background: %d papers found for the topic cite it.", F.col("co_citations")))
        .when(F.col("z") >= 1.0, F.format_string("Stands out among papers of its age (%+.2f).", F.col("z")))
        .when(F.col("discovered"), F.lit("Reached through the references of other papers."))
        .otherwise(F.lit("Found by the search for the topic."))
    )
    why = F.when(F.col("discovered"), F.concat(why, F.lit(" No search had found it."))).otherwise(why)
    assumes = F.when(F.col("out_degree") > 0, F.format_string("Builds on %d papers of this topic.", F.col("out_degree"))).otherwise(F.lit("Cites no other paper of this topic."))
    teaches = F.concat(F.lit("By its place in the graph: "), F.col("role"), F.lit("."))
    return F.struct(why.alias("why_it_matters"), assumes.alias("what_it_assumes"), teaches.alias("what_it_teaches"), structural_facts().alias("why_for_you"))


def structural_subtopics(nodes: DataFrame) -> DataFrame:
    """(topic, community, members, position) of communities of several of these papers, where a topic has two at least."""
    groups = nodes.groupBy("topic", "community").agg(F.array_sort(F.collect_list("paper_id")).alias("members")).where(F.size("members") > 1)
    order = Window.partitionBy("topic")
    return groups.withColumn("position", F.row_number().over(order.orderBy("community"))).withColumn("n", F.count("*").over(order)).where("n > 1").drop("n")


def judged_edges(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges of answers (topic, label, is_prerequisite, confidence, reason) about pairs that were asked for (labels: topic,
    label, prerequisite_id, dependent_id); answers to labels that nobody gave out fall away."""
    kept = answers.where(F.col("is_prerequisite") & (F.col("confidence") >= LEAST_CONFIDENCE)).join(labels, ["topic", "label"])
    return kept.select("topic", "prerequisite_id", "dependent_id", F.lit("llm_judgment").alias("source"), F.lit("model").alias("asserted_by"), "confidence")


def replace_edges(structural: DataFrame, judged: DataFrame, answered: DataFrame) -> DataFrame:
    """Judged edges for topics of which a batch was answered (topic), even if none is left; structural ones for others."""
    topics = answered.select("topic").distinct()
    return structural.join(topics, "topic", "left_anti").unionByName(judged.join(topics, "topic", "left_semi"))


def named_subtopics(groups: DataFrame, names: DataFrame | None, most: int = 6) -> DataFrame:
    """(topic, community, name, shown, position) of structural_subtopics(): `most` members are shown to a model, and its
    answers (topic, community, name) name them; groups without an answer go by their number."""
    own = F.concat(F.lit("Group "), F.col("position"))
    shown = F.array_sort(F.slice("members", 1, most)).alias("shown")
    if names is None:
        return groups.select("topic", "community", own.alias("name"), shown, "position")
    once = names.groupBy("topic", "community").agg(F.min("name").alias("name"))
    return groups.join(once, ["topic", "community"], "left").select("topic", "community", F.coalesce("name", own).alias("name"), shown, "position")


def assess(structural: DataFrame, edges: DataFrame, groups: DataFrame, explained: tuple | None = None, judged: tuple | None = None, names: DataFrame | None = None, columns: tuple = ("role",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structural rows, edges and subtopics, each with what its model call has answered: explained (answers, labels), judged
    (answers, labels), names. A call that failed is None and leaves its table as it is, whatever the others did."""
    rows = structural if explained is None else refine(structural, *explained, list(columns))
    kept = edges if judged is None else replace_edges(edges, judged_edges(*judged), judged[0])
    return rows, kept, named_subtopics(groups, names)


def labelled(rows: DataFrame, prefix: str, *order: str, batch: int = 6) -> DataFrame:
    """Adds label (prefix and number from 1) and the batch that a row is asked in, by topic."""
    number = F.row_number().over(Window.partitionBy("topic").orderBy(*order))
    return rows.withColumn("label", F.concat(F.lit(prefix), number)).withColumn("batch", F.floor((number - 1) / batch).cast("int"))


def refine(structural: DataFrame, answers: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of structural rows (topic, paper_id, ...) replaced by those of answers to labels, where there are any. Of several
    answers for one paper, that of the smallest label and then the smallest values counts, whole; a null in it leaves the
    structural value."""
    known = answers.join(labels.select("topic", "label", "paper_id"), ["topic", "label"])
    picked = F.min_by(F.struct(*[F.col(c) for c in columns]), F.struct(F.length("label"), "label", *[F.col(c) for c in columns]))
    new = known.groupBy("topic", "paper_id").agg(picked.alias("_new"))
    joined = structural.join(new, ["topic", "paper_id"], "left")
    return joined.select(*[F.coalesce(F.col("_new")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in structural.columns])


def requests(rows: DataFrame, labels: DataFrame, shown: Column, role: str, title: str, system: str, schema: str, version: str = "1") -> DataFrame:
    """(id, role, prompt_version, system, user, schema), one row for each topic and batch of labels, as model_calls.answer() takes
    them: the batch's rows (topic, paper_id, and what `shown` needs), each behind its label, in the order of labels."""
    known = labels.select("topic", "paper_id", "label", "batch").join(rows, ["topic", "paper_id"])
    line = F.struct(F.length("label").alias("n"), F.col("label").alias("label"), F.concat("label", F.lit(": "), F.coalesce(shown, F.lit(""))).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    batches = known.groupBy("topic", "batch").agg(lines.alias("lines"))
    told = [F.lit(x).alias(n) for n, x in (("role", role), ("prompt_version", version), ("system", system))]
    return batches.select(F.concat_ws("/", F.lit(role), "topic", F.col("batch")).alias("id"), *told, prompt(title, F.col("lines")).alias("user"), F.lit(schema).alias("schema"))
