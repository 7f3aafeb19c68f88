"""Papers, citations and hits derived from the test tables, in DataFrames and in SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a paper of its source's topic, its first line the title; some have no year."""
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    year = F.when(F.col("doc_id") % 7 != 3, (1990 + F.col("doc_id") % 35).cast("int"))
    # Titles are cut out below the window, so that texts aren't shuffled.
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.substring_index("text", "\n", 1).alias("title"), "n_chars")
    return rows.select(F.col("source").alias("topic"), F.col("doc_id").alias("paper_id"), rn.alias("rn"), year.alias("year"), "title", F.col("n_chars").alias("citation_count"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = papers(spark, sf_dir).select("topic", F.col("paper_id").alias("citing_id"), F.col("rn").alias("r"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("k"))
    b = papers(spark, sf_dir).select("topic", F.col("paper_id").alias("cited_id"), F.col("rn").alias("to"))
    return a.withColumn("to", F.col("r") - 1 - (F.col("r") * F.col("k") * 7) % 11).join(b, ["topic", "to"]).select("topic", "citing_id", "cited_id").distinct()


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).where("rn >= 5").select("topic", "paper_id", (F.col("rn") - 4).alias("seed_rank"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type ranks users by the value of their events."""
    sums = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.sum(F.col("value").cast("decimal(28,6)")), 6).alias("v"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("v"), "user_id"))
    return sums.select(F.lit("all").alias("topic"), F.col("event_type").alias("provider"), F.col("user_id").alias("paper_id"), rank.alias("rank"))


PAPERS = """x_papers AS (SELECT source AS topic, doc_id AS paper_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn,
  CAST(CASE WHEN doc_id % 7 <> 3 THEN 1990 + doc_id % 35 END AS INTEGER) AS year, split_part(text, chr(10), 1) AS title, n_chars AS citation_count FROM documents)"""
CITES = PAPERS + """, x_cites AS (SELECT DISTINCT a.topic, a.paper_id AS citing_id, b.paper_id AS cited_id FROM x_papers a, (VALUES (1), (2), (3), (4)) t(k), x_papers b
  WHERE b.topic = a.topic AND b.rn = a.rn - 1 - (a.rn * t.k * 7) % 11)"""
SEEDS = CITES + ", x_seeds AS (SELECT topic, paper_id, rn - 4 AS seed_rank FROM x_papers WHERE rn >= 5)"
COUNTS = SEEDS + """, x_counts AS (SELECT c.topic, c.cited_id AS paper_id, count(DISTINCT c.citing_id) AS n FROM x_cites c JOIN x_seeds s ON s.topic = c.topic AND s.paper_id = c.citing_id GROUP BY ALL),
 x_in AS (SELECT topic, cited_id AS paper_id, count(*) AS in_degree FROM x_cites GROUP BY ALL), x_out AS (SELECT topic, citing_id AS paper_id, count(*) AS out_degree FROM x_cites GROUP BY ALL),
 x_facts AS (SELECT p.*, coalesce(n, 0) AS co_citations, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, seed_rank FROM x_papers p LEFT JOIN x_counts USING (topic, paper_id)
   LEFT JOIN x_in USING (topic, paper_id) LEFT JOIN x_out USING (topic, paper_id) LEFT JOIN x_seeds USING (topic, paper_id))"""
HITS = """x_hits AS (SELECT 'all' AS topic, event_type AS provider, user_id AS paper_id, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, user_id) AS rank
  FROM (SELECT event_type, user_id, round(sum(CAST(value AS DECIMAL(28, 6))), 6) AS v FROM events GROUP BY ALL))"""
