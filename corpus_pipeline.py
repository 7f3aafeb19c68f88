"""From raw documents to packed sequences: each stage works on all that the one before has kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm import jaccard_join, packing, pii, quality_rules, suffix_dedup
from citeweave.llm.common import Scratch, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("jaccard_join", jaccard_join.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("pii", pii.stage),
    ("best_fit_packing", packing.stage),
]
#: Signatures, merged spans and packing can't be said in SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents: pieces of what the others have kept, with their ids and places.

    A stage's output goes as soon as the next one's is written. Defined cases: those of the stages; null texts fail the
    quality rules; an empty table gives no rows.
    """
    scratch, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
