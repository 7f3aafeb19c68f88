"""Positions of words made within a row."""

from pyspark.sql import functions as F

from citeweave.functions import text


def test_positions_without_a_shuffle(spark):
    rows = [(1, "b a b c a b".split()), (2, []), (3, None), (4, ["x"]), (5, ["w"] * 1000 + ["v"])]
    df = spark.createDataFrame(rows, "i int, words array<string>").select("i", text.positions(F.col("words")).alias("m"))
    got = {r["i"]: r["m"] for r in df.collect()}
    assert got == {1: {"b": [0, 2, 5], "a": [1, 4], "c": [3]}, 2: {}, 3: {}, 4: {"x": [0]}, 5: {"w": list(range(1000)), "v": [1000]}}


def test_abstracts_query_has_no_exchange(spark, sf_dir):
    from citeweave.plans.catalog import QUERIES

    assert "Exchange" not in QUERIES["q43_abstract_positions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
