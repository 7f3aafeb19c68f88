"""Cycles of topics that one task walks: long chains of small cycles, which waves would go along one by one."""

from citeweave.operators import ordering
from citeweave.operators.steps import Steps


def chain(spark, n):
    links = [("t", i, i + 1) for i in range(n - 1)] + [("t", i + 2, i) for i in range(0, n - 2, 10)] + [("u", 1, 2)]
    return spark.createDataFrame(links, "topic string, a long, b long")


def test_a_long_chain_needs_no_waves(spark, monkeypatch):
    links = chain(spark, 3000)
    saved, plain = [], Steps.save
    monkeypatch.setattr(Steps, "save", lambda self, df, name: saved.append(name) or plain(self, df, name))
    got = {(r["paper_id"], r["component"]) for r in ordering.strong_components(links, Steps(spark, "walks")).collect()}
    assert got == {(i + k, i) for i in range(0, 2998, 10) for k in range(3)}
    nodes = spark.createDataFrame([("t", i, 2000) for i in range(3000)] + [("u", 1, None), ("u", 2, 1999)], "topic string, paper_id long, year int")
    levels, dropped = ordering.settle_order(nodes, links)
    assert {(r["a"], r["b"]) for r in dropped.collect()} == {(i + 2, i) for i in range(0, 2998, 10)}
    assert {r["paper_id"]: r["level"] for r in levels.where("topic = 't'").collect()} == {i: i for i in range(3000)}
    assert len(saved) < 12  # before: some for each wave


def test_walked_and_coloured_components_are_equal(spark):
    links = chain(spark, 7)
    one, many = ({tuple(r) for r in ordering.strong_components(links, Steps(spark, "walks"), block=b).collect()} for b in (100, 2))
    assert one == many and one
