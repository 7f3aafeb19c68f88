"""Paths by each strategy, over small tables of plans and answers."""

import pytest

from citeweave.plans import paths


@pytest.fixture(scope="module")
def tables(spark):
    names = ["Gradient paths in wide gardens", "Careful rivers of stone", "Lanterns for slow machines", "Harvest counting under rain", "Quiet bridges between orchards", "Slides: careful rivers of stone", "Later work on rivers"]
    papers = spark.createDataFrame([("t", i, n, 2000 + i, 100 - i) for i, n in enumerate(names)] + [("u", 20, names[0], 1999, 5)], "topic string, paper_id bigint, title string, year int, citation_count int")
    cites = spark.createDataFrame([("t", 1, 0), ("t", 6, 1), ("t", 4, 1), ("t", 1, 2), ("t", 4, 0), ("t", 6, 0), ("t", 6, 2), ("t", 4, 2)], "topic string, citing_id bigint, cited_id bigint")
    seeds = spark.createDataFrame([("t", 4, 1), ("t", 6, 2)], "topic string, paper_id bigint, seed_rank int")
    plan = [("t", 0, names[0], "prerequisite"), ("t", 1, names[1], "anchor"), ("t", 2, "Nothing like this anywhere", "followup"), ("t", 3, names[3], "followup"), ("t", 4, names[4], "followup"), ("t", 5, names[0], "followup"), ("u", 0, names[0], "anchor")]
    plan = spark.createDataFrame([(t, i, n, None, s, f"c{i}") for t, i, n, s in plan], "topic string, step int, title string, year int, stage string, concept string")
    return papers, cites, seeds, plan


def steps(df, topic="t"):
    return [(r["position"], r["paper_id"], r["stage"], r["prerequisite_id"]) for r in df.where(f"topic = '{topic}'").orderBy("position").collect()]


def test_syllabus(tables):
    got = paths.build_path("syllabus", *tables)
    assert steps(got) == [(0, 0, "prerequisite", None), (1, 1, "anchor", 0), (2, 3, "followup", 1), (3, 4, "followup", 3)]
    row = got.where("topic = 't'").first()
    assert abs(row["confidence"] - 0.7) < 1e-9 and len(row["reasons"]) == 2  # a lost title, few steps


def test_anchor(tables, spark):
    assert steps(paths.build_path("anchor", *tables)) == [(0, 0, "prerequisite", None), (1, 2, "prerequisite", 0), (2, 1, "anchor", 2), (3, 4, "followup", 1), (4, 6, "followup", 4)]
    answers = spark.createDataFrame([("t", 2, "1", "prerequisite", "x"), ("t", 99, "0", "prerequisite", "x"), ("t", 6, "10", "followup", None), ("t", 4, "9", "followup", None)], "topic string, paper_id bigint, position string, stage string, concept string")
    assert steps(paths.build_path("anchor", *tables, answers=answers)) == [(0, 2, "prerequisite", None), (1, 1, "anchor", 2), (2, 4, "followup", 1), (3, 6, "followup", 4)]


def test_rerank(tables, spark):
    answers = spark.createDataFrame([("t", 6, "2", "anchor", "x"), ("t", 0, "0", "prerequisite", "x"), ("t", 3, "1", "anchor", "not offered"), ("t", 4, "10", "odd", "x"), ("t", 0, "11", "anchor", "again")], "topic string, paper_id bigint, position string, stage string, concept string")
    assert steps(paths.build_path("rerank", *tables, answers=answers)) == [(0, 0, "prerequisite", None), (1, 6, "anchor", 0), (2, 4, "followup", 6)]


def test_hybrid(tables):
    got = paths.build_path("hybrid", *tables)
    assert steps(got) == steps(paths.build_path("syllabus", *tables))  # four steps and an anchor
    assert steps(got, "u") == [(0, 20, "anchor", None)]  # one step: the anchor path


def test_unknown(tables):
    with pytest.raises(ValueError, match="structural, syllabus, anchor, rerank, hybrid"):
        paths.build_path("best", *tables)
