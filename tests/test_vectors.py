"""The operators on small tables of hand-made papers."""

import json

import pytest
from pyspark.sql import functions as F

from citeweave.functions import ids, text, titles
from citeweave.operators import curriculum, expansion, fusion, graph, identity, judgment, model_calls, ordering, resolver, selection
from citeweave.sources import parsers, settings


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["2301.12345v3", "arXiv:2301.12345", "https://arxiv.org/abs/2301.12345v2", "https://arxiv.org/pdf/2301.12345.pdf"])
def test_arxiv_ids(spark, raw):
    assert value(spark, ids.normalize_arxiv_id(F.lit(raw))) == "2301.12345"


@pytest.mark.parametrize("raw", ["https://doi.org/10.1000/ABC", "doi:10.1000/abc", "  10.1000/Abc  "])
def test_dois(spark, raw):
    assert value(spark, ids.normalize_doi(F.lit(raw))) == "10.1000/abc"


def test_fingerprints(spark):
    f = text.title_fingerprint
    assert value(spark, f(F.lit("Schrödinger's Équation."))) == value(spark, f(F.lit("schrodinger's equation")))


def test_abstract_and_median(spark):
    index = F.from_json(F.lit('{"Diffusion":[0],"models":[1,4],"beat":[2],"other":[3]}'), "map<string,array<int>>")
    assert value(spark, text.abstract_from_positions(index)) == "Diffusion models beat other models"
    assert value(spark, text.abstract_from_positions(F.from_json(F.lit("{}"), "map<string,array<int>>"))) is None
    assert value(spark, text.upper_median(F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(9)))) == 3


def test_titles(spark):
    sim = lambda a, b: value(spark, titles.title_similarity(F.lit(a), F.lit(b)))
    assert sim("Generative Adversarial Networks", "Generative Adversarial Nets") == 1.0
    assert sim("Attention Is All You Need", "Attention is all you need: a subtitle") == 1.0
    assert sim("Generative Adversarial Nets", "Sparse Generative Adversarial Nets") <= 0.70
    assert sim("", "Anything") == 0.0
    assert value(spark, titles.main_title(F.lit("A: B"))) == "A" and value(spark, titles.main_title(F.lit("A"))) == "A"
    ok = lambda t, a: value(spark, titles.looks_like_a_paper(F.lit(t), F.array(*map(F.lit, a)) if a else F.array().cast("array<string>")))
    assert ok("Deep learning", ["X"]) and not ok("Deep learning (GDL Seminar)", ["X"]) and not ok("Deep learning", [])


ID = "array<struct<ns:string,value:string>>"


def records(spark, rows):
    return spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], f"topic string, row_id bigint, title string, year int, external_ids {ID}, citation_count int")


@pytest.mark.parametrize("rows, n", [
    ([("One long enough title", 2020, [("doi", "1")], 1), ("Another title altogether", 2020, [("doi", "1")], 2)], 1),
    ([("One long enough title", 2020, [("doi", "1")], 100), ("one long enough TITLE", 2021, [("arxiv", "2")], 8000)], 1),
    ([("One long enough title", 2018, [], 1), ("One long enough title", 2024, [], 2)], 2),
    ([("One long enough title", 2020, [("doi", "1")], 1), ("Other words of a title", 2020, [("doi", "1")], 1), ("Other words of a title", 2021, [], 1)], 1),
    ([("One long enough title", 2020, [], 1), ("One long enough title", None, [], 1)], 1),
    ([("One long enough title", 2000, [], 1), ("One long enough title", 2020, [], 1), ("One long enough title", None, [], 1)], 3),
    ([("Short", 2020, [], 1), ("Short", 2020, [], 1)], 2),
])
def test_resolution(spark, rows, n):
    df = records(spark, rows)
    merged = identity.merge_papers(df, identity.resolve_entities(df)).collect()
    assert len(merged) == n
    if n == 1:
        assert merged[0]["title"] == rows[0][0] and merged[0]["citation_count"] == max(r[3] for r in rows)


def test_fusion(spark):
    hits = spark.createDataFrame([("t", "a", "A", 1), ("t", "a", "S", 2), ("t", "b", "B", 1), ("t", "b", "S", 2), ("t", "a", "S", 3)], "topic string, provider string, paper_id string, rank int")
    rows = fusion.top_per_topic(fusion.reciprocal_rank_fusion(hits, 1), 2).orderBy("position").collect()
    assert rows[0]["paper_id"] == "S" and rows[0]["ranks"] == {"a": 2, "b": 2} and len(rows) == 2


def edges(spark, pairs):
    return spark.createDataFrame([("t", a, b) for a, b in pairs], "topic string, citing_id string, cited_id string")


def papers(spark, years):
    return spark.createDataFrame([("t", p, y) for p, y in years.items()], "topic string, paper_id string, year int")


def test_co_citation(spark):
    e = edges(spark, [("s1", "x"), ("s2", "x"), ("s1", "x"), ("x", "y")])
    s = spark.createDataFrame([("t", "s1", 1), ("t", "s2", 2)], "topic string, paper_id string, seed_rank int")
    assert [(r["paper_id"], r["n"]) for r in expansion.co_citations(e, s).collect()] == [("x", 2)]
    assert {r["paper_id"] for r in expansion.discovered(e, s).collect()} == {"x", "y"}
    assert expansion.clean_edges(edges(spark, [("a", "a"), ("a", "ghost"), ("a", "b")]), papers(spark, {"a": 1, "b": 2})).count() == 1


def test_pagerank(spark):
    rank = {r["paper_id"]: r["pagerank"] for r in graph.pagerank(papers(spark, dict.fromkeys("abcde")), edges(spark, [("a", "d"), ("b", "d"), ("c", "d")])).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and max(rank, key=rank.get) == "d" and rank["a"] == rank["e"]


def test_age_rescale(spark):
    rows = [("t", "old", 1990, 0.4), ("t", "b", 2022, 0.1), ("t", "c", 2022, 0.1), ("t", "d", 2023, 0.1), ("t", "e", 2023, 0.1), ("t", "u", None, 9.0)]
    z = {r["paper_id"]: r["z"] for r in graph.age_rescale(spark.createDataFrame(rows, "topic string, paper_id string, year int, score double")).collect()}
    assert z["old"] > 0 and z["b"] < 0 and z["u"] == 0


def test_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")]
    got = {r["paper_id"]: r["community"] for r in graph.communities(papers(spark, dict.fromkeys("abcdef")), edges(spark, pairs)).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"]
    assert len({r["community"] for r in graph.communities(papers(spark, dict.fromkeys("abc")), edges(spark, [])).collect()}) == 3


def test_order(spark):
    nodes = papers(spark, {"a": 2000, "b": 2001, "c": 2002, "d": 2003}).withColumn("rank", F.lit(0))
    got = {r["paper_id"]: r for r in ordering.order_paths(nodes, edges(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("d", "a")])).collect()}
    assert [got[p]["level"] for p in "abcd"] == [0, 1, 2, 3]
    nodes = papers(spark, {"x": 2019, "y": 2021}).withColumn("rank", F.lit(0))
    got = {r["paper_id"]: r for r in ordering.order_paths(nodes, edges(spark, [("x", "y"), ("y", "x")])).collect()}
    assert got["x"]["position"] == 0 and sum(len(r["broken"]) for r in got.values()) == 1


def test_selection(spark):
    rows = [("t", "anc", None, 8, 8, 1.0)] + [("t", f"s{i}", i, 0, 0, 0.0) for i in range(1, 9)] + [("t", "weak", None, 0, 1, 5.0), ("t", "deep", None, 0, 3, 0.5)]
    df = spark.createDataFrame(rows, "topic string, paper_id string, seed_rank int, co_citations int, in_degree int, z double")
    got = {r["paper_id"]: r["reason"] for r in selection.select_papers(df, 6, 2).collect()}
    assert got == {"anc": "foundation", "s1": "surface", "s2": "surface", "deep": "evidence"}
    chosen = spark.createDataFrame([("t", "a", 2000, 9, 0.0), ("t", "b", 2010, 1, 0.0), ("t", "c", 2020, 0, 0.0)], "topic string, paper_id string, year int, co_citations int, z double")
    pairs = selection.candidate_pairs(chosen, edges(spark, [("b", "a"), ("c", "b"), ("a", "c")]), 2).orderBy("position").collect()
    assert [(p["prerequisite_id"], p["dependent_id"]) for p in pairs] == [("a", "b"), ("b", "c")]


def test_judgment(spark):
    pairs = spark.createDataFrame([("t", "p", "x", 4), ("t", "q", "x", 1)], "topic string, prerequisite_id string, dependent_id string, co_citations int")
    got = judgment.structural_edges(pairs).collect()
    assert [(r["prerequisite_id"], r["source"], r["confidence"]) for r in got] == [("p", "co_citation", None)]


def test_resolver(spark):
    plan = spark.createDataFrame([("t", 1, "Generative Adversarial Networks", 2014), ("t", 2, "A quite unknown work on nothing", 2014)], "topic string, step int, title string, year int")
    have = spark.createDataFrame([("t", "gan", "Generative Adversarial Nets", 2014, 9), ("t", "cgan", "Sparse Generative Adversarial Nets", 2014, 99)], "topic string, paper_id string, title string, year int, citation_count int")
    got = [(r["step"], r["paper_id"]) for r in resolver.resolve_titles(plan, have).where("accepted").collect()]
    assert got == [(1, "gan")]


def test_plan(spark):
    schema = "topic string, position int, paper_id string, year int, stage string, concept string, approximate boolean"
    steps = spark.createDataFrame([("t", i, f"p{i}", 2010 + i, s, "c", False) for i, s in enumerate(["prerequisite", "prerequisite", "anchor", "followup", "followup"])], schema)
    none = spark.createDataFrame([], "topic string")
    assert curriculum.confidence(steps, none).first()["confidence"] >= 0.8
    assert curriculum.confidence(steps.where("stage = 'followup'"), none).first()["confidence"] < 0.6
    got = curriculum.assemble(steps).orderBy("position").collect()
    assert [r["level"] for r in got] == [0, 1, 2, 3, 4] and got[1]["prerequisite_id"] == "p0"
    back = steps.withColumn("year", (2022 - 10 * F.col("position")).cast("int"))
    assert curriculum.chronology(back).first()["backwards"] and not curriculum.chronology(steps).first()["backwards"]


def test_model_calls(spark):
    assert model_calls.extract_json('so:\n```json\n{"a": 1}\n```') == {"a": 1} and model_calls.extract_json('x {"a": 2} y') == {"a": 2} and model_calls.extract_json("[1]") is None
    schema = {"type": "object", "required": ["papers"], "properties": {"papers": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["role"], "properties": {"role": {"enum": ["x"]}, "n": {"type": "number", "maximum": 1}}}}}}
    assert model_calls.validate({"papers": [{"role": "x"}]}, schema) is None
    assert "$.papers[0].role" in model_calls.validate({"papers": [{"role": "y"}]}, schema)
    assert model_calls.validate({}, schema) and model_calls.validate({"papers": []}, schema) and model_calls.validate({"papers": [{"role": "x", "n": True}]}, schema)
    asked = spark.createDataFrame([(1, "r", "s", "u", json.dumps({"type": "object", "required": ["ok"]}))], "id int, role string, system string, user string, schema string")
    got = model_calls.ask(asked, lambda role, system, user: '{"ok": 1}' if "refused" in user else "{}").first()
    assert json.loads(got["data"]) == {"ok": 1} and got["error"] is None


def test_parsers(spark):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2301.00001v2</id><title>A  title</title><summary>S</summary><published>2023-01-01T00:00:00Z</published><author><name>X</name></author><author><name>Y</name></author></entry></feed>'
    r = parsers.parse_arxiv(spark.createDataFrame([(feed,)], "payload string")).first()
    assert (r["title"], r["year"], r["authors"], r["rank"]) == ("A title", 2023, ["X", "Y"], 1) and r["external_ids"][0]["value"] == "2301.00001"
    items = {"message": {"items": [{"DOI": "10.1/A", "type": "dataset", "title": ["no"]}, {"DOI": "10.1/B", "type": "journal-article", "title": ["Yes"], "abstract": "<jats:p>Hi</jats:p>", "issued": {"date-parts": [[2020]]}}]}}
    r = parsers.parse_crossref(spark.createDataFrame([(json.dumps(items),)], "payload string")).first()
    assert (r["title"], r["rank"], r["abstract"], r["year"]) == ("Yes", 1, "Hi", 2020)
    work = {"results": [{"id": "https://openalex.org/W1", "title": "T", "publication_year": 2001, "abstract_inverted_index": {"b": [1], "a": [0]}}]}
    r = parsers.parse_openalex(spark.createDataFrame([(json.dumps(work),)], "payload string")).first()
    assert (r["abstract"], r["external_ids"][0]["value"]) == ("a b", "W1")
    data = {"data": [{"paperId": "p", "title": "T", "externalIds": {"DOI": "10.1/X"}}]}
    assert parsers.parse_semantic_scholar(spark.createDataFrame([(json.dumps(data),)], "payload string")).first()["external_ids"][1]["value"] == "10.1/x"
    with pytest.raises(ValueError):
        parsers.sources(["nobody"], "search")
    assert set(parsers.sources(["arxiv", "openalex"], "citations")) == {"openalex"}


def test_settings():
    assert settings.load("rrf_k = 10\n[expansion]\nmax_ancestors = 5").expansion.max_ancestors == 5
    for bad in ("nothing = 1", "[graph]\ndumping = 1", '[expansion]\nforward_enabled = "false"'):
        with pytest.raises(ValueError):
            settings.load(bad)
