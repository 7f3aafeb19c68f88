"""Chains of models, patient requests, reports and what is shown of paths."""

import json

from citeweave.operators import identity, judgment, model_calls, summaries
from citeweave.plans import paths
from citeweave.sources import fetch
from citeweave.sources.response_cache import probe, request_key, worth_keeping


def test_chain(spark):
    requests = spark.createDataFrame([(i, "judge", "1", "s", f"u{i}", "{}") for i in range(4)], "id int, role string, prompt_version string, system string, user string, schema string")
    chain = spark.createDataFrame([("judge", 0, "p", "first"), ("judge", 1, "p", "second")], "role string, chain_pos int, provider string, model string")
    cache = requests.where("id = 0").join(chain.where("chain_pos = 1"), "role").select(model_calls.cache_key().alias("key")).selectExpr("key", "'{\"kept\": 1}' AS data")

    def client(provider, model, role, system, user):
        return "no" if user == "u3" or (model == "first" and user == "u2") else json.dumps({"by": model})

    save = identity.saver(spark, "chain")
    answers, written = model_calls.answer(requests, chain, cache, client, save, repairs=0)
    got = {r["id"]: (json.loads(r["data"]), r["model"], r["fell_back"]) for r in answers.collect()}
    assert got == {0: ({"kept": 1}, "second", True), 1: ({"by": "first"}, "first", False), 2: ({"by": "second"}, "second", True)}
    hits, left = model_calls.probe(requests, chain, cache.union(written))
    assert hits.count() == 3 and [r["id"] for r in left.collect()] == [3]


def test_patience():
    def asked(codes, policy, wait=None):
        left, slept = list(codes), []
        return fetch.patiently(lambda u: (left.pop(0), wait, "body"), "u", policy, slept.append), slept

    arxiv, openalex, crossref = (fetch.POLICIES[k] for k in ("arxiv", "openalex", "crossref"))
    assert asked([503, 429, 200], arxiv) == (("body", None), [5.0, 10.0])
    assert asked([429] * 5, openalex) == ((None, "status 429"), [2.0, 4.0, 8.0, 16.0])
    assert asked([429, 200], openalex, 40.0) == (("body", None), [40.0])
    assert asked([429, 200], openalex, 61.0) == ((None, "status 429"), [])
    assert asked([500, 200], crossref) == ((None, "status 500"), []) and asked([404], arxiv) == ((None, "status 404"), [])


def test_fetch_and_cache(spark):
    misses = spark.createDataFrame([("a", "k1", "u1"), ("b", "k2", "bad"), ("a", "k3", "u3")], "provider string, key string, url string")
    rows = fetch.fetch(misses, lambda u: (500 if u == "bad" else 200, None, u), {"a": fetch.Policy(0.01)}).collect()
    assert {r["key"]: (r["body"], r["error"]) for r in rows} == {"k1": ("u1", None), "k2": (None, "status 500"), "k3": ("u3", None)}
    hits, left = probe(misses, spark.createDataFrame([("k1", "x")], "key string, body string"))
    assert [r["body"] for r in hits.collect()] == ["x"] and sorted(r["key"] for r in left.collect()) == ["k2", "k3"]
    kept = worth_keeping(spark.createDataFrame([("arxiv", "1", "", 0), ("openalex", "2", "", 0), ("arxiv", "3", "", 1)], "provider string, key string, body string, results int"))
    assert sorted(r["key"] for r in kept.collect()) == ["2", "3"]
    keys = spark.sql("SELECT explode(array(map('a', null), map('b', '1&c=2'), map('b', '1', 'c', '2'), map('c', '2', 'b', '1'), map())) AS m")
    got = [r[0] for r in keys.select(request_key(keys.m["x"], keys.m["x"], keys.m)).collect()]
    assert len(set(got)) == 4 and got[2] == got[3]


def test_assess(spark):
    rows = spark.createDataFrame([("t", 1, "x"), ("t", 2, "x")], "topic string, paper_id int, role string")
    edges = spark.createDataFrame([("t", 1, 2, "co_citation", "g", None)], "topic string, prerequisite_id int, dependent_id int, source string, asserted_by string, confidence double")
    groups = spark.createDataFrame([("t", 0, [1, 2], 1), ("t", 1, [3, 4], 2)], "topic string, community int, members array<int>, position int")
    r, e, g = judgment.assess(rows, edges, groups)
    assert r.collect() == rows.collect() and e.collect() == edges.collect() and [x["name"] for x in g.collect()] == ["Group 1", "Group 2"]
    labels = spark.createDataFrame([("t", "r1", 2, 1)], "topic string, label string, prerequisite_id int, dependent_id int")
    answers = spark.createDataFrame([("t", "r1", True, 0.9), ("t", "r9", True, 0.9)], "topic string, label string, is_prerequisite boolean, confidence double")
    _, e, _ = judgment.assess(rows, edges, groups, judged=(answers, labels))
    assert [(x["prerequisite_id"], x["dependent_id"], x["source"]) for x in e.collect()] == [(2, 1, "llm_judgment")]
    shares = summaries.judged(edges.union(e)).first()
    assert not shares["judged"] and summaries.judged(e).first()["judged"]


def test_reports(spark, tmp_path):
    path = spark.createDataFrame([("t", 1, 8, 2001, "extension", [7, 9], 0.123456), ("t", 0, 7, None, "foundation", [], 0.123456)], "topic string, position int, paper_id int, year int, role string, prerequisites array<int>, confidence double")
    papers = spark.createDataFrame([("t", 7, "Seven"), ("t", 8, None)], "topic string, paper_id int, title string")
    assert [(r["paper_id"], r["others"]) for r in summaries.other_prerequisites(path).orderBy("position").collect()] == [(7, []), (8, [9])]
    paths.write_report(path, papers, str(tmp_path), "run", "structural", "none")
    steps = json.loads(spark.read.text(f"{tmp_path}/run/structural__none.json").first()["value"])["steps"]
    assert [s["paper_id"] for s in steps] == [7, 8] and steps[0]["confidence"] == 0.12
    assert spark.read.text(f"{tmp_path}/run/structural__none.md", wholetext=True).first()["value"].strip() == "# t\n\n1. Seven (n.d.): foundation\n2. untitled (2001): extension"
    assert paths.health()["status"] == "ok" and "search" in paths.health()["sources"]["arxiv"]
