"""Stores, saved payloads, the best of keys, folding, hot words, refinement and requests."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from citeweave.functions import text
from citeweave.operators import expansion, judgment, model_calls, resolver
from citeweave.operators.steps import Steps, ranked, top_of
from citeweave.sources import payloads, response_cache
from citeweave.sources.store import Store


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "key string, body string", 1)
    row = lambda *rows: spark.createDataFrame([*rows], "key string, body string")
    have = lambda: sorted(tuple(r) for r in store.read().collect())
    assert have() == []
    store.upsert(row())
    assert have() == []
    store.upsert(row(("aa", "1"), ("ab", "2"), ("b0", "3"), (None, "x"), ("aa", "0")))
    for _ in range(2):  # the same again adds nothing
        store.upsert(row(("ab", "new"), ("c1", None)))
    assert have() == [("aa", "0"), ("ab", "new"), ("b0", "3"), ("c1", None)]
    number, folders = store._newest()
    assert number == 3 and not store._publish(2, {}) and store._newest() == (number, folders)  # a list is written once
    store.clean()
    assert have() == [("aa", "0"), ("ab", "new"), ("b0", "3"), ("c1", None)] and len(list((tmp_path / "s" / "rows").glob("[0-9a-f]*"))) == 2


def test_answers_are_kept(spark, tmp_path):
    asked = spark.createDataFrame([(1, "judge", "1", "s", "a", "{}"), (2, "judge", "1", "s", "b", "{}")], "id int, role string, prompt_version string, system string, user string, schema string")
    chain = spark.createDataFrame([("judge", 0, "p", "m")], "role string, chain_pos int, provider string, model string")
    store = Store(spark, str(tmp_path / "s"), "key string, data string")
    fails = lambda *a: (_ for _ in ()).throw(RuntimeError("asked again"))
    first = model_calls.answer_and_keep(asked, chain, store, lambda p, m, r, s, u: json.dumps({"said": u}), Steps(spark, "one").save)
    assert {r["id"]: r["data"] for r in first.collect()} == {1: '{"said": "a"}', 2: '{"said": "b"}'} and store.read().count() == 2
    again = model_calls.answer_and_keep(asked, chain, store, fails, Steps(spark, "two").save)
    assert {r["id"] for r in again.collect()} == {1, 2} and store.read().count() == 2


def test_empty_responses_are_not_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), response_cache.STORED)
    response_cache.keep(store, spark.createDataFrame([("aa", "arxiv", "x", 0), ("ab", "openalex", "y", 0)], "key string, provider string, body string, results int"))
    assert [r["key"] for r in store.read().collect()] == ["ab"]


def test_payloads(spark, tmp_path):
    body = lambda *ids: json.dumps({"results": [{"id": f"https://openalex.org/w{i}", "title": f"T {i}"} for i in ids]})
    rows = [("openalex", "search", "a/b ü", None, 0, body(1, 2)), ("openalex", "search", "a/b ü", None, 1, body(3)), ("openalex", "search", None, None, 0, body(9)), ("openalex", "cites", "c", "W1", 0, body(4)), ("arxiv", "search", "c", None, 0, "<feed/>")]
    payloads.save(spark.createDataFrame(rows, "provider string, mode string, topic string, of string, page int, payload string"), str(tmp_path / "p"))
    every = payloads.payloads(spark, str(tmp_path / "p"))
    assert sorted(map(str, every.collect())) == sorted(str(r) for r in spark.createDataFrame(rows, every.schema).collect())
    found = payloads.records(spark, str(tmp_path / "p"), "openalex", topics=["a/b ü", "none"], page_size=2)
    assert [(r["rank"], r["title"]) for r in found.orderBy("rank").collect()] == [(1, "T 1"), (2, "T 2"), (3, "T 3")]
    assert found.rdd.getNumPartitions() == 1  # one folder of five was read
    assert payloads.records(spark, str(tmp_path / "p"), "openalex", limit=1, page_size=2).count() == 2
    assert [tuple(r)[:3] for r in payloads.links(payloads.records(spark, str(tmp_path / "p"), "openalex", "cites"), "cites").collect()] == [("c", "W4", "W1")]
    assert payloads.records(spark, str(tmp_path / "p"), "openalex", topics=["zzz"]).count() == 0
    for provider, mode in (("arxiv", "cites"), ("openalex", "rumour"), ("nowhere", "search")):
        with pytest.raises(ValueError):
            payloads.records(spark, str(tmp_path / "p"), provider, mode)


def test_pushed_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = payloads.PayloadReader("file:///x")
    rest = list(reader.pushFilters([EqualTo(("provider",), "arxiv"), In(("topic",), ("a", "b")), EqualTo(("topic",), "b"), GreaterThan(("page",), 1), EqualTo(("payload",), "p")]))
    assert reader.wanted == {"provider": {"arxiv"}, "topic": {"b"}} and len(rest) == 2


def test_top_of_and_ranked(spark):
    r = random.Random(1)
    rows = [(r.choice("aab"), r.randint(0, 9) or None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    key = lambda x: (x[1] is None, -(x[1] or 0), x[2])
    got = top_of(df, ["k"], [F.desc_nulls_last("v"), F.col("i")], 7, salts=5).collect()
    assert sorted((x["k"], x["i"], x["position"]) for x in got) == sorted((k, x[2], n + 1) for k in "ab" for n, x in enumerate(sorted([x for x in rows if x[0] == k], key=key)[:7]))
    got = ranked(df, "k", ["i"], "place", Steps(spark, "t")).collect()
    assert sorted((x["k"], x["i"], x["place"]) for x in got) == sorted((k, i, n) for k in "ab" for n, i in enumerate(sorted(x[2] for x in rows if x[0] == k)))


def test_limits_per_paper(spark):
    e = spark.createDataFrame([("t", "s", p) for p in "abcd"] * 2, "topic string, citing_id string, cited_id string")
    p = spark.createDataFrame([("t", "a", 1), ("t", "b", 5), ("t", "c", None)], "topic string, paper_id string, citation_count int")
    of = lambda **k: {r["cited_id"] for r in expansion.limited(e, "citing_id", **k).collect()}
    assert of(most=2, papers=p) == {"b", "a"} and of(most=3, papers=p) == {"b", "a", "c"} and of(most=2) == {"a", "b"} and of(most=None) == set("abcd")


@pytest.mark.parametrize("title", ["Schrödinger's Équation.", "Phương pháp học sâu", "Ｆｕｌｌ Ｗｉｄｔｈ ２", "eﬃcient ﬁelds Ⅷ ½", "𝓜𝓪𝓽𝓱 𝟙𝟚", "étude", "straße İstanbul", "日本語 x", "", "ǅ ŉ ㎏ ™"])
def test_folding(spark, title):
    plain = "".join(c for c in unicodedata.normalize("NFKD", title).lower() if c.isascii() and c.isalnum())
    assert spark.range(1).select(text.title_fingerprint(F.lit(title))).first()[0] == plain
    assert spark.createDataFrame([(title,), (None,)], "t string").select(text.title_fingerprint(F.col("t")).alias("f")).where(F.col("f").eqNullSafe(plain)).count() == 1


def test_hot_words(spark):
    """A word in all titles is split; what is found doesn't change."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    r = random.Random(3)
    have = spark.createDataFrame([("t", f"p{i}", "common " + " ".join(r.sample(words, 3)), 2000 + i % 5, r.choice([None, i % 7])) for i in range(90)], "topic string, paper_id string, title string, year int, citation_count int")
    plan = spark.createDataFrame([("t", i, "common " + " ".join(r.sample(words, r.randint(0, 3))), 2001) for i in range(20)] + [("t", 99, "quite other", 2000)], "topic string, step int, title string, year int")
    one, many = ({tuple(x) for x in resolver.resolve_titles(plan, have, hot).collect()} for hot in (10_000, 4))
    assert one == many and one
    told = {x["step"]: x["note"] for x in resolver.notes(plan, resolver.resolve_titles(plan, have), have).collect()}
    assert len(told) == 21 and told[99] == "nothing found for quite other" and any(n.startswith("found as") for n in told.values())


def test_refinement_and_requests(spark):
    rows = spark.createDataFrame([("t", f"p{i}", "old", f"T{i}", i) for i in range(8)], "topic string, paper_id string, role string, title string, rn int")
    labels = judgment.labelled(rows, "n", "rn", batch=6)
    answers = spark.createDataFrame([("t", "n1", "second"), ("t", "n1", "first"), ("t", "n2", None), ("t", "n99", "lost")], "topic string, label string, role string")
    got = {r["paper_id"]: r["role"] for r in judgment.refine(rows, answers, labels, ["role"]).collect()}
    assert got == {f"p{i}": "first" if i == 0 else "old" for i in range(8)}
    asked = judgment.requests(rows.select("topic", "paper_id", "title"), labels, F.col("title"), "explain", "Papers", "be brief", "{}").orderBy("id").collect()
    assert [r["id"] for r in asked] == ["explain/t/0", "explain/t/1"] and asked[1]["user"] == "Papers\n1. n7: T6\n2. n8: T7"
