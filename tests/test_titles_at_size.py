"""Title resolution in blocks against a plain version, and what a block sends on."""

import random

import pyarrow as pa

from citeweave.functions import titles as T
from citeweave.operators import resolver


def plain(plan, papers):
    same = lambda ws: [T.EQUIVALENT.get(w, w) for w in ws]
    words = lambda t: same([w for w in t.lower().replace(":", " ").split() if w not in T.STOPWORDS])
    out = {}
    for step, title, year in plan:
        a, rows = set(words(title)), []
        count = {w: sum(w in words(t) for _, t, _, _ in papers) for w in a}
        missing = len(a) - -(-8 * len(a) // 10)
        sought = sorted(a, key=lambda w: (count[w], w))[: missing + 1]
        for p, t, y, cited in papers:
            o, b = words(t), set(words(t))
            if not b & set(sought):
                continue
            sim, at = 2.0 * len(a & b) / (len(a) + len(b)), next((i for i, w in enumerate(o) if w in a), 0)
            capped = 1 <= at <= T.VARIANT_WORDS
            sim = 1.0 if ":" not in title and set(words(t.split(":")[0])) == a else min(sim, T.VARIANT_CAP) if capped else sim
            score = min(1.0, sim + (T.YEAR_BONUS if year is not None and y is not None and abs(year - y) <= 1 else 0.0))
            cover = len(a & b) / len(a)
            rows.append((-score, -(-1 if cited is None else cited), p, cover, score >= T.ACCEPT and cover >= T.COVER and not (sim < 1 and capped)))
        if rows:
            s, _, p, cover, ok = min(rows)
            out[step] = (p, -s, cover, ok)
    return out


def test_blocks_give_the_best_of_all(spark):
    r = random.Random(4)
    vocabulary = ["graph", "deep", "models", "nets", "the", "of", "slow", "tree", "flow", "edge", "ranking"]
    title = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(2, 7))).replace(" edge ", ": edge ")
    papers = [(i, title(), r.choice([None, 2000, 2001, 2005]), r.choice([None, 0, 5])) for i in range(60)]
    plan = [(i, r.choice([title(), papers[i][1]]), r.choice([None, 2001, 2006])) for i in range(40)]
    plan = [p for p in plan if set(p[1].replace(":", "").split()) - set(T.STOPWORDS)]
    papers = [p for p in papers if set(p[1].replace(":", "").split()) - set(T.STOPWORDS)]
    have = spark.createDataFrame([("t", *p) for p in papers], "topic string, paper_id long, title string, year int, citation_count long")
    wanted = spark.createDataFrame([("t", *p) for p in plan], "topic string, step int, title string, year int")
    got = {x["step"]: (x["paper_id"], x["score"], x["coverage"], x["accepted"]) for x in resolver.resolve_titles(wanted, have, 7).collect()}
    assert got == plain(plan, papers)


def test_a_block_sends_one_row_a_title():
    n = 700
    text = pa.list_(pa.string())
    asked = pa.table({"topic": ["t"] * n, "step": range(n), "wanted_year": pa.array([None] * n, pa.int32()), "plain": [True] * n, "wanted": pa.array([["a", "b"]] * n, text), "sought": pa.array([["a"]] * n, text), "whole": ["a b"] * n})
    held = pa.table({"topic": ["t"] * n, "paper_id": range(n), "year": pa.array([None] * n, pa.int32()), "citations": [i // 3 for i in range(n)], "tokens": pa.array([["a", "b", "c"]] * n, text), "main": ["a b c"] * n, "opening": pa.array([["a"]] * n, text)})
    got = resolver._best(asked, held)
    assert got.num_rows == n and set(got["paper_id"].to_pylist()) == {699} and set(got["score"].to_pylist()) == {0.8}
