"""Graph operators across tasks against plain versions, with blocks of a few papers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from citeweave.operators import graph, ordering
from citeweave.sources import stand_ins as x
from tests import brute_order


def some_graph(seed, topics=2, size=12, back=0.15):
    r = random.Random(seed)
    nodes, edges = {}, {}
    for t in [f"t{i}" for i in range(topics)]:
        ids = list(range(size))
        nodes[t] = {p: r.choice([None, 2000 + p // 3, 2000 + r.randint(0, 6)]) for p in ids}
        edges[t] = {(a, b) for a in ids for b in ids if a != b and r.random() < (0.18 if a < b else back * 0.3)}
    return nodes, edges


def frames(spark, nodes, edges):
    n = spark.createDataFrame([(t, p, y, 0) for t, of in nodes.items() for p, y in of.items()], "topic string, paper_id long, year int, rank int")
    e = spark.createDataFrame([(t, b, a) for t, of in edges.items() for a, b in of], "topic string, citing_id long, cited_id long")
    return n, e


def check_order(got, nodes, edges, claims):
    for t, of in nodes.items():
        kept, dropped = brute_order.break_cycles(list(of), edges[t], of)
        level = brute_order.levels(list(of), kept)
        reduced = brute_order.reduce_transitively(kept & claims[t])
        rows = {p: r for (topic, p), r in got.items() if topic == t}
        assert {p: r["level"] for p, r in rows.items()} == level
        assert {(p, b) for p, r in rows.items() for b in r["broken"]} == dropped
        assert {(a, p) for p, r in rows.items() for a in r["prerequisites"]} == reduced
        order = sorted(of, key=lambda p: (level[p], rows[p].asDict().get("rank", 0), p))
        assert [rows[p]["position"] for p in order] == list(range(len(of)))
        assert all(r["prerequisites"] == sorted(r["prerequisites"], key=lambda a: (level[a], a)) for r in rows.values())


@pytest.mark.parametrize("seed,block,back", [(2, 50_000, 0.5), (3, 3, 0.0), (5, 2, 1.2)])
def test_order_of_random_graphs(spark, seed, block, back):
    """Levels, cycles, reduction and positions, with topics in one block and in several."""
    nodes, edges = some_graph(seed, back=back)
    claims = {t: {e for e in of if hash(e) % 3} for t, of in edges.items()}
    n, e = frames(spark, nodes, edges)
    claimed = spark.createDataFrame([(t, a, b) for t, of in claims.items() for a, b in of] + [("t0", 5, 5), ("t0", 5, 999)], "topic string, prerequisite_id long, dependent_id long")
    got = {(r["topic"], r["paper_id"]): r for r in ordering.order_paths(n, e.union(e), claimed, block).collect()}
    check_order(got, nodes, edges, claims)


def test_order_of_whole_tables(spark, sf_dir):
    """Every topic of the test tables, with links turned round so that there are cycles."""
    p, e = x.papers(spark, sf_dir).collect(), [(r["topic"], r["cited_id"], r["citing_id"]) for r in x.citations(spark, sf_dir).collect()]
    nodes, edges = {}, {}
    for r in p:
        nodes.setdefault(r["topic"], {})[r["paper_id"]] = r["year"]
        edges.setdefault(r["topic"], set())
    for t, a, b in e:
        edges[t] |= {(a, b)} | ({(b, a)} if (a + b) % 7 == 0 else set())
    n, links = frames(spark, nodes, edges)
    got = {(r["topic"], r["paper_id"]): r for r in ordering.order_paths(n, links, None, 4).collect()}
    check_order(got, nodes, edges, {t: set() for t in edges})
    assert any(r["broken"] for r in got.values())


def test_empty_order(spark):
    n, e = frames(spark, {}, {})
    assert ordering.order_paths(n, e).count() == 0
    n, e = frames(spark, {"t": {1: None, 2: 1999}}, {"t": set()})
    assert [(r["paper_id"], r["level"]) for r in ordering.order_paths(n, e).orderBy("position").collect()] == [(1, 0), (2, 0)]


def plain_pagerank(ids, links, damping=0.5, iterations=100):
    rank = dict.fromkeys(ids, 1 / len(ids))
    out = {p: [b for a, b in links if a == p] for p in ids}
    for _ in range(iterations):
        loose = sum(rank[p] for p in ids if not out[p])
        rank = {p: (1 - damping) / len(ids) + damping * (loose / len(ids) + sum(rank[a] / len(out[a]) for a in ids if p in out[a])) for p in ids}
    return rank


@pytest.mark.parametrize("per_step", [3])
def test_pagerank_of_random_graphs(spark, per_step):
    nodes, edges = some_graph(7)
    n, e = frames(spark, nodes | {"lonely": {1: 2000}}, {t: {(b, a) for a, b in of} for t, of in edges.items()})
    got = {(r["topic"], r["paper_id"]): r["pagerank"] for r in graph.pagerank(n, e, per_step=per_step).collect()}
    assert got["lonely", 1] == 1
    for t, of in nodes.items():
        want = plain_pagerank(list(of), edges[t])
        assert all(abs(got[t, p] - want[p]) < 1e-9 for p in of) and abs(sum(got[t, p] for p in of) - 1) < 1e-9
    assert graph.pagerank(n.limit(0), e.limit(0)).count() == 0

def test_pagerank_sums_shares_once_an_iteration(spark, monkeypatch):
    """Each iteration's sums are used twice, for the papers and for what is dangling, from one exchange; long lists lie in parts."""
    nodes, edges = some_graph(11, size=20)
    n, e = frames(spark, nodes, {t: {(b, a) for a, b in of} for t, of in edges.items()})
    if hasattr(graph, "LIST"):
        monkeypatch.setattr(graph, "LIST", 2)
    plans, plain = [], graph.Steps.save_by

    def kept(self, df, name, *columns):
        if name == "rank4":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(self, df, name, *columns)

    monkeypatch.setattr(graph.Steps, "save_by", kept)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r["topic"], r["paper_id"]): r["pagerank"] for r in graph.pagerank(n, e, iterations=4, tolerance=0.0).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for t, of in nodes.items():
        want = plain_pagerank(list(of), edges[t], iterations=4)
        assert len([k for k in got if k[0] == t]) == len(of) and all(abs(got[t, p] - want[p]) < 1e-12 for p in of)
    sums = [x for x in plans[0].splitlines() if re.search(r"(?<!Reused)Exchange hashpartitioning\(topic#\d+, (paper_id|to)#", x.split("ReusedExchange")[0])]
    assert len(sums) == 2


@pytest.mark.parametrize("window,least", [(3, 5), (1, 30)])
def test_age_rescale_against_all_pairs(spark, window, least):
    r = random.Random(window)
    rows = [(f"t{i % 3}", i, r.choice([None, 1990, 1991, 1999, 2000, 2001, 2020]), r.choice([0.0, 1.0, 1.0, 2.5, 1e9])) for i in range(80)] + [("flat", 1, 2000, 3.0), ("flat", 2, 2000, 3.0), ("one", 1, 2000, 1.0)]
    df = spark.createDataFrame(rows, "topic string, paper_id long, year int, score double").withColumn("more", F.lit("m"))
    got = graph.age_rescale(df, window=window, least=least).collect()
    assert len(got) == len(rows)
    for g in got:
        z = 0.0
        if g["year"] is not None:
            same = [(abs(y - g["year"]), y, p, s) for t, p, y, s in rows if t == g["topic"] and y is not None]
            cohort = [c for c in same if c[0] <= window]
            values = [c[3] for c in (cohort if len(cohort) >= least else sorted(same)[:least])]
            if len(values) > 1 and min(values) < max(values):
                m = sum(values) / len(values)
                z = (g["score"] - m) / (sum((v - m) ** 2 for v in values) / len(values)) ** 0.5
        assert abs(g["z"] - z) < 1e-6


def plain_louvain(ids, pairs):
    """The sequential method on dictionaries: each level from single papers, ties to the smallest group."""
    weight = {}
    for a, b in pairs:
        for e in ((a, b), (b, a)):
            weight[e] = weight.get(e, 0) + 1
    belongs, inside = {p: p for p in ids}, {}
    while weight:
        papers = sorted(set(belongs.values()))
        degree = {p: sum(w for (a, _), w in weight.items() if a == p) + 2 * inside.get(p, 0) for p in papers}
        total, group, moved, again = sum(degree.values()), {p: p for p in papers}, False, True
        while again:
            again = False
            for p in papers:
                gain = lambda g: sum(w for (a, b), w in weight.items() if a == p and b != p and group[b] == g) - degree[p] * sum(degree[q] for q in papers if q != p and group[q] == g) / total  # noqa: B023, E731
                best, value = group[p], gain(group[p])
                for g in sorted({group[b] for a, b in weight if a == p} - {group[p]}):
                    if gain(g) > value + 1e-12:
                        best, value = g, gain(g)
                if best != group[p]:
                    group[p], moved, again = best, True, True
        first = {g: min(p for p in papers if group[p] == g) for g in group.values()}
        name = {p: first[g] for p, g in group.items()}
        belongs = {p: name[g] for p, g in belongs.items()}
        if not moved or len(first) == 1:
            break
        sums, loops = {}, {}
        for p, w in inside.items():
            loops[name[p]] = loops.get(name[p], 0) + w
        for (a, b), w in weight.items():
            if name[a] == name[b]:
                loops[name[a]] = loops.get(name[a], 0) + w / 2
            else:
                sums[name[a], name[b]] = sums.get((name[a], name[b]), 0) + w
        weight, inside = sums, loops
    numbers = {g: i for i, g in enumerate(sorted(set(belongs.values())))}
    return {p: numbers[g] for p, g in belongs.items()}


def modularity(groups, pairs):
    degree, m = {}, len(pairs)
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    own = {}
    for p, d in degree.items():
        own[groups[p]] = own.get(groups[p], 0) + d
    return sum(groups[a] == groups[b] for a, b in pairs) / m - sum((d / 2 / m) ** 2 for d in own.values())


def test_communities_are_the_sequential_ones(spark, sf_dir):
    r = random.Random(11)
    pairs = {"cliques": [(a, b) for c in range(4) for a in range(c * 5, c * 5 + 5) for b in range(c * 5, a)] + [(0, 5), (5, 10), (10, 15)], "any": [(r.randint(0, 19), r.randint(0, 19)) for _ in range(45)], "both": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4)], "none": []}
    for e in x.citations(spark, sf_dir).where("topic IN ('src0', 'src1')").collect():
        pairs.setdefault(e["topic"], []).append((e["citing_id"], e["cited_id"]))
    pairs = {t: [(a, b) for a, b in of if a != b] for t, of in pairs.items()}
    ids = {t: sorted({p for e in of for p in e} | {0, 1}) for t, of in pairs.items()}
    n = spark.createDataFrame([(t, p) for t, of in ids.items() for p in of], "topic string, paper_id long")
    e = spark.createDataFrame([(t, a, b) for t, of in pairs.items() for a, b in of], "topic string, citing_id long, cited_id long")
    got = {(r["topic"], r["paper_id"]): r["community"] for r in graph.communities(n, e).collect()}
    for t, of in ids.items():
        assert {p: got[t, p] for p in of} == plain_louvain(of, pairs[t])


def test_communities_of_several_blocks(spark):
    """A topic that no block holds: as good as the sequential result, nearly."""
    r = random.Random(4)
    pairs = sorted({(a, b) for a in range(120) for b in range(a) if r.random() < (0.3 if a // 15 == b // 15 else 0.01)})
    n = spark.createDataFrame([("t", p) for p in range(120)], "topic string, paper_id long")
    e = spark.createDataFrame([("t", a, b) for a, b in pairs], "topic string, citing_id long, cited_id long")
    got = {r["paper_id"]: r["community"] for r in graph.communities(n, e, block=30).collect()}
    assert modularity(got, pairs) > 0.99 * modularity(plain_louvain(list(range(120)), pairs), pairs)
    assert sorted(set(got.values())) == list(range(len(set(got.values()))))
