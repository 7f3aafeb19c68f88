"""Large sets that share a passage but aren't alike: sketches as wide as the sets rule them out before whole sets travel."""

import random
import re

import numpy as np

from citeweave.llm import jaccard_join
from citeweave.llm.common import Scratch


def test_large_strangers_are_not_verified(spark, monkeypatch):
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(700))
    texts = [passage + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(r.randrange(1500, 2500))) for _ in range(24)]
    texts.append(texts[0].rsplit(" ", 20)[0])
    verified, plain = [], jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, *more: verified.extend(map(tuple, pairs.collect())) or plain(pairs, *more))
    members, links = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {m["doc_id"]: m["component"] for m in members.collect()} == {i: 0 if i == 24 else i for i in range(25)}
    assert len(verified) == links.count() == 1


def test_folded_sketches_bound_differences():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 3000, np.uint64))
    b = np.unique(np.r_[a[200:], r.integers(0, 1 << 63, 7000, np.uint64)])
    with np.errstate(over="ignore"):
        x, y, small = (jaccard_join.wide_sketch(s) for s in (a, b, a[:1024]))
    assert small is None and len(x) * 64 == 2048 and len(y) * 64 == 8192
    apart = np.bitwise_count(jaccard_join.folded(x, 32) ^ jaccard_join.folded(y, 32)).sum()
    assert 800 < apart <= len(np.setxor1d(a, b))
    parts = jaccard_join.folded(np.stack([y, y]), 64)
    assert (parts[0] == parts[1]).all() and (parts[0] == y[:64] ^ y[64:]).all()


def test_candidates_of_a_shared_passage_are_found_once(spark, monkeypatch):
    """Sets that share a passage share hundreds of signatures, and sketches don't rule their pairs out."""
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(700))
    texts = [passage + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(150)) for _ in range(80)]
    texts.append(texts[0].rsplit(" ", 20)[0])
    rows, plain = [], jaccard_join._candidates

    def counted(*args):
        found = plain(*args).cache()
        rows.extend(found.collect())
        return found

    monkeypatch.setattr(jaccard_join, "_candidates", counted)
    members, _ = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {m["doc_id"]: m["component"] for m in members.collect()} == {i: 0 if i == 80 else i for i in range(81)}
    assert 0 < len({(x["a"], x["b"]) for x in rows if x["b"] is not None}) <= 81 * 80 // 2
    assert len(rows) <= 4 * 81 * 80 // 2


def _rows_joined_by_sig(spark, since: int) -> int:
    """Rows that joins on sig alone have made in the statements after number `since`."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i) for i in range(runs.size())):
        if run.executionId() <= since:
            continue
        nodes, counts = store.planGraph(run.executionId()).allNodes(), store.executionMetrics(run.executionId())
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.match(r"\w+Join \[sig#\d+L?\], \[sig#\d+L?\], Inner(, Build\w+)?(, false)?$", node.desc()):
                metrics = node.metrics()
                for m in (metrics.apply(i) for i in range(metrics.size())):
                    if m.name() == "number of output rows" and counts.contains(m.accumulatorId()):
                        made += int(counts.apply(m.accumulatorId()).replace(",", ""))
    return made


def test_rows_of_buckets_are_joined_a_few_times(spark, monkeypatch):
    """Rows of buckets grow with the sets of a group, and meet what is known of their buckets three times, not ten."""
    plain, seen = Scratch.save, {}

    def save(self, df, name, *more):
        out = plain(self, df, name, *more)
        if name == "buckets0":
            seen["buckets"] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", save)
    passage = " ".join(f"p{i}" for i in range(700))
    for n in (60, 120):
        r = random.Random(5)
        texts = [passage + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(150)) for _ in range(n)]
        texts.append(texts[0].rsplit(" ", 20)[0])
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        since = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)
        members, _ = jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert {m["doc_id"]: m["component"] for m in members.collect()} == {i: 0 if i == n else i for i in range(n + 1)}
        seen[n] = _rows_joined_by_sig(spark, since)
        assert seen["buckets"] <= seen[n] <= 5 * seen["buckets"]
    assert seen[120] <= 3 * seen[60]
