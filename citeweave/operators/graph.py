"""Scores of the citation graph: degrees, PageRank, age-rescaled scores and communities, many topics in one job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.operators.steps import Steps, few, ranked, small

#: A row holds about so many of the papers that one cites.
LIST = 1024
#: Tables of so many papers for each partition at the most are joined by hash.
HASHED = 200_000


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic, paper_id, in_degree, out_degree) of all nodes, over distinct edges."""
    into = edges.groupBy("topic", F.col("cited_id").alias("paper_id")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy("topic", F.col("citing_id").alias("paper_id")).agg(F.count("*").alias("out_degree"))
    joined = nodes.select("topic", "paper_id").join(into, ["topic", "paper_id"], "left").join(out, ["topic", "paper_id"], "left")
    return joined.fillna(0, ["in_degree", "out_degree"])


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.5, iterations: int = 100, tolerance: float = 1e-9, per_step: int = 2) -> DataFrame:
    """(topic, paper_id, pagerank), each topic by itself: uniform teleport, the rank of dangling papers spread evenly,
    until no topic's ranks change by more than `tolerance` in sum.

    edges (topic, citing_id, cited_id) are distinct and among the nodes; loops don't count. Papers lie in buckets, each with those it cites in
    rows of about LIST at most. An iteration sends one share for each citation, summed before it travels, and joins the sums to the buckets,
    which don't move; what reached no paper is the rank of the dangling ones, as a topic's ranks sum to 1. Ranks are written every `per_step`
    iterations. A paper cited by very many is a sum, not a group.
    """
    spark = nodes.sparkSession
    steps, key = Steps(spark, "pagerank"), ["topic", "paper_id"]
    ids = nodes.select(*key).distinct()
    sizes = steps.save(ids.groupBy("topic").agg(F.count("*").alias("n")), "sizes")
    topics = F.broadcast if few(sizes) else (lambda df: df)
    # Joins to the buckets sort neither side, as long as a bucket's part of the papers is small.
    total = sizes.agg(F.sum("n")).first()[0] or 0
    joined = (lambda df: df.hint("shuffle_hash")) if total <= HASHED * int(spark.conf.get("spark.sql.shuffle.partitions")) else (lambda df: df)
    links = steps.save(edges.where("citing_id <> cited_id").select("topic", F.col("citing_id").alias("paper_id"), F.col("cited_id").alias("to")), "links")
    cites = links.groupBy(*key).agg(F.count("*").alias("cites"))
    # A long list has its parts from 1, a short one is part 0, which each paper has.
    lists = F.ceil(F.col("cites") / LIST)
    parts = links.join(cites, key).withColumn("part", F.when(lists > 1, 1 + F.pmod(F.xxhash64("to"), lists)).otherwise(0))
    parts = steps.save(parts.groupBy(*key, "cites", "part").agg(F.collect_list("to").alias("to")), "parts")
    short = ids.join(parts.where("part = 0").drop("part"), key, "left").withColumn("part", F.lit(0).cast("long"))
    papers = short.unionByName(parts.where("part > 0")).join(topics(sizes), "topic").select(*key, "part", "n", "cites", "to")
    papers = steps.save_by(papers, "papers", *key)
    start = papers.withColumn("rank", 1.0 / F.col("n"))
    rank = start.where("part = 0").select(*key, "rank")

    def following(rank: DataFrame, last: bool) -> DataFrame:
        sent = rank.where("to IS NOT NULL").select("topic", (F.col("rank") / F.col("cites")).alias("share"), F.explode("to").alias("paper_id"))
        # Said here, as the join below infers it for its side alone, and the two uses of the sums wouldn't share an exchange.
        sums = sent.where("topic IS NOT NULL AND paper_id IS NOT NULL").groupBy(*key).agg(F.sum("share").alias("sum"))
        found = sums.groupBy("topic").agg(F.sum("sum").alias("found"))
        base = rank.withColumnRenamed("rank", "old") if last and tolerance > 0 else papers.withColumn("old", F.lit(0.0))
        every = base.join(joined(sums), key, "left").join(topics(found), "topic", "left")
        loose = F.greatest(F.lit(0.0), 1 - F.coalesce("found", F.lit(0.0)))
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("sum", F.lit(0.0)) + loose / F.col("n"))
        return every.select(*papers.columns, new.alias("rank"), *(["old"] if last else []))

    done = 0
    while done < iterations:
        now = min(per_step, iterations - done)
        new = papers.join(joined(rank.drop("old")), key) if done else start
        for i in range(now):
            new = following(new, i + 1 == now)
        new = steps.save_by(new.where("part = 0").select(*key, "rank", "old"), f"rank{done + now}", "topic", "paper_id")
        steps.drop(f"rank{done}")
        rank, done = new, done + now
        if tolerance > 0:
            change = rank.groupBy("topic").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("c")).agg(F.max("c")).first()[0]
            if change is None or change < tolerance:
                break
    return rank.select("topic", "paper_id", F.col("rank").alias("pagerank"))


def age_rescale(scores: DataFrame, score: str = "score", window: int = 3, least: int = 5) -> DataFrame:
    """Adds z: the score against papers of the topic within `window` years, or the `least` nearest in time where these are
    fewer. 0 for undated papers and flat cohorts. scores: topic, paper_id, year and `score`.

    Cohorts come from one row for each topic and year: count, mean, squared deviations, least and greatest, merged over the
    years of the window. Where a cohort is small, so are its years, and the nearest papers are looked for in the years that
    hold `least` of them, nearest first; of each year only the `least` smallest ids can matter.
    """
    steps = Steps(scores.sparkSession, "cohorts")  # what several steps use is written once
    scores = steps.save(scores, "scores")
    columns, dated = scores.columns, scores.where("year IS NOT NULL")
    value = F.col(score).cast("double")
    years = steps.save(dated.groupBy("topic", "year").agg(F.count(value).alias("c"), F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi")), "years")
    near = years.withColumnRenamed("year", "other").withColumn("year", F.explode(F.expr(f"sequence(other - {window}, other + {window})")))
    near = near.join(years.select("topic", "year"), ["topic", "year"], "left_semi")
    total, mean = F.sum("c"), F.sum(F.col("c") * F.col("m")) / F.sum("c")
    cohort = near.groupBy("topic", "year").agg(total.alias("c"), mean.alias("m"), F.collect_list(F.struct("c", "m", "v")).alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Squares are summed around the window's mean: no difference of large numbers. A window has 2 * window + 1 years at the most.
    squares = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["c"] * (p["v"] + (p["m"] - F.col("m")) * (p["m"] - F.col("m"))))
    cohort = steps.save(cohort.select("topic", "year", "c", "m", F.sqrt(squares / F.col("c")).alias("s"), "lo", "hi"), "cohorts")
    flat = lambda z: F.when((F.col("c") < 2) | (F.col("lo") == F.col("hi")), 0.0).otherwise(z)
    placed = dated.join(small(cohort), ["topic", "year"])
    enough = placed.where(F.col("c") >= least).select(*columns, flat((value - F.col("m")) / F.col("s")).alias("z"))
    # A short cohort's nearest: years in order of their distance until `least` papers are there, by their counts. All papers of a
    # topic and year share them, so they are found once for each.
    short = cohort.where(F.col("c") < least).select("topic", F.col("year").alias("own"))
    by_year = Window.partitionBy("topic", "own").orderBy("gap", "year").rowsBetween(Window.unboundedPreceding, -1)
    options = short.join(years.select("topic", "year", "c"), "topic").withColumn("gap", F.abs(F.col("year") - F.col("own"))).withColumn("before", F.coalesce(F.sum("c").over(by_year), F.lit(0)))
    options = options.where(F.col("before") < least).select("topic", "own", "year", "gap", "before")
    wanted = options.groupBy("topic", "year").agg(F.max(least - F.col("before")).alias("most"))
    firsts = dated.join(small(wanted), ["topic", "year"]).withColumn("r", F.row_number().over(Window.partitionBy("topic", "year").orderBy("paper_id"))).where(F.col("r") <= least)
    nearest = options.join(firsts.select("topic", "year", "r", value.alias("o")), ["topic", "year"]).where(F.col("r") + F.col("before") <= least)
    sparse = nearest.groupBy("topic", F.col("own").alias("year")).agg(F.avg("o").alias("m"), F.stddev_pop("o").alias("s"), F.min("o").alias("lo"), F.max("o").alias("hi"), F.count("*").alias("c"))
    rest = dated.join(small(sparse), ["topic", "year"]).select(*columns, flat((value - F.col("m")) / F.col("s")).alias("z"))
    undated = scores.where("year IS NULL").select(*columns, F.lit(0.0).alias("z"))
    return enough.unionByName(rest).unionByName(undated)


def _moves(nodes: pd.DataFrame, links: pd.DataFrame, resolution: float) -> pd.DataFrame:
    """(topic, paper_id, group, moved): one block's papers after sweeps until none moves, groups outside standing still.

    nodes: group, degree, the group's mass and the topic's total of each paper; links: weight to a neighbour, its group and that
    group's mass. Papers go in the order of their ids; of equal gains the smallest group counts, and staying over both.
    """
    import numpy as np

    nodes = nodes.sort_values("paper_id", kind="stable")
    ids, degree = nodes["paper_id"].to_numpy(), nodes["degree"].to_numpy(float)
    groups = np.unique(np.concatenate([nodes["group"].to_numpy(), links["group"].to_numpy()]) if len(links) else nodes["group"].to_numpy())
    at = lambda g: np.searchsorted(groups, g)
    mass = np.zeros(len(groups))
    mass[at(nodes["group"].to_numpy())] = nodes["mass"].to_numpy(float)
    before = group = at(nodes["group"].to_numpy())
    if len(links):
        mass[at(links["group"].to_numpy())] = links["mass"].to_numpy(float)
        links = links.iloc[np.argsort(np.searchsorted(ids, links["paper_id"].to_numpy()), kind="stable")]
        ends = np.searchsorted(np.searchsorted(ids, links["paper_id"].to_numpy()), np.arange(len(ids) + 1))
        other, weight = links["other"].to_numpy(), links["weight"].to_numpy(float)
        place = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
        here, outside = ids[place] == other, at(links["group"].to_numpy())
        pull = resolution / nodes["total"].to_numpy(float)  # total: of both directions
        group, restless = before.copy(), True
        while restless:
            restless = False
            for i in range(len(ids)):
                span = slice(ends[i], ends[i + 1])
                if span.start == span.stop:
                    continue
                mass[group[i]] -= degree[i]
                near, back = np.unique(np.append(np.where(here[span], group[place[span]], outside[span]), group[i]), return_inverse=True)
                gain = np.bincount(back, np.append(weight[span], 0.0)) - pull[i] * degree[i] * mass[near]
                stay = gain[back[-1]]
                if gain.max() > stay + 1e-12:
                    group[i] = near[np.argmax(gain > gain.max() - 1e-12)]
                    restless = True
                mass[group[i]] += degree[i]
    return pd.DataFrame({"topic": nodes["topic"].to_numpy(), "paper_id": ids, "group": groups[group], "moved": group != before})


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, block: int = 50_000, rounds: int = 12) -> DataFrame:
    """(topic, paper_id, community) by the Louvain method on undirected weights (citations both ways weigh 2), numbered from 0 by
    first members.

    A level moves papers in blocks of about `block` papers of one topic: papers are visited in order of their ids and ties go to the
    lowest, so a topic of one block comes out as by a sequential pass. A larger topic's blocks move in turns, even and odd
    ones, against the groups of the others as they stand, until nothing moves or `rounds` are over. Groups then become the papers of
    the next level, by sums of weights, until a topic's groups stay or are one. Papers without links are communities of their own.
    """
    steps, key = Steps(nodes.sparkSession, "louvain"), ["topic", "paper_id"]
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in key}
    schema = f"topic {kinds['topic']}, paper_id {kinds['paper_id']}, group {kinds['paper_id']}, moved boolean"
    every = steps.save(nodes.select(*key).distinct(), "nodes")
    ends = [F.col(c).alias(n) for c, n in (("citing_id", "paper_id"), ("cited_id", "other"))]
    one = edges.where("citing_id <> cited_id").select("topic", *ends)
    links = one.unionByName(one.select("topic", F.col("other").alias("paper_id"), F.col("paper_id").alias("other"))).groupBy(*key, "other").agg(F.count("*").cast("double").alias("weight"))
    links = steps.save(links, "links0")
    loops = None  # weight inside a paper of this level
    belongs = steps.save(every.withColumn("group", F.col("paper_id")), "belongs0")  # where each first paper is by now
    level = 0
    while not links.isEmpty():
        level += 1
        degree = links.groupBy(*key).agg(F.sum("weight").alias("degree"))
        if loops is not None:
            degree = degree.join(loops, key, "left").select(*key, (F.col("degree") + 2 * F.coalesce("inside", F.lit(0.0))).alias("degree"))
        papers = steps.save(degree, f"degree{level}")
        totals = papers.groupBy("topic").agg(F.sum("degree").alias("total"), F.ceil(F.count("*") / block).alias("blocks"))
        totals = steps.save(totals, f"totals{level}")
        own = F.pmod(F.xxhash64("paper_id"), F.col("blocks"))
        papers = steps.save(papers.join(small(totals), "topic").withColumn("block", own), f"papers{level}")
        state, turn, most = papers.select(*key, F.col("paper_id").alias("group")), 0, totals.agg(F.max("blocks")).first()[0]
        changed = None
        while True:
            mass = state.join(papers, key).groupBy("topic", "group").agg(F.sum("degree").alias("mass"))
            stands = state.join(mass, ["topic", "group"])
            moving = F.col("blocks") > 1 if turn > 1 else F.lit(True)
            turns = moving & ((F.col("blocks") == 1) | (F.pmod(F.col("block") + turn, F.lit(2)) == 0))
            left = papers.where(turns).join(stands, key)
            right = links.join(papers.where(turns).select(*key, "block"), key).join(stands.withColumnRenamed("paper_id", "other"), ["topic", "other"])
            right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of their own, though derived from the same tables
            moved = left.groupBy("topic", "block").cogroup(right.groupBy("topic", "block")).applyInPandas(lambda a, b: _moves(a, b, resolution), schema)
            rest = state.join(papers.where(turns), key, "left_anti").withColumn("moved", F.lit(False))
            out = steps.save(moved.unionByName(rest), f"state{level}x{turn}")
            now = out.where("moved").select("topic").distinct()
            changed = now if changed is None else changed.unionByName(now)
            state, turn = out.select(*key, "group"), turn + 1
            if most == 1 or turn >= rounds or (turn > 1 and turn % 2 == 0 and out.where("moved").isEmpty()):
                break
        # Groups take the name of their first member, which keeps the order of the next level.
        names = state.groupBy("topic", "group").agg(F.min("paper_id").alias("name"))
        state = steps.save(state.join(names, ["topic", "group"]).select(*key, "name"), f"named{level}")
        belongs = steps.save(belongs.join(state.withColumnRenamed("paper_id", "group"), ["topic", "group"], "left").select(*key, F.coalesce("name", "group").alias("group")), f"belongs{level}")
        # Topics in which something moved, and that have several groups left, go on.
        on = steps.save(changed.distinct().join(state.groupBy("topic").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b"), "topic").select("topic"), f"on{level}")
        merged = links.join(small(on), "topic", "left_semi").join(state, key).join(state.select("topic", F.col("paper_id").alias("other"), F.col("name").alias("to")), ["topic", "other"])
        sums = steps.save(merged.groupBy("topic", F.col("name").alias("paper_id"), F.col("to").alias("other")).agg(F.sum("weight").alias("weight")), f"links{level}")
        inside = sums.where("paper_id = other").select(*key, (F.col("weight") / 2).alias("inside"))
        if loops is not None:
            earlier = loops.join(state, key).select("topic", F.col("name").alias("paper_id"), "inside")
            inside = inside.unionByName(earlier).groupBy(*key).agg(F.sum("inside").alias("inside"))
        loops, links = steps.save(inside, f"loops{level}"), sums.where("paper_id <> other")
    numbers = ranked(belongs.select("topic", F.col("group").alias("first")).distinct(), "topic", ["first"], "community", steps)
    return belongs.join(numbers.withColumnRenamed("first", "group"), ["topic", "group"]).select(*key, "community")
