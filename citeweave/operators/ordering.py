"""Reading order under the rule that cited work comes first: cycles, levels, reduction and positions.

Topics of bounded size are walked in one task each, in linear time. Larger graphs are walked in blocks of bounded size: papers of one topic and neighbouring years. A block peels off what waits for
nothing, as far as it gets by itself, and sends the rest of the news to other blocks, one row for each paper told; so rounds
grow with the crossings of blocks, not with the depth of the graph, and no topic needs to fit a task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.operators.steps import Steps, ranked, small

#: Papers of a block, about; topics of no more are walked whole.
BLOCK = 200_000


def _years(nodes: DataFrame, block: int) -> DataFrame:
    """(topic, year, first, parts, middle): a topic's years with the first block of each, the number of blocks that it is
    split over, and the upper median of the topic's years (0 if none is known). Null years are a year of their own, first."""
    n = nodes.groupBy("topic", "year").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("topic").orderBy(F.asc_nulls_first("year")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dated = F.when(F.col("year").isNotNull(), F.col("n")).otherwise(0)
    whole = Window.partitionBy("topic")
    n = n.withColumn("sum", F.sum("n").over(up_to)).withColumn("seen", F.sum(dated).over(up_to)).withColumn("half", F.floor(F.sum(dated).over(whole) / 2))
    n = n.withColumn("middle", F.coalesce(F.min(F.when((F.col("seen") > F.col("half")) & F.col("year").isNotNull(), F.col("year"))).over(whole), F.lit(0)))
    return n.select("topic", "year", F.floor((F.col("sum") - F.col("n")) / block).alias("first"), F.ceil(F.col("n") / block).alias("parts"), "middle")


def _peel(rows: pd.DataFrame, links: pd.DataFrame, named: bool) -> pd.DataFrame:
    """One round of one block. rows: waiting papers (kind w) and news for them (kind m); links: from these papers on.

    Out come papers that are settled (d), those that still wait (w), news for other blocks (m) and links dropped for a cycle
    (x, from paper_id to other). Papers of one component are settled together, once none of them waits for a paper outside:
    a walk from the one whose way from a root comes first drops what leads back to a paper still open. Ways (root's year,
    root, papers) are compared only where `named`; as tuples they sort like the order in which a walk over all reaches them.
    """
    key = (rows["topic"].iloc[0], rows["block"].iloc[0])
    waits: dict = {}
    level: dict = {}
    way: dict = {}
    part: dict = {}
    members: dict = defaultdict(list)
    own = rows[rows["kind"] == "w"]
    for p, n, lv, c, y, w in zip(own["paper_id"], own["waiting"], own["level"], own["component"], own["root_year"], own["way"]):
        waits[p], level[p], part[p] = n, lv, c
        members[c].append(p)
        if named:
            way[p] = (y, *w)
    news = rows[rows["kind"] == "m"]
    for p, n, lv, y, w in zip(news["paper_id"], news["waiting"], news["level"], news["root_year"], news["way"]):
        waits[p] -= n
        level[p] = max(level[p], lv)
        if named:
            way[p] = min(way[p], (y, *w))
    after: dict = defaultdict(list)
    for a, b, t in zip(links["a"], links["b"], links["to"]):
        after[a].append((b, t))
    need = {c: sum(waits[p] for p in ps) for c, ps in members.items()}
    ready = [c for c, n in need.items() if not n]
    settled: list = []
    dropped: list = []
    away: dict = {}

    def walk(ps: list) -> None:
        inside = set(ps)
        following = {p: sorted(b for b, _ in after[p] if b in inside) for p in ps}
        start = min(ps, key=way.__getitem__)
        seen, open_, finished, gone = {start}, {start}, [], set()
        path = [(start, iter(following[start]))]
        while path:
            p, rest = path[-1]
            b = next(rest, None)
            if b is None:
                path.pop()
                open_.discard(p)
                finished.append(p)
            elif b in open_:
                gone.add((p, b))
            elif b not in seen:
                seen.add(b)
                open_.add(b)
                way[b] = (*way[p], b)
                path.append((b, iter(following[b])))
        for p in reversed(finished):  # an order in which what is kept leads forward
            for b in following[p]:
                if (p, b) not in gone:
                    level[b] = max(level[b], level[p] + 1)
        dropped.extend(gone)

    while ready:
        c = ready.pop()
        ps = members[c]
        if len(ps) > 1:
            walk(ps)
        settled += ps
        for p in ps:
            for b, t in after[p]:
                if part.get(b) == c and t == key[1]:
                    continue
                new = (*way[p], b) if named else None
                if t == key[1]:
                    level[b] = max(level[b], level[p] + 1)
                    if named:
                        way[b] = min(way[b], new)
                    need[part[b]] -= 1
                    waits[b] -= 1
                    if not need[part[b]]:
                        ready.append(part[b])
                else:
                    n, lv, w = away.get((t, b), (0, 0, None))
                    away[t, b] = (n + 1, max(lv, level[p] + 1), new if w is None else min(w, new) if named else None)
    over = set(waits).difference(settled)
    split = lambda w: (w[0], list(w[1:])) if w else (0, [])
    out = [(*key, p, "d", 0, level[p], part[p], 0, [], p) for p in settled]
    out += [(*key, p, "w", waits[p], level[p], part[p], *split(way.get(p)), p) for p in over]
    out += [(key[0], t, b, "m", n, lv, b, *split(w), b) for (t, b), (n, lv, w) in away.items()]
    out += [(*key, a, "x", 0, 0, a, 0, [], b) for a, b in dropped]
    return pd.DataFrame(out, columns=["topic", "block", "paper_id", "kind", "waiting", "level", "component", "root_year", "way", "other"])


def _settle(papers: DataFrame, links: DataFrame, named: bool, steps: Steps, tag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settled, waiting, dropped) of papers (topic, block, paper_id, component, root_year) and links (topic, a, b): what
    rounds of _peel come to. What still waits lies in a cycle or behind one. All papers of a component are in one block."""
    kinds = {c: papers.schema[c].dataType.simpleString() for c in ("topic", "paper_id")}
    schema = f"topic {kinds['topic']}, block bigint, paper_id {kinds['paper_id']}, kind string, waiting int, level int, component {kinds['paper_id']}, root_year int, way array<{kinds['paper_id']}>, other {kinds['paper_id']}"
    at = lambda end, name: papers.select("topic", F.col("paper_id").alias(end), F.col("block").alias(name), F.col("component").alias(f"{name}_c"))
    known = steps.save(links.join(at("a", "block"), ["topic", "a"]).join(at("b", "to"), ["topic", "b"]), f"{tag}links")
    into = known.where("block_c <> to_c").groupBy("topic", F.col("b").alias("paper_id")).agg(F.count("*").cast("int").alias("waiting"))
    state = papers.join(into, ["topic", "paper_id"], "left").select(
        "topic", "block", "paper_id", F.lit("w").alias("kind"), F.coalesce("waiting", F.lit(0)).alias("waiting"), F.lit(0).alias("level"), "component", "root_year",
        (F.array("paper_id") if named else F.array().cast(f"array<{kinds['paper_id']}>")).alias("way"), F.col("paper_id").alias("other"),
    )
    state = steps.save(state, f"{tag}0")
    links_of = known.select("topic", "block", "a", "b", "to")
    active, idle, rounds = state, None, 0
    done: list[DataFrame] = []
    while True:
        rounds += 1
        blocks = active.select("topic", "block").distinct()
        there = links_of.join(small(blocks), ["topic", "block"], "left_semi") if rounds > 1 else links_of
        work = lambda a, b: _peel(a, b, named) if len(a) else a.assign(component=a["paper_id"], other=a["paper_id"])
        out = active.groupBy("topic", "block").cogroup(there.groupBy("topic", "block")).applyInPandas(work, schema)
        out = steps.save(out if idle is None else out.unionByName(idle), f"{tag}{rounds}")
        done.append(out.where("kind IN ('d', 'x')"))
        news = out.where("kind = 'm'")
        if news.isEmpty():
            break
        # News for one paper become one row before they travel.
        first = F.min_by(F.struct("root_year", "way"), F.struct("root_year", "way"))
        told = news.groupBy("topic", "block", "paper_id").agg(F.sum("waiting").cast("int").alias("waiting"), F.max("level").alias("level"), first.alias("first"))
        told = told.select("topic", "block", "paper_id", F.lit("m").alias("kind"), "waiting", "level", F.col("paper_id").alias("component"), "first.root_year", "first.way", F.col("paper_id").alias("other"))
        waiting, hit = out.where("kind = 'w'"), small(told.select("topic", "block").distinct())
        active, idle = waiting.join(hit, ["topic", "block"], "left_semi").unionByName(told), waiting.join(hit, ["topic", "block"], "left_anti")
    everything = done[0]
    for more in done[1:]:
        everything = everything.unionByName(more)
    return everything.where("kind = 'd'"), out.where("kind = 'w'"), everything.where("kind = 'x'")


def _coded(ids: np.ndarray, links: pd.DataFrame) -> tuple[list, list]:
    """Numbers of the papers that each of the sorted ids leads to, in order: where they start, and all of them."""
    a, b = np.searchsorted(ids, links["a"].to_numpy()), np.searchsorted(ids, links["b"].to_numpy())
    order = np.lexsort((b, a))
    return np.searchsorted(a[order], np.arange(len(ids) + 1)).tolist(), b[order].tolist()


def _walk(papers: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """A topic's papers with their levels (kind d) and the links dropped for cycles (x, from paper_id to other)."""
    names = ["topic", "paper_id", "kind", "level", "other"]
    ids = np.sort(papers["paper_id"].to_numpy())
    at, to = _coded(ids, links)
    year = np.empty(len(ids), np.int64)
    year[np.searchsorted(ids, papers["paper_id"].to_numpy())] = papers["root_year"].to_numpy()
    new, open_, done = 0, 1, 2
    state, following, finished, gone = [new] * len(ids), at[:-1], [], []
    for root in np.lexsort((np.arange(len(ids)), year)).tolist():
        if state[root] != new:
            continue
        state[root], path = open_, [root]
        while path:
            p = path[-1]
            k = following[p]
            if k == at[p + 1]:
                path.pop()
                state[p] = done
                finished.append(p)
                continue
            following[p] = k + 1
            if state[to[k]] == open_:
                gone.append(k)
            elif state[to[k]] == new:
                state[to[k]] = open_
                path.append(to[k])
    level, left = [0] * len(ids), set(gone)
    for p in reversed(finished):  # an order in which what is kept leads forward
        for k in range(at[p], at[p + 1]):
            if k not in left and level[to[k]] <= level[p]:
                level[to[k]] = level[p] + 1
    topic = papers["topic"].iloc[0] if len(papers) else None
    settled = pd.DataFrame({"topic": topic, "paper_id": ids, "kind": "d", "level": level, "other": ids})
    if not gone:
        return settled[names]
    back = pd.DataFrame({"topic": topic, "paper_id": ids[np.searchsorted(at, gone, "right") - 1], "kind": "x", "level": 0, "other": ids[[to[k] for k in gone]]})
    return pd.concat([settled, back])[names]


def _strong(links: pd.DataFrame) -> pd.DataFrame:
    """(topic, paper_id, component) of the papers in cycles of one topic's links, by one walk with a stack of open papers."""
    ids = np.unique(np.concatenate([links["a"].to_numpy(), links["b"].to_numpy()]))
    at, to = _coded(ids, links)
    number, low, waiting, following, stack, count, found = [0] * len(ids), [0] * len(ids), [False] * len(ids), at[:-1], [], 0, []
    for root in range(len(ids)):
        path = [] if number[root] else [root]
        while path:
            p = path[-1]
            if not number[p]:
                count += 1
                number[p] = low[p] = count
                waiting[p] = True
                stack.append(p)
            if following[p] < at[p + 1]:
                b = to[following[p]]
                following[p] += 1
                if not number[b]:
                    path.append(b)
                elif waiting[b]:
                    low[p] = min(low[p], number[b])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[p])
            if low[p] == number[p]:
                of = [stack.pop()]
                while of[-1] != p:
                    of.append(stack.pop())
                for q in of:
                    waiting[q] = False
                if len(of) > 1:
                    found += [(q, min(of)) for q in of]
    p, c = np.array(found, np.int64).reshape(-1, 2).T
    return pd.DataFrame({"topic": links["topic"].iloc[0], "paper_id": ids[p], "component": ids[c]})


def strong_components(links: DataFrame, steps: Steps, tag: str = "scc", block: int = BLOCK) -> DataFrame:
    """(topic, paper_id, component) of papers in cycles of links (topic, a, b); a component is named by its smallest paper.

    Topics of `block` linked papers at the most are walked in one task each; larger ones are coloured (_coloured)."""
    links = steps.save(links.select("topic", "a", "b"), f"{tag}all")
    sizes = links.select("topic", F.explode(F.array("a", "b")).alias("paper_id")).distinct().groupBy("topic").agg(F.count("*").alias("n"))
    sizes = steps.save(sizes, f"{tag}sizes")
    kind = links.schema["a"].dataType.simpleString()
    one = links.join(small(sizes.where(F.col("n") <= block).select("topic")), "topic", "left_semi")
    walked = steps.save(one.groupBy("topic").applyInPandas(_strong, f"topic {links.schema['topic'].dataType.simpleString()}, paper_id {kind}, component {kind}"), f"{tag}walked")
    large = sizes.where(F.col("n") > block).select("topic")
    return walked if large.isEmpty() else walked.unionByName(_coloured(links.join(small(large), "topic", "left_semi"), steps, tag))


def _coloured(links: DataFrame, steps: Steps, tag: str) -> DataFrame:
    """strong_components() of topics of any size.

    Forward-backward colouring: the smallest paper that reaches a paper is its colour; those of a colour that also reach its
    name are a component. What is left is coloured again. Each step of a wave is a minimum by paper, summed before it travels.
    """
    left, found, again = steps.save(links.select("topic", "a", "b"), f"{tag}links"), None, 0
    while not left.isEmpty():
        again += 1
        ends = left.select("topic", F.explode(F.array("a", "b")).alias("paper_id")).distinct()
        colour, waves = steps.save(ends.withColumn("c", F.col("paper_id")).withColumn("new", F.lit(True)), f"{tag}{again}c0"), 0
        while not colour.where("new").isEmpty():
            waves += 1
            sent = colour.where("new").select("topic", F.col("paper_id").alias("a"), "c").join(left, ["topic", "a"]).groupBy("topic", F.col("b").alias("paper_id")).agg(F.min("c").alias("told"))
            better = F.coalesce(F.col("told") < F.col("c"), F.lit(False))
            colour = steps.save(colour.join(sent, ["topic", "paper_id"], "left").select("topic", "paper_id", F.when(better, F.col("told")).otherwise(F.col("c")).alias("c"), better.alias("new")), f"{tag}{again}c{waves}")
            steps.drop(f"{tag}{again}c{waves - 1}")
        colour = colour.drop("new")
        of = lambda end: colour.select("topic", F.col("paper_id").alias(end), F.col("c").alias(f"c{end}"))
        same = steps.save(left.join(of("a"), ["topic", "a"]).join(of("b"), ["topic", "b"]).where("ca = cb").select("topic", "ca", "a", "b"), f"{tag}{again}same")
        back, waves = steps.save(colour.where("paper_id = c"), f"{tag}{again}b0"), 0
        reached = back
        while not back.isEmpty():
            waves += 1
            before = same.join(back.select("topic", F.col("paper_id").alias("b")), ["topic", "b"]).select("topic", F.col("a").alias("paper_id"), F.col("ca").alias("c")).distinct()
            back = steps.save(before.join(reached, ["topic", "paper_id"], "left_anti"), f"{tag}{again}b{waves}")
            reached = reached.unionByName(back)
        members = steps.save(reached, f"{tag}{again}found")
        found = members if found is None else found.unionByName(members)
        gone = lambda end: members.select("topic", F.col("paper_id").alias(end))
        left = steps.save(left.join(gone("a"), ["topic", "a"], "left_anti").join(gone("b"), ["topic", "b"], "left_anti"), f"{tag}{again}left")
    if found is None:
        return links.select("topic", F.col("a").alias("paper_id"), F.col("a").alias("component")).limit(0)
    sizes = found.groupBy("topic", "c").agg(F.count("*").alias("n")).where("n > 1").select("topic", "c")
    return found.join(sizes, ["topic", "c"], "left_semi").select("topic", "paper_id", F.col("c").alias("component"))


def settle_order(nodes: DataFrame, links: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(levels, dropped): topic, paper_id, level of every paper, the longest way to it, and links (topic, a, b) dropped for cycles.

    nodes: topic, paper_id, year, each once; links: topic, a, b (a comes before b), distinct, among the nodes. The walk that
    finds what to drop starts at the oldest (undated papers stand at the upper median of the topic's years), goes by id, and
    drops what leads back to a paper still open. Topics of `block` papers at the most are walked so in one task each. For larger ones it is made of one walk for each strong component, from the paper at which a
    walk over all would enter it; a component has to fit a task, a topic hasn't.
    """
    steps = Steps(nodes.sparkSession, "order")
    years = steps.save(_years(nodes, block).withColumnRenamed("year", "_year").withColumnRenamed("topic", "_topic"), "years")
    spot = F.col("first") * 1_000_000 + F.pmod(F.xxhash64("paper_id"), F.col("parts"))
    placed = nodes.join(small(years), (F.col("topic") == F.col("_topic")) & F.col("year").eqNullSafe(F.col("_year")))
    papers = steps.save(placed.select("topic", spot.cast("long").alias("block"), "paper_id", F.col("paper_id").alias("component"), F.coalesce("year", "middle").cast("int").alias("root_year")), "papers")
    links = steps.save(links.select("topic", "a", "b"), "links")
    sizes = steps.save(papers.groupBy("topic").agg(F.count("*").alias("n")), "sizes")
    one, large = (small(sizes.where(c).select("topic")) for c in (F.col("n") <= block, F.col("n") > block))
    kinds = {c: papers.schema[c].dataType.simpleString() for c in ("topic", "paper_id")}
    schema = f"topic {kinds['topic']}, paper_id {kinds['paper_id']}, kind string, level int, other {kinds['paper_id']}"
    whole = papers.join(one, "topic", "left_semi").groupBy("topic").cogroup(links.join(one, "topic", "left_semi").groupBy("topic")).applyInPandas(_walk, schema)
    whole = steps.save(whole, "whole")
    levels = whole.where("kind = 'd'").select("topic", "paper_id", "level")
    dropped = whole.where("kind = 'x'").select("topic", F.col("paper_id").alias("a"), F.col("other").alias("b"))
    if large.isEmpty():
        return levels, dropped
    more = _settle_large(papers.join(large, "topic", "left_semi"), steps.save(links.join(large, "topic", "left_semi"), "largelinks"), steps, block)
    return levels.unionByName(more[0]), dropped.unionByName(more[1])


def _settle_large(papers: DataFrame, links: DataFrame, steps: Steps, block: int) -> tuple[DataFrame, DataFrame]:
    """settle_order() of topics of more than one block."""
    settled, waiting, _ = _settle(papers, links, False, steps, "first")
    waiting = steps.save(waiting.select("topic", "paper_id"), "waiting")
    none = links.limit(0)
    if waiting.isEmpty():
        return settled.select("topic", "paper_id", "level"), none
    # What waits lies in cycles, between or behind them. Peeled from the other end too, what is behind goes.
    rest = links.join(waiting.withColumnRenamed("paper_id", "a"), ["topic", "a"], "left_semi").join(waiting.withColumnRenamed("paper_id", "b"), ["topic", "b"], "left_semi")
    rest = steps.save(rest, "rest")
    held = papers.join(waiting, ["topic", "paper_id"], "left_semi")
    _, core, _ = _settle(held, rest.select("topic", F.col("b").alias("a"), F.col("a").alias("b")), False, steps, "back")
    core = steps.save(core.select("topic", "paper_id"), "core")
    inner = rest.join(core.withColumnRenamed("paper_id", "a"), ["topic", "a"], "left_semi").join(core.withColumnRenamed("paper_id", "b"), ["topic", "b"], "left_semi")
    components = steps.save(strong_components(inner, steps, block=block), "components")
    # Topics with cycles, once more, by component and with the ways to each paper. A component lies where its name does.
    topics = components.select("topic").distinct()
    named = components.select("topic", "paper_id", F.col("component").alias("_c"))
    homes = papers.select("topic", F.col("paper_id").alias("_c"), F.col("block").alias("_home"))
    cyclic = papers.join(small(topics), "topic", "left_semi").join(named, ["topic", "paper_id"], "left").join(homes.join(named.select("topic", "_c").distinct(), ["topic", "_c"], "left_semi"), ["topic", "_c"], "left")
    cyclic = steps.save(cyclic.select("topic", F.coalesce("_home", "block").alias("block"), "paper_id", F.coalesce("_c", "component").alias("component"), "root_year"), "cyclic")
    again, _, dropped = _settle(cyclic, links.join(small(topics), "topic", "left_semi"), True, steps, "again")
    levels = settled.join(small(topics), "topic", "left_anti").select("topic", "paper_id", "level").unionByName(again.select("topic", "paper_id", "level"))
    return levels, dropped.select("topic", F.col("paper_id").alias("a"), F.col("other").alias("b"))


def reduce_links(links: DataFrame, levels: DataFrame, steps: Steps) -> DataFrame:
    """Links (topic, a, b) of a graph without cycles, without those whose target is reached by another successor of a.

    levels: topic, paper_id, level, rising along every link. A link can only be implied if it skips a level. Pairs reached by two
    links or more are built wave by wave, from papers with such links, and only up to the highest target that they skip to.
    """
    at = lambda end: levels.select("topic", F.col("paper_id").alias(end), F.col("level").alias(f"l{end}"))
    known = steps.save(links.join(at("a"), ["topic", "a"]).join(at("b"), ["topic", "b"]), "reduce0")
    skips = known.where("lb - la > 1")
    most = steps.save(skips.groupBy("topic", F.col("a").alias("s")).agg(F.max("lb").alias("most")), "reduceto")
    wave = steps.save(known.withColumnRenamed("a", "s").join(most, ["topic", "s"]).where("lb < most").select("topic", "s", F.col("b").alias("a"), "most"), "wave0")
    reached, n = None, 0
    while not wave.isEmpty():
        n += 1
        further = wave.join(known, ["topic", "a"]).where("lb <= most").select("topic", "s", "b", "lb", "most").distinct()
        if reached is not None:
            further = further.join(reached, ["topic", "s", "b"], "left_anti")
        further = steps.save(further, f"reached{n}")
        pairs = further.select("topic", "s", "b")
        reached = pairs if reached is None else reached.unionByName(pairs)
        wave = further.where("lb < most").select("topic", "s", F.col("b").alias("a"), "most")
    known = known.select("topic", "a", "b")
    return known if reached is None else known.join(reached.withColumnRenamed("s", "a"), ["topic", "a", "b"], "left_anti")


def order_paths(nodes: DataFrame, edges: DataFrame, claimed: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(topic, paper_id, level, position, prerequisites, broken) of nodes (topic, paper_id, year, rank).

    edges: citations; claimed: prerequisites (topic, prerequisite_id, dependent_id); ends outside the nodes and loops don't
    count, nor do repeats. Within a level, papers go by rank (the smaller first) and id. prerequisites: the claimed ones that
    survive, without implied ones, by level and id. broken: the edges dropped for cycles, from the paper on.
    """
    steps = Steps(nodes.sparkSession, "paths")
    kept = ["topic", "paper_id", "year", "rank"]
    nodes = steps.save(nodes.select(*kept).groupBy("topic", "paper_id").agg(F.min_by("year", "rank").alias("year"), F.min("rank").alias("rank")), "nodes")
    links = edges.select(F.col("topic").alias("topic"), F.col("cited_id").alias("a"), F.col("citing_id").alias("b"), F.lit(False).alias("claimed"))
    if claimed is not None:
        links = links.union(claimed.select("topic", "prerequisite_id", "dependent_id", F.lit(True)))
    there = lambda end: nodes.select("topic", F.col("paper_id").alias(end))
    links = links.where("a <> b").groupBy("topic", "a", "b").agg(F.max("claimed").alias("claimed")).join(there("a"), ["topic", "a"], "left_semi").join(there("b"), ["topic", "b"], "left_semi")
    links = steps.save(links, "links")
    levels, dropped = settle_order(nodes, links, block)
    levels = steps.save(levels, "levels")
    placed = ranked(nodes.join(levels, ["topic", "paper_id"]), "topic", ["level", "rank", "paper_id"], "position", steps)
    kind = nodes.schema["paper_id"].dataType.simpleString()
    out = placed.select("topic", "paper_id", "level", "position")
    broken = dropped.groupBy("topic", F.col("a").alias("paper_id")).agg(F.array_sort(F.collect_list("b")).alias("broken"))
    if claimed is None:
        out = out.withColumn("prerequisites", F.array().cast(f"array<{kind}>"))
    else:
        wanted = links.where("claimed").select("topic", "a", "b").join(dropped, ["topic", "a", "b"], "left_anti")
        reduced = reduce_links(wanted, levels, steps).join(levels.withColumnRenamed("paper_id", "a"), ["topic", "a"])
        before = reduced.groupBy("topic", F.col("b").alias("paper_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "a"))), lambda x: x["a"]).alias("prerequisites"))
        out = out.join(before, ["topic", "paper_id"], "left").withColumn("prerequisites", F.coalesce("prerequisites", F.array().cast(f"array<{kind}>")))
    return out.join(broken, ["topic", "paper_id"], "left").withColumn("broken", F.coalesce("broken", F.array().cast(f"array<{kind}>")))
