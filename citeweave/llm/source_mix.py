"""Mixing sources to target weights: a min-cost flow of words from documents to the quotas of overlapping sources.

Documents are summed by the set of sources that they belong to. The flow routes each set's words to its sources' quotas; every
further copy of a set costs more, so nothing is repeated while something fresh could serve. A seeded order of the
documents, found by histograms over the digits of a hash, then says which of them a part of a set is made of.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import SPACES, Scratch, free_names, small, table

#: Weights of the sources in code-point order, over and over; the share of all words that they get; most copies of a document.
WEIGHTS, SHARE, COPIES = (5, 2, 1), (3, 2), 2
SEED = "mix-1"
#: What the first, second, .. copy of a word costs: convex, as no later one is cheaper.
COSTS = (0, 1)
#: Sets of sources that the driver may route; more of them are an error, nothing is left out.
MOST_SETS = 100_000
#: Bits of the hash that orders documents, and of a digit of it.
HASH_BITS, DIGIT_BITS = 60, 12


def words_of(text: Column) -> Column:
    """Number of words: each becomes one letter, and what is left of the white space goes. Null: 0."""
    each = F.regexp_replace(text.cast("string"), r"[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(each, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: tuple = SHARE, most: int = COPIES) -> list[tuple[int, int]]:
    """Targets of sources (in order) of these sizes, as fractions (over, under): shares of the total by weight; none above
    `most` times its size, and what is cut off there is shared again among the others."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    free, rest = list(range(len(sizes))), share[0] * sum(sizes)  # in parts of 1 / share[1] of a word
    cut: set[int] = set()
    while True:
        total = sum(weight[i] for i in free)
        above = [i for i in free if rest * weight[i] > most * share[1] * sizes[i] * total]
        if not above:
            return [(most * sizes[i], 1) if i in cut else (rest * weight[i], share[1] * total) for i in range(len(sizes))]
        cut.update(above)
        rest -= sum(most * share[1] * sizes[i] for i in above)
        free = [i for i in free if i not in cut]


def route(sets: list[tuple[tuple, int]], quotas: dict, costs: tuple = COSTS) -> list[int]:
    """Words taken of each set (its sources, its size): the largest flow into the quotas and, among these, one of least cost.

    A set has an arc of its size for each copy at that copy's cost. Costs don't differ between sets, so the cheapest paths
    are those over first copies, then over second ones: each layer of arcs is filled by shortest augmenting paths, which
    may send words of an earlier layer to another of their set's sources.
    """
    sinks = list(quotas)
    at = {s: i for i, s in enumerate(sinks)}
    links = [[at[s] for s in members if s in at] for members, _ in sets]
    sent: list[dict[int, int]] = [{} for _ in sets]  # by set: words to each source
    into: list[set[int]] = [set() for _ in sinks]  # by source: sets that send it words
    left = [quotas[s] for s in sinks]
    taken = [0] * len(sets)
    for _ in sorted(costs):
        for p, (_, size) in enumerate(sets):
            supply = size
            while supply > 0:
                # From set p to a source with room, over sources that others could leave: nodes are sources.
                came: dict[int, tuple] = {s: (None, p) for s in links[p]}
                queue, goal = deque(links[p]), None
                while queue and goal is None:
                    s = queue.popleft()
                    if left[s] > 0:
                        goal = s
                        break
                    for q in into[s]:
                        for t in links[q]:
                            if t not in came:
                                came[t] = (s, q)
                                queue.append(t)
                if goal is None:
                    break
                path, s = [], goal
                while s is not None:
                    path.append((s, came[s][1]))
                    s = came[s][0]
                amount = min([supply, left[goal]] + [sent[q][path[i + 1][0]] for i, (_, q) in enumerate(path[:-1])])
                for i, (s, q) in enumerate(path):
                    sent[q][s] = sent[q].get(s, 0) + amount
                    into[s].add(q)
                    if i + 1 < len(path):
                        other = path[i + 1][0]
                        sent[q][other] -= amount
                        if not sent[q][other]:
                            into[other].discard(q)
                left[goal] -= amount
                supply -= amount
                taken[p] += amount
    return taken


def seeded(ident: Column, seed: str = SEED) -> Column:
    """A number of HASH_BITS bits from the seed and the id (null: empty)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _boundaries(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(_set, _limit, _rest): the hash at which a set's part is full, and the words that it still needs there.

    rows: _set, _size, _h; parts: _set, _rest, less than the set's size. A round for each digit sums sizes by digit, so a
    window has 2^DIGIT_BITS rows of a set at the most; later rounds read only what stands at the limit so far.
    """
    state = parts.select("_set", F.lit(0).cast("long").alias("_limit"), "_rest")
    for high in range(HASH_BITS, 0, -DIGIT_BITS):
        at = rows.join(state, "_set").where(F.shiftright("_h", high) == F.col("_limit"))
        seen = at.groupBy("_set", "_rest", F.shiftright("_h", high - DIGIT_BITS).alias("_digit")).agg(F.sum("_size").alias("_n"))
        order = Window.partitionBy("_set").orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = seen.withColumn("_sum", F.sum("_n").over(order)).where("_sum > _rest AND _sum - _n <= _rest")
        state = seen.select("_set", F.col("_digit").alias("_limit"), (F.col("_rest") - F.col("_sum") + F.col("_n")).alias("_rest"))
    return state


def mix(docs: DataFrame, ident: str, size: str, members: str, weights: tuple = WEIGHTS, share: tuple = SHARE, costs: tuple = COSTS, seed: str = SEED) -> DataFrame:
    """All columns of `docs` and `_target` (array of the targets of its sources, in their order) and `_taken` (long: words the
    mix takes of it, copies counted). Both get underscores more where `docs` has such a column. docs is read several times.

    size: long; members: array of the names of the sources that a document belongs to, null being a name of its own. A set
    gets whole copies, and a part of one in the seeded order: there one document of a set may be cut, so that a set takes
    exactly what was routed. Defined cases: sources are in code-point order, null last; a document without sources, and one
    of null or no size, gives nothing; repeated rows count each, and at the limit are told apart by nothing, so that any of
    them is cut; hashes that tie are ordered by id (null first) and size; an empty table gives no rows. No document is taken
    more than len(costs) times; reruns agree.
    """
    spark = docs.sparkSession
    key, own_size, sorted_members, target, taken, hashed = free_names(docs, "_set", "_size", "_members", "_target", "_taken", "_h")
    if [key, own_size, hashed] != ["_set", "_size", "_h"]:
        raise ValueError("columns named _set, _size and _h are needed here: rename yours")
    every = docs.withColumn(sorted_members, F.array_distinct(F.col(members).cast("array<string>"))).withColumn("_set", F.to_json(F.array_sort(sorted_members))).withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    every = every.withColumn("_h", seeded(F.col(ident), seed))
    rows = every.select("_set", "_size", "_h")
    found = every.where("_set IS NOT NULL").groupBy("_set").agg(F.sum("_size").alias("n"), F.min(F.array_sort(sorted_members)).alias("names")).limit(MOST_SETS + 1).collect()
    if len(found) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets of sources: merge small sources first")
    found.sort(key=lambda r: r["_set"])
    sizes: dict = {}
    for r in found:
        for name in r["names"]:
            sizes[name] = sizes.get(name, 0) + r["n"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(order, targets([sizes[s] for s in order], weights, share, len(costs))))
    flow = route([(tuple(r["names"]), r["n"]) for r in found], {s: over // under for s, (over, under) in wanted.items()}, costs)
    plan = [(r["_set"], *(divmod(f, r["n"]) if r["n"] else (0, 0)), [wanted[s][0] / wanted[s][1] for s in sorted(r["names"], key=lambda s: (s is None, s or ""))], [sizes[s] for s in sorted(r["names"], key=lambda s: (s is None, s or ""))]) for r, f in zip(found, flow)]
    plan = spark.createDataFrame(plan, "_set string, _copies long, _part long, _t array<double>, _s array<long>")
    limits = _boundaries(rows, small(plan.where("_part > 0").select("_set", F.col("_part").alias("_rest")), 60))
    placed = every.join(small(plan.join(limits, "_set", "left"), 160), "_set", "left")
    whole = F.coalesce(F.col("_copies"), F.lit(0)) * F.col("_size")
    clear = placed.where("_limit IS NULL OR _h <> _limit").withColumn("_more", F.when(F.col("_h") < F.col("_limit"), F.col("_size")).otherwise(F.lit(0)))
    # Rows of one hash: those of one id, as a rule.
    before = Window.partitionBy("_set").orderBy(F.col(ident).asc_nulls_first(), "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tied = placed.where("_h = _limit").withColumn("_sum", F.sum("_size").over(before)).withColumn("_more", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_sum") + F.col("_size")))).drop("_sum")
    out = clear.unionByName(tied)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_t").alias(target), (whole + F.col("_more")).cast("long").alias(taken), F.col("_s").alias(*free_names(docs, "_source_sizes")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, mixed by its own source. The words are counted once; the counts are written and reread."""
    docs = table(spark, sf_dir, "documents").select("doc_id", words_of(F.col("text")).alias("size"), F.array(F.col("source").cast("string")).alias("members"))
    mixed = mix(Scratch(spark, "mix").save(docs, "sizes"), "doc_id", "size", "members")
    return mixed.select("doc_id", "size", F.get("_source_sizes", F.lit(0)).alias("source_size"), F.get("_target", F.lit(0)).alias("target"), F.col("_taken").alias("taken"))


SQL = rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
 s AS (SELECT source, sum(size)::HUGEINT AS z FROM d GROUP BY 1),
 w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1] AS w FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * z / w, source) AS k FROM w),
 c AS (SELECT *, 3 * (SELECT sum(z) FROM s) - 4 * (sum(z) OVER (ORDER BY k) - z) AS rest, sum(w) OVER (ORDER BY k DESC) AS free FROM o),
 u AS (SELECT min(k) AS k FROM c WHERE NOT 4 * z * free < rest * w),
 t AS (SELECT c.source, c.z, CASE WHEN c.k < u.k THEN CAST(2 * c.z AS DOUBLE) ELSE CAST(x.rest * c.w AS DOUBLE) / CAST(2 * x.free AS DOUBLE) END AS target, CASE WHEN c.k < u.k THEN 2 * c.z ELSE (x.rest * c.w) // (2 * x.free) END AS quota FROM c, u JOIN c x ON x.k = u.k),
 r AS (SELECT doc_id, size, t.z AS source_size, target, CASE WHEN z > 0 THEN quota // z ELSE 0 END AS copies, CASE WHEN z > 0 THEN quota % z ELSE 0 END AS part, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
 SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(copies * size + greatest(0, least(size, part - upto + size)) AS BIGINT) AS taken FROM r"""
