"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by itself, so that a pair of centroids names a cell of vectors. A query visits pairs in
the order of the sum of its halves' similarities to them, by a heap over the two sorted lists, until their cells hold
enough vectors, and these are ranked by their exact inner products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, table, trimmed

#: The quantisers are fitted on at most this many vectors, those of the smallest hashes of their ids.
SAMPLE = 20_000
#: Centroids of a half: this many times the fourth root of the number of vectors, and no more than MOST_CENTROIDS. Cells are
#: their square, so their counts, which go to every query, are bounded.
CENTROIDS, MOST_CENTROIDS = 4, 512
#: A query visits cells until they hold the share of all vectors at which this recall was reached on so many of the sample.
RECALL, PROBES = 0.96, 256
TOP = 20
#: Vectors that are compared at once, and queries.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 256
#: Centroids of the first half whose cells travel together.
SPAN = 8


def _kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows; fewer rows give fewer centroids."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        n = np.bincount(near, minlength=len(centres))
        for j in range(x.shape[1]):
            total = np.bincount(near, x[:, j], len(centres))
            centres[n > 0, j] = total[n > 0] / n[n > 0]
    return centres


def nearest_pairs(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(b) + j) by falling a[i] + b[j], until they hold `enough`; empty cells are passed over."""
    order_a, order_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen, out, held = [(-(a[order_a[0]] + b[order_b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(order_a[i]) * len(b) + int(order_b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[order_a[x]] + b[order_b[y]]), x, y))
    return out


def share_for(x: np.ndarray, books: list[np.ndarray], top: int = TOP, recall: float = RECALL, probes: int = PROBES) -> float:
    """The share of the sample `x` that queries must visit to find `recall` of their `top` nearest in it. More vectors than
    the sample's lie closer to a query, so it is enough for them too. On vectors without structure it is large."""
    n, half = len(x), books[0].shape[1]
    code = [np.argmin((c**2).sum(1) - 2 * part @ c.T, axis=1) for c, part in zip(books, (x[:, :half], x[:, half:]))]
    cell = code[0] * len(books[1]) + code[1]
    counts = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    at = []
    for q in np.linspace(0, n - 1, min(n, probes)).astype(int):
        order = np.argsort(-((books[0] @ x[q, :half])[:, None] + books[1] @ x[q, half:]).ravel(), kind="stable")
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(counts[order])
        score = x @ x[q]
        score[q] = -np.inf
        at.append(before[cell[np.argpartition(-score, min(top, n - 1) - 1)[: min(top, n - 1)]]] if n > 1 else np.array([n]))
    return float(np.quantile(np.concatenate(at), recall)) / n


def _usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v): rows whose vector has only finite components and isn't zero, as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).where(fine & F.col("vec_id").isNotNull())


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.empty((0, 0))


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, recall: float = RECALL, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` (same columns) the `top` best of `vectors` but itself.

    Equal vectors are one entry with the top + 1 smallest of their ids, which is all that any answer can hold of them, so
    a very common vector costs as much as a rare one. How much of the table a query visits follows from the sample, alike at
    every size (share_for). Defined cases: vectors null, zero or with null or non-finite
    components take no part; those of another length than most of the sample take none either; ties go to smaller ids;
    repeated rows of one id are one; fewer candidates than `top` are all returned; an empty table gives no rows; further columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "multi-index")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = _usable(vectors, id_, vector)
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).collect()]
    if not sample:
        return empty
    sizes = [len(v) for v in sample]
    dim = max(sorted(set(sizes)), key=sizes.count)
    fitted = np.array([v for v in sample if len(v) == dim])
    half = dim // 2
    centroids = max(1, min(MOST_CENTROIDS, int(CENTROIDS * rows.count() ** 0.25)))
    books = [_kmeans(fitted[:, :half], centroids), _kmeans(fitted[:, half:], centroids)]
    n_b = len(books[1])
    share = share_for(fitted, books, top, recall)

    # Equal vectors are one. The smallest ids are merged as sorted arrays, so that none grows beyond top + 1.
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            cell = np.zeros(len(x), np.int64)
            for k, part in enumerate((x[:, :half], x[:, half:])):
                near = np.argmin((books[k] ** 2).sum(1) - 2 * part @ books[k].T, axis=1) if part.shape[1] else np.zeros(len(x), np.int64)
                cell = cell * n_b + near if k else near
            raw = np.ascontiguousarray(x)
            names = [r.tobytes() for r in raw + 0.0]  # + 0.0: no negative zeros
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array(names, pa.binary())], names=["vec_id", "cell", "x"])

    coded = rows.where(F.size("v") == dim).mapInArrow(trimmed(distinct), "vec_id bigint, cell int, x binary")

    def smallest(df: DataFrame, most: int) -> DataFrame:
        """(cell, x, ids): of each vector the `most` smallest ids. Salted first: a vector may be very common."""
        few = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, most)
        salted = df.groupBy("cell", "x", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(64)).alias("salt2")).agg(F.collect_set("vec_id").alias("ids"))
        return salted.groupBy("cell", "x").agg(F.flatten(F.collect_list(few("ids"))).alias("ids")).select("cell", "x", few("ids").alias("ids"))

    entries = scratch.save(smallest(coded, top + 1), "entries")
    counts = np.zeros(len(books[0]) * n_b, np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    enough = max(top + 1, int(np.ceil(share * counts.sum())))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, shards, masks, xs = [], [], [], []
            for qid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(raw, np.float64)
                seen = np.zeros(len(books[0]) * n_b, bool)
                seen[nearest_pairs(books[0] @ x[:half], books[1] @ x[half:], counts, enough)] = True
                seen = seen.reshape(-1, n_b)
                for shard in range(-(-len(seen) // SPAN)):
                    part = seen[shard * SPAN : (shard + 1) * SPAN]
                    if part.any():
                        ids.append(qid)
                        shards.append(shard)
                        masks.append(np.packbits(part, axis=1).tobytes())
                        xs.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shards, pa.int32()), pa.array(masks, pa.binary()), pa.array(xs, pa.binary())], names=["query_id", "shard", "mask", "x"])

    # Equal queries are one too; qid is the smallest of their ids.
    asked = _usable(queries, id_, vector).where(F.size("v") == dim).dropDuplicates(["vec_id"]).mapInArrow(trimmed(distinct), "vec_id bigint, cell int, x binary").select("vec_id", "x")
    asked = scratch.save(asked, "asked")
    once = asked.groupBy("x").agg(F.min("vec_id").alias("qid"))
    # A shard is the cells of SPAN centroids of the first half: a query goes to it once, with a mask of what it visits.
    blocks = max(1, -(-once.count() // QUERY_BLOCK))
    tasks = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    visits = once.select("qid", "x").repartition(tasks, "qid").mapInArrow(trimmed(visit), "query_id bigint, shard int, mask binary, x binary")
    visits = visits.groupBy("shard", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "mask", "x")).alias("queries"))
    held = [int(counts[k * SPAN * n_b : (k + 1) * SPAN * n_b].sum()) for k in range(-(-len(books[0]) // SPAN))]
    parts = F.array([F.lit(max(1, -(-n // VECTOR_BLOCK))) for n in held])
    sharded = entries.withColumn("shard", F.expr(f"int(cell div {SPAN * n_b})"))
    packed = sharded.groupBy("shard", F.pmod(F.xxhash64("x"), F.get(parts, F.col("shard")).cast("long")).alias("part")).agg(F.collect_list(F.struct("x", "ids", "cell")).alias("vectors"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                q, v = b.column(0)[at].as_py(), b.column(1)[at].as_py()
                x = np.frombuffer(b"".join(r["x"] for r in v), np.float64).reshape(len(v), dim)
                low = np.array([r["ids"][0] for r in v])
                cell = np.array([r["cell"] for r in v])
                row, column = cell // n_b % SPAN, cell % n_b
                owner, ids, scores = [], [], []
                for r in q:
                    mask = np.unpackbits(np.frombuffer(r["mask"], np.uint8).reshape(-1, (n_b + 7) // 8), axis=1)
                    live = np.flatnonzero(mask[row, column])
                    # Exact, and added up in one order everywhere. One more than asked for: the query may be among them.
                    s = (x[live] * np.frombuffer(r["x"], np.float64)).sum(1)
                    k = min(top + 1, len(s))
                    if not k:
                        continue
                    best = np.flatnonzero(s >= -np.partition(-s, k - 1)[k - 1])
                    best = best[np.lexsort((low[live[best]], -s[best]))][: top + 1]
                    got = sorted(((float(s[i]), j) for i in best for j in v[live[i]]["ids"]), key=lambda g: (-g[0], g[1]))[: top + 1]
                    owner += [r["query_id"]] * len(got)
                    ids += [j for _, j in got]
                    scores += [g for g, _ in got]
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["qid", "vec_id", "score"])

    # Block by block, so that many tasks share the work of a shard.
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.get(parts, F.col("shard")).cast("long") - 1)))
    met = packed.join(visits.repartition(tasks, "shard", "part", "block"), ["shard", "part"]).select("queries", "vectors").mapInArrow(trimmed(compare), "qid bigint, vec_id bigint, score double")
    order = [F.desc("score"), "vec_id"]
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("r") <= top + 1).drop("r")
    best = best.groupBy("qid").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))).alias("found"))
    answered = asked.join(once, "x").select(F.col("vec_id").alias("query_id"), "qid").join(best, "qid")
    own = F.slice(F.array_sort(F.filter("found", lambda f: f["i"] != F.col("query_id"))), 1, top)
    out = answered.select("query_id", F.posexplode(own).alias("rank", "f"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.i").alias("vec_id"), (-F.col("f.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
