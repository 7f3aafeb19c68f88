"""LM scoring: a hashed maximum-entropy model of words, with n-gram and skip features and a class-factored softmax.

p(word | two words before) = p(class | ...) p(leaf | class, ...) p(word | leaf). Classes are scored by hashed features of
the word before, of the one before that (a skip) and of both; leaves by the word before. Frequent words have a leaf each;
the others share leaves by their endings, and within a leaf go by their counts. Each task makes gradient steps over its
part of the training tokens, and the tasks' weights are averaged row by row, each by the tokens that it has seen.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import LOWER, Scratch, UPPER, table, text_chunks, trimmed

#: Classes, leaves of a class for frequent words and for the others, rows of hashed weights of classes and of leaves: of
#: a vocabulary of up to KNOWN words. Beyond it, the rows grow as its square root and the frequent words as its fourth root.
CLASSES, OWN, SHARED, ROWS, LEAF_ROWS, KNOWN = 16, 32, 32, 1 << 16, 1 << 15, 1 << 18
LEAVES = OWN + SHARED
#: Tokens of a gradient step, its size, and the rounds that the training chunks are dealt to.
STEP, RATE, ROUNDS = 1 << 15, 0.1, 2
#: Characters of a chunk: its distinct words and its tokens are held by one task.
CHUNK_CHARS = 8 << 20
#: Tokens whose probabilities are computed at a time.
CACHED = 1 << 11
#: Rows of weights that travel together between tasks.
BLOCK = 2048
#: Bytes of counted words that a task of the count holds, about; COUNTED bytes are for each byte of text, measured as 0.7.
TASK_BYTES, COUNTED = 32 << 20, 0.7
#: Characters of a word and the space after it; bytes of weights that a round's tasks send, at the most, for each of its
#: characters (they send less, as no task meets all rows).
WORD_CHARS, SENT = 6, 3
_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_START, _END = xxhash.xxh3_64_intdigest(b"\n<start>"), xxhash.xxh3_64_intdigest(b"\n<end>")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def ending(word: bytes) -> int:
    """Of the shared leaves, the one of words with this ending."""
    return zlib.crc32(word[-3:]) % (CLASSES * SHARED)


class _Numbers(dict):
    """Numbers of a chunk's distinct words, given as they are met, with their hashes (words) and endings (ends). Number 0 is the end."""

    def __init__(self):
        self.words, self.ends = [_END], [ending(b"\n<end>")]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(xxhash.xxh3_64_intdigest(word))
        self.ends.append(ending(word))
        return n


def _encode(docs: DataFrame, parts: int) -> DataFrame:
    """Chunks of documents as numbers of their distinct words, and these words' training counts by part of the vocabulary.

    Rows of chunks: chunk, ids, held, sizes (tokens of each document), tokens, words (hashes), endings. Rows of counts:
    chunk, part, at (numbers of the words), counted (hash, count, ending).
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk bigint, ids array<{key}>, held array<boolean>, sizes array<int>, tokens binary, words binary, endings binary, part int, at binary, counted binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, kind = TaskContext.get().partitionId(), 0, None
        state: dict = {}

        def restart():
            state.update(ids=[], held=[], sizes=[], tokens=[], seen=_Numbers(), chars=0)

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal number
            tokens = np.concatenate(state["tokens"])
            words, ends = np.array(state["seen"].words, np.uint64), np.array(state["seen"].ends, np.uint16)
            train = np.repeat(~np.array(state["held"], bool), state["sizes"])
            count = np.bincount(tokens[train], minlength=len(words)).astype(np.uint64)
            chunk = task << 24 | number
            number += 1
            part = (words % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            found, first = np.unique(part[order], return_index=True)
            groups = np.split(order.astype(np.uint32), first[1:])
            n = len(found) + 1
            pad = [None] * (n - 1)
            columns = [
                pa.array([chunk] * n, pa.int64()), pa.array([state["ids"], *pad], pa.list_(kind)), pa.array([state["held"], *pad], pa.list_(pa.bool_())), pa.array([state["sizes"], *pad], pa.list_(pa.int32())),
                pa.array([_planes(tokens), *pad], pa.binary()), pa.array([words.tobytes(), *pad], pa.binary()), pa.array([ends.tobytes(), *pad], pa.binary()),
                pa.array([None, *found.tolist()], pa.int32()), pa.array([None, *(_planes(g) for g in groups)], pa.binary()),
                pa.array([None, *(_planes(words[g]) + _planes(count[g]) + ends[g].tobytes() for g in groups)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "held", "sizes", "tokens", "words", "endings", "part", "at", "counted"])
            restart()

        def pairs():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["d", "h"]), b.column(2)], names=["k", "t"])

        restart()
        for keys, texts in text_chunks(pairs(), 2 << 20):
            split = [t.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split() for t in texts]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            numbers = np.fromiter(map(state["seen"].__getitem__, chain.from_iterable(split)), np.uint32, sizes.sum())
            state["tokens"].append(np.insert(numbers, np.cumsum(sizes), 0))  # each text's last token is the end
            state["ids"] += [k["d"] for k in keys]
            state["held"] += [k["h"] for k in keys]
            state["sizes"] += (sizes + 1).tolist()
            state["chars"] += sum(map(len, texts))
            if state["chars"] >= CHUNK_CHARS:
                yield from finish()
        if state["ids"]:
            yield from finish()

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return docs.select("doc_id", held.alias("held"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def sizes_for(v: int) -> tuple[int, int, int]:
    """Of a vocabulary of `v` words: own leaves of a class, rows of weights of classes and of leaves, in whole blocks."""
    by = max(1.0, v / KNOWN) ** 0.5
    return math.ceil(OWN * by**0.5), math.ceil(ROWS * by / BLOCK) * BLOCK, math.ceil(LEAF_ROWS * by / BLOCK) * BLOCK


def _count(counted: DataFrame, tasks: int) -> DataFrame:
    """Whole counts of each chunk's words (chunk, at, totals), the words of training (word, count, ending), and
    sums over shared leaves (leaf, count, known)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(c, at, x) for b in batches for c, at, x in zip(*(b.column(k).to_pylist() for k in range(3)))]
        names = ["chunk", "at", "totals", "word", "count", "ending", "leaf", "known"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

        if not held:
            return
        size = [len(x) // 18 for _, _, x in held]
        words = np.concatenate([_unplanes(x[: 8 * n], np.uint64) for n, (_, _, x) in zip(size, held)])
        count = np.concatenate([_unplanes(x[8 * n : 16 * n], np.uint64) for n, (_, _, x) in zip(size, held)]).astype(np.int64)
        ends = np.concatenate([np.frombuffer(x[16 * n :], np.uint16) for n, (_, _, x) in zip(size, held)])
        kinds_of, first, inverse = np.unique(words, return_index=True, return_inverse=True)
        total = np.bincount(inverse, count, len(kinds_of)).astype(np.int64)
        end = ends[first]
        place = 0
        for n, (chunk, at, _) in zip(size, held):
            yield rows(chunk=[chunk], at=[at], totals=[_planes(total[inverse[place : place + n]])])
            place += n
        top = np.flatnonzero(total > 0)
        yield rows(word=kinds_of[top].view(np.int64), count=total[top], ending=end[top].astype(np.int32))
        leaves = np.arange(CLASSES * SHARED)
        yield rows(leaf=leaves, count=np.bincount(end, total, len(leaves)).astype(np.int64), known=np.bincount(end, total > 0, len(leaves)).astype(np.int64))

    schema = "chunk bigint, at binary, totals binary, word bigint, count bigint, ending int, leaf int, known bigint"
    return counted.repartition(tasks, "part").select("chunk", "at", "counted").mapInArrow(trimmed(run), schema)


@dataclass
class Model:
    """own: hashes of frequent words, sorted, and their leaves; mass: log10 weight of each shared leaf; biases and weights."""

    own: np.ndarray
    own_leaf: np.ndarray
    mass: np.ndarray
    n: int
    v: int
    class_bias: np.ndarray
    leaf_bias: np.ndarray
    weights: np.ndarray
    leaf_weights: np.ndarray

    def places(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Leaf number (class * leaves of a class + leaf) of each word."""
        n_leaves = self.leaf_weights.shape[1]
        shared = (ends % CLASSES).astype(np.int64) * n_leaves + n_leaves - SHARED + ends // CLASSES
        if not len(self.own):
            return shared
        k = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
        return np.where(self.own[k] == words, self.own_leaf[k], shared)


def _start(top: list, leaves: list) -> Model:
    """The model before training: by counts alone. Its weights, all zero, take memory only where they are changed."""
    n, v = sum(r["count"] for r in leaves), sum(r["known"] for r in leaves)
    own, rows, leaf_rows = sizes_for(v)
    mass = np.ones(CLASSES * SHARED)  # one word that training has not seen, for each shared leaf
    for r in leaves:
        mass[r["leaf"]] += r["count"] + r["known"]
    weight = np.zeros((CLASSES, own + SHARED))
    hashes, place = [], []
    for i, r in enumerate(top):
        mass[r["ending"]] -= r["count"] + 1
        weight[i % CLASSES, i // CLASSES] = r["count"] + 1
        hashes.append(r["word"] & (1 << 64) - 1)
        place.append(i % CLASSES * (own + SHARED) + i // CLASSES)
    shared = np.arange(CLASSES * SHARED)
    weight[shared % CLASSES, own + shared // CLASSES] = mass
    logs = np.log(np.maximum(weight, 1e-9))
    order = np.argsort(np.array(hashes, np.uint64))
    return Model(
        np.array(hashes, np.uint64)[order], np.array(place, np.int64)[order], np.log10(mass), n, v,
        np.log(weight.sum(1)).astype(np.float32), logs.astype(np.float32), np.zeros((rows, CLASSES), np.float32), np.zeros((leaf_rows, own + SHARED), np.float32),
    )


def _features(words: np.ndarray, tokens: np.ndarray, first: np.ndarray, start: int, end: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens start to end, [features, token] for the class, and the hash of the word before; first: where texts start."""
    begin = max(0, start - 2)
    word, new = words[tokens[begin:end]], first[begin:end]
    one = np.concatenate([[np.uint64(_START)], word[:-1]])
    one[new] = np.uint64(_START)
    two = np.concatenate([[np.uint64(_START)], one[:-1]])
    two[new] = np.uint64(_START)
    one, two = one[start - begin :], two[start - begin :]
    with np.errstate(over="ignore"):
        rows = np.stack([_mix(one + np.uint64(1)), _mix(two + np.uint64(2)), _mix(_mix(one + np.uint64(3)) + two)]) % np.uint64(n_rows)
        return rows.astype(np.int64), _mix(one + np.uint64(4))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each row, in place. Logits are near logarithms of counts, so their largest needs no subtraction unless sums say so."""
    with np.errstate(over="ignore"):
        e = np.exp(x)
    total = np.einsum("ij->i", e)
    if not ((total > 1e-20) & (total < 1e30)).all():
        np.exp(x - x.max(1, keepdims=True), out=e)
        total = np.einsum("ij->i", e)
    return np.divide(e, total[:, None], out=x)


def _leaf_rows(before: np.ndarray, kind: np.ndarray, n_rows: int) -> np.ndarray:
    """Rows of leaf weights: of the word before and the token's class."""
    with np.errstate(over="ignore"):
        return (_mix(before + kind.astype(np.uint64)) % np.uint64(n_rows)).astype(np.int64)


def _forward(model: Model, weights: np.ndarray, leaf_weights: np.ndarray, rows: np.ndarray, leaf_rows: np.ndarray, kind: np.ndarray):
    """Of tokens (rows), probabilities of classes; of words before in a class (leaf_rows, kind), those of leaves. Few at a time, as
    many as stay in cache."""
    classes, leaves = np.empty((rows.shape[1], weights.shape[1]), np.float32), np.empty((len(kind), leaf_weights.shape[1]), np.float32)
    for at in range(0, len(classes), CACHED):
        k = slice(at, at + CACHED)
        c = classes[k]
        np.take(weights, rows[0, k], axis=0, out=c, mode="clip")
        c += weights[rows[1, k]]
        c += weights[rows[2, k]]
        c += model.class_bias
        _softmax(c)
    for at in range(0, len(leaves), CACHED):
        k = slice(at, at + CACHED)
        x = leaves[k]
        np.take(leaf_weights, leaf_rows[k], axis=0, out=x, mode="clip")
        x += model.leaf_bias[kind[k]]
        _softmax(x)
    return classes, leaves


def _alike(leaf_rows: np.ndarray, kind: np.ndarray):
    """Tokens whose leaves have the same probabilities, as they share row and class: (row, class, tokens) of each group, sorted by
    row, and each token's group."""
    key, group, n = np.unique(leaf_rows * CLASSES + kind, return_inverse=True, return_counts=True)
    return key // CLASSES, key % CLASSES, n, group


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows that begin at `starts`, pair by pair; x is used up."""
    sizes = np.diff(np.r_[starts, len(x)])
    place = np.arange(len(x)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place  # rows from this one to its run's end
    at, step = np.flatnonzero(left > 1), 1
    while len(at):
        at = at[(place[at] & (2 * step - 1) == 0) & (left[at] > step)]
        x[at] += x[at + step]
        step *= 2
    return x[starts]


def _chunk(row: dict, model: Model):
    words, ends = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["endings"], np.uint16)
    tokens, sizes = _unplanes(row["tokens"], np.uint32), np.array(row["sizes"], np.int64)
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(sizes) - sizes] = True
    return words, tokens, sizes, first, model.places(words, ends)


def _train(chunks: DataFrame, model, tasks: int) -> DataFrame:
    """Blocks of weights after one pass of every task over its chunks: (kind, block, tokens seen, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        tables = [m.weights.copy(), m.leaf_weights.copy()]
        n_leaves = tables[1].shape[1]
        grown = [np.zeros(len(t), np.float32) for t in tables]
        seen = [np.zeros(len(t), np.uint32) for t in tables]
        slot = np.zeros(len(tables[0]), np.int32)
        any_ = False
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                words, tokens, sizes, first, places = _chunk(row, m)
                train = np.repeat(~np.array(row["held"], bool), sizes)
                for at in range(0, len(tokens), STEP):
                    use = np.flatnonzero(train[at : at + STEP])
                    if not len(use):
                        continue
                    any_ = True
                    rows, before = _features(words, tokens, first, at, min(at + STEP, len(tokens)), len(tables[0]))
                    place = places[tokens[at : at + STEP][use]]
                    leaf_rows = _leaf_rows(before[use], place // n_leaves, len(tables[1]))
                    leaf_rows, kinds, alike, group = _alike(leaf_rows, place // n_leaves)
                    r = rows[:, use]
                    classes, leaves = _forward(m, tables[0], tables[1], r, leaf_rows, kinds)
                    classes[np.arange(len(use)), place // n_leaves] -= 1
                    leaves *= alike[:, None].astype(np.float32)
                    np.subtract.at(leaves.ravel(), group * n_leaves + place % n_leaves, np.float32(1))
                    # Gradients of equal rows are summed: class by class, over numbers of the rows met, and by runs of groups for leaves.
                    r = r.ravel()
                    nth = np.arange(len(r), dtype=np.int32)
                    slot[r] = nth
                    hit = r[slot[r] == nth]
                    slot[hit] = nth[: len(hit)]
                    r = slot[r]
                    count = np.bincount(r, minlength=len(hit))
                    by_class = np.ascontiguousarray(classes.T, np.float64)
                    g = np.stack([np.bincount(r, np.tile(c, 3), len(hit)) for c in by_class], axis=1).astype(np.float32)
                    starts = np.flatnonzero(np.r_[True, leaf_rows[1:] != leaf_rows[:-1]])
                    leaf_hit = leaf_rows[starts]
                    leaf_g = _sums(leaves, starts)
                    for t, where, grad, n in ((0, hit, g, count), (1, leaf_hit, leaf_g, np.add.reduceat(alike, starts))):
                        grown[t][where] += np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
                        grad *= (np.float32(RATE) / np.sqrt(grown[t][where] + np.float32(1e-2)))[:, None]
                        tables[t][where] -= grad
                        seen[t][where] += n.astype(np.uint32)
        if not any_:
            return
        for kind, (t, n) in enumerate(zip(tables, seen)):
            for block in range(len(t) // BLOCK):
                part = slice(block * BLOCK, (block + 1) * BLOCK)
                if n[part].any():  # of rows that the task has not met, their tokens (none) go alone
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([n[part].tobytes()], pa.binary()), pa.array([t[part][n[part] > 0].tobytes()], pa.binary())], names=["kind", "block", "seen", "weights"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for kind, block, n, w in zip(*(b.column(i).to_pylist() for i in range(4))):
                n = np.frombuffer(n, np.uint32).astype(np.float64)
                hit = np.flatnonzero(n)
                w = np.frombuffer(w, np.float32).reshape(len(hit), -1) * n[hit, None]
                if (kind, block) not in sums:
                    sums[kind, block] = [np.zeros(BLOCK), np.zeros((BLOCK, w.shape[1]))]
                sums[kind, block][0] += n
                sums[kind, block][1][hit] += w
        for (kind, block), (n, w) in sums.items():
            hit = n > 0
            w = (w[hit] / n[hit, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(hit).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["kind", "block", "seen", "weights"])

    schema = "kind int, block int, seen binary, weights binary"
    return chunks.mapInArrow(trimmed(run), schema).repartition(tasks, "kind", "block").mapInArrow(trimmed(average), schema)


def _score(chunks: DataFrame, model, key: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; in batches of tokens of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        n_leaves = m.leaf_weights.shape[1]
        own = n_leaves - SHARED
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                words, tokens, sizes, first, places = _chunk(row, m)
                total = np.zeros(len(words), np.int64)
                for x in row["totals"]:
                    total[_unplanes(x["at"], np.uint32)] = _unplanes(x["totals"], np.int64)
                log_base = np.log10((total + 1) / (m.n + m.v + 1))
                leaf = places % n_leaves
                shared = (leaf - own) * CLASSES + places // n_leaves
                log_word = np.where(leaf >= own, np.log10(total + 1) - m.mass[np.maximum(shared, 0)], 0.0)
                value = log_word[tokens]
                for at in range(0, len(tokens), STEP):
                    k = slice(at, at + STEP)
                    place = places[tokens[k]]
                    rows, before = _features(words, tokens, first, at, min(at + STEP, len(tokens)), len(m.weights))
                    kind = place // n_leaves
                    leaf_rows, kinds, _, group = _alike(_leaf_rows(before, kind, len(m.leaf_weights)), kind)
                    classes, leaves = _forward(m, m.weights, m.leaf_weights, rows, leaf_rows, kinds)
                    value[k] += np.log10(np.maximum(classes[np.arange(len(place)), kind].astype(np.float64) * leaves[group, place % n_leaves], 1e-30))
                starts = np.cumsum(sizes) - sizes
                out = [
                    pa.array(row["ids"], b.schema.field("ids").type.value_type), pa.array(row["held"], pa.bool_()), pa.array(sizes),
                    pa.array(np.add.reduceat((total > 0)[tokens].astype(np.int64), starts)), pa.array(np.full(len(sizes), m.n)),
                    pa.array(np.add.reduceat(log_base[tokens], starts)), pa.array(np.add.reduceat(value, starts)),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunks.mapInArrow(trimmed(run), f"doc_id {key}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def maxent_lm(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all rows of doc_id, text, by a model of those whose crc32(doc_id as text) mod 7 isn't 2.

    Words are known by 64-bit hashes. To the driver come sums over leaves, of fixed size, the most frequent words and, block
    by block, the weights, which each task gets whole: both grow with the vocabulary (sizes_for). Every training token is in one gradient step.
    Defined cases: a null or empty text is its end alone; a null doc_id counts as the empty text and trains; repeated rows
    count and are scored each; with no training text all words are unknown; an empty table gives no rows; very long texts are read
    whole; further columns, whatever their names, are ignored. How texts fall into tasks decides which gradients are averaged, so `score`
    (nothing else) may change a little where the input is partitioned otherwise.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "maxent")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first()["b"] or 0
    tasks = max(tasks, int(size * COUNTED) // TASK_BYTES)
    encoded = scratch.save(_encode(docs, tasks * 4), "encoded")
    counts = scratch.save(_count(encoded.where("part IS NOT NULL").select("chunk", "part", "at", "counted"), tasks), "counts")
    leaves = counts.where("leaf IS NOT NULL").groupBy("leaf").agg(F.sum("count").alias("count"), F.sum("known").alias("known")).collect()
    own, n_rows, leaf_rows = sizes_for(sum(r["known"] for r in leaves))
    top = counts.where("word IS NOT NULL").orderBy(F.desc("count"), "word").select("word", "count", "ending").limit(CLASSES * own).collect()
    model = _start(top, leaves)
    chunks = encoded.where("part IS NULL").select("chunk", "ids", "held", "sizes", "tokens", "words", "endings")
    # As tables grow slower than the text, tasks take more of it each: else their weights would outgrow it.
    weights = 4 * (n_rows * CLASSES + leaf_rows * (own + SHARED))
    parts = max(spark.sparkContext.defaultParallelism, SENT * WORD_CHARS * model.n // (rounds * weights))
    for r in range(rounds):
        mine = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == r).select("held", "sizes", "tokens", "words", "endings")
        sent = spark.sparkContext.broadcast(model)
        after = scratch.save(_train(mine.coalesce(parts), sent, tasks), f"weights{r}")
        sent.destroy()
        for row in after.toLocalIterator():
            into = (model.weights, model.leaf_weights)[row["kind"]][row["block"] * BLOCK : (row["block"] + 1) * BLOCK]
            hit = np.unpackbits(np.frombuffer(row["seen"], np.uint8)).astype(bool)
            into[hit] = np.frombuffer(row["weights"], np.float32).reshape(-1, into.shape[1])
        scratch.drop(f"weights{r}")
    totals = counts.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("at", "totals")).alias("totals"))
    return _score(chunks.join(totals, "chunk").drop("chunk"), spark.sparkContext.broadcast(model), docs.schema["doc_id"].dataType.simpleString())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm(table(spark, sf_dir, "documents").select("doc_id", "text"))
