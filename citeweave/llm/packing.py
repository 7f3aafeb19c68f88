"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by large-item matching.

Lengths are all that packing needs, so it is planned on the histogram of lengths: one number for each length, whatever
the input. Pieces of more than a third of the capacity pair at most twice in a sequence, matched greedily from the
longest; shorter ones go, longest first, where the least room is left. Each piece finds its place by its rank among
pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, memo, small, table, text_chunks, trimmed

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Follows each document's own ids.
END_ID = 0
#: One of these at the end of a word is a unit of its own.
_MARKS = (".", ",")
_LOWER = re.compile("[a-zß-öø-ÿ]+").fullmatch
_PLAIN = "".join(c for c in map(chr, range(256)) if c.isalnum() or c in " .,").encode("latin-1")
#: A worker forgets the words it has encoded when they hold this many characters; a third, where ids are written beside.
MEMO_CHARS = 96 << 20


def _worker(path: str):
    """Tokenizer and encoded words of this worker process, kept between tasks."""
    kept = memo("packing")
    if kept.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        closes = np.zeros(tokenizer.get_vocab_size(), bool)
        closes[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        marks = {m: np.asarray(tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in _MARKS}
        kept.update(path=path, tokenizer=tokenizer, closes=closes, marks=marks, words={}, size=0)
    return kept


def _encode_simple(cores: list[str], kept: dict, chunk: int = 20_000) -> None:
    """Encodes words of Latin-1 letters many at a time: each is one unit of the tokenizer, whose last token closes it."""
    for at in range(0, len(cores), chunk):
        some = cores[at : at + chunk]
        ids = np.asarray(kept["tokenizer"].encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(kept["closes"][ids]) + 1
        assert len(ends) == len(some) and ends[-1] == len(ids), "the tokenizer doesn't close each word"
        data, start = ids.tobytes(), 0
        for w, end in zip(some, (4 * ends).tolist()):
            kept["words"][w] = data[start:end]
            start = end


def _parts(text: str) -> list[str]:
    """The parts to be encoded each by itself. In texts of letters, digits, full stops and commas alone, and none of the
    marks side by side, a mark at a word's end is a part too: it is a unit of its own there."""
    line = text.replace("\n", " ")
    if not line.encode("latin-1", "replace").translate(None, _PLAIN) and not any(x in line for x in ("..", ",,", ".,", ",.")):
        line = line.replace(". ", " . ").replace(", ", " , ")
    return line.split(" ")


def encode(texts: list[str], path: str, memo_chars: int = MEMO_CHARS) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    No token spans white space, so a text's ids are those of the parts between spaces and newlines, and each distinct
    part is encoded once. (Only for tokenizers that drop white space, as the tests check against whole texts.)
    """
    kept = _worker(path)
    words = kept["words"]
    if kept["size"] > memo_chars:
        words.clear()
        kept["size"] = 0
    parts = [_parts(t) for t in texts]
    distinct = set().union(*parts)
    new = distinct.difference(words)
    if new:
        simple, other = [], []
        plain = [w for w in new if _LOWER(w)]
        _encode_simple(plain, kept)
        for w in new.difference(plain):
            core = w[:-1] if w[-1:] in _MARKS else w
            (simple if core.isalpha() and max(core) <= "ÿ" else other).append((w, core.lower()))
        _encode_simple(list({c for _, c in simple}.difference(words)), kept)
        for w, core in simple:
            words[w] = words[core] + kept["marks"][w[-1]] if w[-1] in _MARKS else words[core]
        for (w, _), e in zip(other, kept["tokenizer"].encode_batch_fast([w for w, _ in other], add_special_tokens=False)):
            words[w] = np.asarray(e.ids, "<u4").tobytes()
        kept["size"] += sum(map(len, new)) + 64 * len(new)
    return [b"".join(map(words.__getitem__, p)) for p in parts]


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32, part and rank (and ids, if asked for).

    part is the task and rank counts its pieces of the same length, so that both fix a place among all of them.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.asarray([END_ID], "<u4").tobytes()
        kind = None
        for keys, texts in text_chunks(batches, 1 << 20):
            rows: list[list] = [[] for _ in range(5)]
            ids = []
            for key, own in zip(keys, encode(texts, path, MEMO_CHARS // 3 if with_ids else MEMO_CHARS)):
                own += end
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    data = own[at : at + 4 * capacity]
                    for column, value in zip(rows, (key, piece, at // 4, len(data) // 4, zlib.crc32(data))):
                        column.append(value)
                    if with_ids:
                        ids.append(data)
            lengths = np.array(rows[3])
            rank = np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            found, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
            rank[order] = np.arange(len(order)) - np.repeat(first, n) + np.repeat(seen[found], n)
            seen[found] += n
            arrays = [pa.array(rows[0], kind), *(pa.array(c, t) for c, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()))), pa.array(np.full(len(rank), part), pa.int64()), pa.array(rank)]
            if with_ids:
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), values))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, rank bigint" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run, "packing"), schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(lengths with how many of each, number of sequences so filled)] for pieces of 1 to `capacity`."""
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: list[tuple[tuple[tuple[int, int], ...], int]] = []  # filled; room is what is left of one
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k < 0:
            groups.append((((a, 1),), left.pop(a)))
            large.pop()
            continue
        b = large[k]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n:
            groups.append((((a, 2),) if a == b else ((a, 1), (b, 1)), n))
        for x in (a, b):
            left[x] -= n
        if a == b and left[a]:  # the odd one; the next shorter may still join it
            if k:
                c = large[k - 1]
                groups.append((((a, 1), (c, 1)), 1))
                left[c] -= 1
            else:
                groups.append((((a, 1),), 1))
            left[a] = 0
        for x in {a, b, *large[max(k - 1, 0) : k]}:
            if x in left and not left[x]:
                del left[x]
                large.remove(x)
    room: dict[int, list[int]] = {}  # free room -> groups
    rooms: list[int] = []
    for i, (items, _) in enumerate(groups):
        free = capacity - sum(n * c for n, c in items)
        if free not in room:
            insort(rooms, free)
        room.setdefault(free, []).append(i)

    def put(group: tuple[tuple[tuple[int, int], ...], int]) -> None:
        free = capacity - sum(n * c for n, c in group[0])
        groups.append(group)
        if free not in room:
            insort(rooms, free)
        room.setdefault(free, []).append(len(groups) - 1)

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):  # no room left: as many new sequences as these fill
                each = capacity // length
                if n >= each:
                    put((((length, each),), n // each))
                if n % each:
                    put((((length, n % each),), 1))
                break
            free = rooms[k]
            items, count = groups[i := room[free].pop()]
            if not room[free]:
                del room[free]
                rooms.pop(k)
            groups[i] = ((), 0)
            each = free // length  # the same sequence stays the tightest until it takes no more
            full = min(count, n // each)
            n -= full * each
            if full:
                put(((*items, (length, each)), full))
            if full < count and n:
                put(((*items, (length, n)), 1))
                full, n = full + 1, 0
            if full < count:
                put((items, count - full))
    return [g for g in groups if g[1]]


def _places(groups) -> list[tuple[int, int, int, int, int, int]]:
    """For runs of ranks of one length: length, first and last rank, first sequence, offset and pieces in a sequence."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for items, count in groups:
        offset = 0
        for length, each in items:
            rank = used.get(length, 0)
            used[length] = rank + each * count
            rows.append((length, rank, used[length] - 1, first, offset, each))
            offset += each * length
        first += count
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of tokenise(); part and rank go.

    Bounded: the histogram has `capacity` rows, the plan a few runs for each length. Runs are broadcast, and each piece
    finds the one of its length that holds its rank.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = pieces.sparkSession.createDataFrame(_places(plan(histogram, capacity)), "_length bigint, _low bigint, _high bigint, _first bigint, _offset bigint, _each bigint")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy("part", "length").agg(F.count("*").alias("n")).select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(small(base, 64), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    keep = [c for c in pieces.columns if c not in ("part", "rank")]
    placed = ranked.join(F.broadcast(runs), F.expr("length = _length AND rank BETWEEN _low AND _high"))
    nth = "(rank - _low)"
    return placed.select(*keep, F.expr(f"_first + {nth} div _each").alias("sequence_id"), F.expr(f"_offset + {nth} % _each * length").alias("offset"))


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs doc_id, text of `docs`; of a sequence, the pieces by offset make up its ids.

    Defined cases: a null or empty text is one piece, the closing id alone; a longer document is cut into full pieces
    and a last one, however long it is; repeated rows are packed each for itself; an empty table gives no rows; further columns, whatever
    their names, are ignored.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    pieces = Scratch(docs.sparkSession, "pieces").save(tokenise(docs, path, capacity, with_ids), "pieces")
    return pack(pieces, capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents, with their ids and places; the cases of best_fit_packing() hold."""
    return best_fit_packing(docs, with_ids=True)
