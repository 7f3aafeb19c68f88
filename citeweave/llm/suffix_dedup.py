"""Suffix-array dedup: bytes of passages that occur anywhere else, found by a hash-compared suffix sort.

Of every stretch of LENGTH bytes, the place of the least hash among its GRAM-byte strings is its anchor, so equal
stretches have equal anchors, and each anchor answers for the run of stretches that chose it. Anchors with equal strings
meet, with the bytes that they answer for. Where these are the same bytes, compared one by one, all of them are repeated,
and one of each kind goes on. Kinds are sorted, to the right and to the left of the anchor, by a merge sort whose
comparisons find common extensions from prefix hashes by binary search and verify them byte by byte; a stretch is repeated
where its part on the right and its part on the left both fall together with those of another anchor. No byte is removed
for the sake of a hash alone: hashes only decide what is compared.

A string that stands in many surroundings would bring all of these together. Such strings are counted in a sample of the
texts, and an anchor with one of them is split by how many bytes of a stretch lie before it: stretches that agree have
equal cells, and all stretches of a cell share the bytes around the anchor, which take the string's place. Cells that are
still frequent are split into single stretches. The split drops no pair of equal stretches, whichever strings are split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, free_names, small, table, text_chunks, trimmed

LENGTH, GRAM = 200, 32
#: Bytes of anchors that one task holds, about; the number of tasks follows.
TASK_BYTES = 24 << 20
SOME_BYTES = 1 << 19
#: Frequent strings are looked for in one text of so many; each stands in at least so many surroundings there, and there are
#: at most so many of them.
SAMPLED, FREQUENT, MOST_FREQUENT = 64, 64, 1 << 18
#: Widths of the cells that an anchor is split into where its string is frequent, and where such a cell is.
CELLS = (22, 1)
_P = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, place, first and last stretch it answers for, hash of its string) of the anchors of texts that lie end to
    end in `data`, all places within `data`. gram: a power of two."""
    n = len(data)
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    with np.errstate(over="ignore"):
        h, step, factor = data.astype(np.uint64) + np.uint64(1), 1, _P
        while step < gram:
            h = h[: len(h) - step] * factor + h[step:]
            factor, step = factor * factor, 2 * step
    value = (_mixed(h) >> np.uint64(32)).astype(np.uint32)
    width = length - gram + 1
    at = np.arange(len(value), dtype=np.int32)
    step = 1
    while step < width:  # the least of a window is that of its two halves, which may overlap; the left one on ties
        move = min(step, width - step)
        later = value[move:] < value[: len(value) - move]
        at = np.where(later, at[move:], at[: len(at) - move])
        value = np.minimum(value[: len(value) - move], value[move:])
        step += move
    begins = np.r_[0, ends[:-1]]
    whole = np.flatnonzero(ends - begins >= length)
    count = ends[whole] - begins[whole] - length + 1
    of = np.repeat(whole, count)
    start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[whole], count)
    place = at[start]
    if not len(of):
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (of[1:] != of[:-1])])
    last = np.r_[new[1:], len(of)] - 1
    return of[new], place[new].astype(np.int64), start[new], start[last], _mixed(h[place[new]])


def split(data: bytes, found: tuple[np.ndarray, ...], frequent: np.ndarray, width: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """anchors() of `data`, those whose hash is in `frequent` (sorted) split into cells: a cell answers for the stretches that
    begin c * width to (c + 1) * width - 1 bytes before the anchor, and its hash is that of the bytes that all of these hold."""
    of, place, first, last, khash = found
    if not len(frequent) or not len(of):
        return found
    at = np.minimum(np.searchsorted(frequent, khash), len(frequent) - 1)
    some = np.flatnonzero(frequent[at] == khash)
    if not len(some):
        return found
    low, high = (place[some] - last[some]) // width, (place[some] - first[some]) // width
    count = high - low + 1
    row = np.repeat(some, count)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)) * width
    held = zip((place[row] - start).tolist(), (place[row] - start - width + 1 + length).tolist(), khash[row].tolist(), start.tolist())
    cell = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b], (k + c) & (1 << 64) - 1) for a, b, k, c in held), np.uint64, len(row))
    rest = np.ones(len(of), bool)
    rest[some] = False
    return (
        np.r_[of[rest], of[row]],
        np.r_[place[rest], place[row]],
        np.r_[first[rest], np.maximum(first[row], place[row] - start - width + 1)],
        np.r_[last[rest], np.minimum(last[row], place[row] - start)],
        np.r_[khash[rest], cell],
    )


def _anchored(raw: list[bytes], frequent: list[np.ndarray], length: int) -> tuple[bytes, np.ndarray, tuple[np.ndarray, ...]]:
    """(data, where each text begins in it, anchors), with what is frequent split level by level."""
    data = b"".join(raw)
    ends = np.cumsum([len(x) for x in raw])
    begins = np.r_[0, ends[:-1]]
    # Anchors are looked for in some texts at a time, for they take many times a text's size.
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(SOME_BYTES, len(data), SOME_BYTES)), len(ends)])
    some = [(a, begins[a], anchors(np.frombuffer(data, np.uint8)[begins[a] : ends[b - 1]], ends[a:b] - begins[a], length)) for a, b in zip(cuts[:-1], cuts[1:])]
    found = *(np.concatenate([x[k] + (at if k else a) for a, at, x in some]) for k in range(4)), np.concatenate([x[4] for _, _, x in some])
    for names, width in zip(frequent, CELLS):
        found = split(data, found, names, width, length)
    return data, begins, found


def _full(data: bytes, found: tuple[np.ndarray, ...], length: int) -> np.ndarray:
    """Hashes of all the bytes that each anchor answers for."""
    _, place, first, last, _ = found
    held = zip(first.tolist(), (last + length).tolist(), (place - first).tolist())
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b], o) for a, b, o in held), np.uint64, len(first))


class Suffixes:
    """Rows of bytes, each of its own length, in groups; sorted within each group.

    Prefix hashes are kept for every eighth byte: common extensions are searched among them, ended by comparing bytes,
    and verified by comparing all bytes before.
    """

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, group: np.ndarray):
        """group: ascending; rows: padded with zeros to a multiple of eight bytes."""
        self.rows, self.lengths, self.group = rows, lengths, group
        words = rows.reshape(len(rows), -1, _BLOCK).view(np.uint64)[:, :, 0]
        self.words = words
        hashes = np.zeros((len(rows), words.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words.shape[1]):
                hashes[:, k + 1] = hashes[:, k] * _P + _mixed(words[:, k] + np.uint64(k + 1))
        self.hashes = hashes
        self.order = self._sorted()
        lcp = np.zeros(len(rows), np.int64)
        if len(rows) > 1:
            lcp[1:] = self.extension(self.order[:-1], self.order[1:])
            lcp[1:][group[1:] != group[:-1]] = -1
        if len(rows):
            lcp[0] = -1
        self.lcp = lcp

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of rows a and b."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.words.shape[1], np.int64)
        while True:
            wide = low < high
            if not wide.any():
                break
            middle = (low + high + 1) // 2
            same = self.hashes[a, middle] == self.hashes[b, middle]
            low = np.where(wide & same, middle, low)
            high = np.where(wide & ~same, middle - 1, high)
        columns = np.arange(self.words.shape[1])
        for at in range(0, len(a), 20_000):  # verification: the hashes must not have called unequal words equal
            some = slice(at, at + 20_000)
            unequal = (self.words[a[some]] != self.words[b[some]]) & (columns < low[some, None])
            if unequal.any():
                low[some] = np.where(unequal.any(1), unequal.argmax(1), low[some])
        inside = np.minimum(low, self.words.shape[1] - 1)
        differ = (self.words[a, inside] ^ self.words[b, inside]).view(np.uint8).reshape(-1, _BLOCK) != 0
        found = low * _BLOCK + np.where(low < self.words.shape[1], np.where(differ.any(1), differ.argmax(1), _BLOCK), 0)
        return np.minimum(found, np.minimum(self.lengths[a], self.lengths[b]))

    def _less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.extension(a, b)
        ended = n == self.lengths[a]
        column = np.minimum(n, self.rows.shape[1] - 1)
        return np.where(ended, n < self.lengths[b], (n < self.lengths[b]) & (self.rows[a, column] < self.rows[b, column]))

    def _sorted(self) -> np.ndarray:
        """Bottom-up merge sort of all groups at once: a row's place is its own in its run and its rank in the other."""
        n = len(self.rows)
        order = np.arange(n)
        first = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if n else order
        size = np.diff(np.r_[first, n])
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        width = 1
        while n and width < size.max():
            live = np.flatnonzero(np.repeat(size > width, size))
            run = (live - begin[live]) // width
            other = begin[live] + (run ^ 1) * width
            low = np.minimum(other, end[live])
            high = np.minimum(other + width, end[live])
            other_at, mine, left = low.copy(), order[live], run % 2 == 0
            while True:
                wide = np.flatnonzero(low < high)
                if not len(wide):
                    break
                middle = (low[wide] + high[wide]) // 2
                theirs = order[middle]
                before = np.where(left[wide], self._less(theirs, mine[wide]), ~self._less(mine[wide], theirs))
                low[wide] = np.where(before, middle + 1, low[wide])
                high[wide] = np.where(before, high[wide], middle)
            own = live - (begin[live] + run * width)
            target = begin[live] + (run - run % 2) * width + own + (low - other_at)
            order[target] = mine
            width *= 2
        return order

    def classes(self, length: int) -> np.ndarray:
        """For each row, a number that it shares with the rows of its group that agree in `length` first bytes."""
        out = np.empty(len(self.rows), np.int64)
        out[self.order] = np.cumsum(self.lcp < length)
        return out


def repeated(group: np.ndarray, left: list[bytes], right: list[bytes], length: int = LENGTH) -> np.ndarray:
    """[row, o]: whether the stretch that has its o first bytes in left[row] and the others in right[row] is found in two
    rows of a group at that o. group: ascending. right starts at the anchor, left ends before it."""
    m = len(group)
    most = np.array([len(x) for x in left], np.int64)
    n_right = np.array([len(x) for x in right], np.int64)
    out = np.zeros((m, int(most.max(initial=0)) + 1), bool)
    if not m:
        return out

    def padded(texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
        rows = np.zeros((m, -(-max(int(sizes.max()), 1) // _BLOCK) * _BLOCK), np.uint8)
        rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
        return rows

    after = Suffixes(padded(right, n_right), n_right, group)
    before = Suffixes(padded([x[::-1] for x in left], most), most, group)
    for o in range(out.shape[1]):
        live = np.flatnonzero((most >= o) & (n_right >= length - o))
        if len(live) < 2:
            continue
        key = after.classes(length - o)[live] * (m + 1) + before.classes(o)[live]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[live[order], o] = np.r_[False, same] | np.r_[same, False]
    return out


_ANCHOR = np.dtype([("khash", "<u8"), ("full", "<u8"), ("tid", "<i8"), ("uid", "<i8"), ("place", "<u4"), ("back", "u1"), ("ahead", "u1"), ("twice", "u1")])
#: Of equal anchors, about so many meet in a task for their bytes to be compared.
MEETING = 1024


def _ids() -> tuple:
    """What a text is known by: 64 bits of one hash, and 32 of another beside its length."""
    return F.xxhash64("text").alias("tid"), F.coalesce(F.crc32(F.col("text").cast("binary")) * (1 << 31) + F.octet_length("text"), F.lit(0).cast("long")).alias("uid")


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the records, first bytes first, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _records(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(_ANCHOR.itemsize, -1).T).view(_ANCHOR).ravel()


def _by_part(khash: np.ndarray, parts: int):
    part = (khash % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    found, at = np.unique(part[order], return_index=True)
    return found, np.split(order, at[1:])


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def frequent_strings(docs: DataFrame, size: int, length: int = LENGTH) -> list[np.ndarray]:
    """For each width of CELLS, sorted hashes of the strings that are split so: of the texts whose hash SAMPLED divides (copies
    are in it together), those with at least FREQUENT different surroundings, more in larger tables: a 2^18th of all anchors,
    so that a list is of bounded size. What is split changes where anchors meet, not what is found. Without frequent strings this is one job."""
    least = max(FREQUENT, size // (length // 2) // SAMPLED // MOST_FREQUENT)
    texts = docs.where(F.octet_length("text") >= length).select(F.xxhash64("text").alias("tid"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.pmod("tid", F.lit(SAMPLED)) == 0)
    out: list[np.ndarray] = []
    for _ in CELLS:
        known = list(out)

        def strings(batches: Iterator[pa.RecordBatch], known: list[np.ndarray] = known) -> Iterator[pa.RecordBatch]:
            for _, some in text_chunks(batches, 2 << 20):
                data, _, found = _anchored([t.encode("utf-8", "surrogatepass") for t in some], known, length)
                pairs = np.unique(np.stack([found[4], _full(data, found, length)]), axis=1) if len(found[4]) else np.empty((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(pairs)], names=["khash", "full"])

        counted = texts.mapInArrow(trimmed(strings), "khash bigint, full bigint").distinct().groupBy("khash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        names = np.array([r["khash"] for r in counted.orderBy(F.desc("n"), "khash").limit(MOST_FREQUENT).collect()], np.int64).view(np.uint64)
        if not len(names):
            break
        out.append(np.sort(names))
    return out


def _find(docs: DataFrame, parts: int, tasks: int, length: int, frequent: list[np.ndarray]) -> DataFrame:
    """Rows (tid, uid, low, high) of repeated bytes, and (tid, uid, place, back, ahead, need, khash, full, m) of anchors whose
    bytes are still to be compared; m: how many have the same khash and full, alone: whether no other has this khash.

    Anchors of a chunk that answer for the same bytes are settled there and sent on once, so copies don't gather in the
    task that compares chunks.
    """
    found = "tid bigint, uid bigint, low bigint, high bigint, place bigint, back int, ahead int, need boolean, khash bigint, full bigint, m bigint, alone boolean"
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    out_schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in found.split(", ")])
    scan_schema = pa.schema([("part", pa.int32()), ("blob", pa.binary()), *out_schema])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["t", "u"]), b.column(2)], names=["k", "x"]) for b in batches)
        for ids, texts in text_chunks(named, 2 << 20):
            tids, uids = (np.array([x[c] for x in ids], np.int64) for c in "tu")
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            data, begins, found_here = _anchored(raw, frequent, length)
            of, place, first, last, khash = found_here
            if not len(of):
                continue
            rows = np.empty(len(of), _ANCHOR)
            rows["khash"], rows["tid"], rows["uid"], rows["place"] = khash, tids[of], uids[of], place - begins[of]
            rows["back"], rows["ahead"], rows["twice"] = place - first, place - last, 0
            rows["full"] = _full(data, found_here, length)
            order = np.lexsort((rows["full"], rows["khash"]))
            rows, first, last = rows[order], first[order], last[order] + length
            new = np.r_[True, (rows["khash"][1:] != rows["khash"][:-1]) | (rows["full"][1:] != rows["full"][:-1])]
            again = np.flatnonzero(~new)
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            pairs = zip(first[again].tolist(), last[again].tolist(), first[lead[again]].tolist(), last[lead[again]].tolist())
            equal = np.fromiter((data[a:b] == data[c:d] for a, b, c, d in pairs), bool, len(again))
            equal &= rows["back"][again] == rows["back"][lead[again]]
            new[again[~equal]] = True  # other bytes: a kind of its own
            twice = ~new
            twice[lead[again[equal]]] = True
            if twice.any():
                some = rows[twice]
                at = some["place"].astype(np.int64)
                # Once for all copies of a text, and to any task: these only pass through it.
                spans = np.unique(np.stack([some["tid"], some["uid"], at - some["back"], at - some["ahead"] + length]), axis=1)
                yield _batch(scan_schema, part=((np.arange(spans.shape[1]) + spans[0]) % parts).astype(np.int32), **dict(zip(("tid", "uid", "low", "high"), np.ascontiguousarray(spans))))
            rows["twice"] = twice
            rows = rows[new]
            found_parts, groups = _by_part(rows["khash"], parts)
            yield _batch(scan_schema, part=found_parts, blob=[_planes(rows[g]) for g in groups])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            blobs = b.column(1)
            held += [x for x in blobs.to_pylist() if x is not None]
            rest = b.filter(blobs.is_null())
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([rest.column(rest.schema.get_field_index(f.name)) for f in out_schema], schema=out_schema)
        if not held:
            return
        rows = np.concatenate([_records(x) for x in held])
        held.clear()
        rows = rows[np.lexsort((rows["twice"], rows["full"], rows["khash"]))]
        string = np.r_[True, rows["khash"][1:] != rows["khash"][:-1]]
        new = string | np.r_[True, rows["full"][1:] != rows["full"][:-1]]
        number, kind = np.cumsum(string) - 1, np.cumsum(new) - 1
        need = rows["twice"] == 0
        # Where others share the string and some aren't settled: these, and one of each kind.
        ask = ((np.bincount(number) > 1) & (np.bincount(number, need) > 0))[number] & (need | np.r_[True, need[:-1]] | new)
        m, kinds_ = np.bincount(kind, ask)[kind].astype(np.int64), np.bincount(number[new])[number]
        ask = np.flatnonzero(ask)
        for some in np.array_split(ask, 1 + len(ask) // 100_000):
            if len(some):
                r = rows[some]
                yield _batch(out_schema, tid=r["tid"], uid=r["uid"], place=r["place"].astype(np.int64), back=r["back"].astype(np.int32), ahead=r["ahead"].astype(np.int32), need=need[some], khash=r["khash"].view(np.int64), full=r["full"].view(np.int64), m=m[some], alone=kinds_[some] == 1)

    texts = docs.select(*_ids(), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(trimmed(scan), f"part int, blob binary, {found}").repartition(tasks, "part").mapInArrow(trimmed(meet), found)


_BODY = "part int, khash bigint, full bigint, tid bigint, uid bigint, place bigint, back int, need boolean, alone boolean, low bigint, high bigint, body binary"


def _compare(texts: DataFrame, asked: DataFrame, parts: int, tasks: int, length: int) -> DataFrame:
    """(tid, uid, low, high) of repeated bytes, of the anchors asked for, from the bytes that they answer for."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _BODY.split(", ")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {f.name: [] for f in schema if f.name not in ("part", "low", "high")}
            m, done = [], set()
            for t, u, text, asks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if (t, u) in done:  # a copy, for which _copies() answers
                    continue
                done.add((t, u))
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for a in asks.as_py():
                    m.append(a["m"])
                    rows["body"].append(raw[a["place"] - a["back"] : a["place"] - a["ahead"] + length])
                    rows["tid"].append(t)
                    rows["uid"].append(u)
                    for c in ("khash", "full", "place", "back", "need", "alone"):
                        rows[c].append(a[c])
            # Those of one kind are dealt to as many tasks as there are meetings.
            salt = np.array(rows["tid"], np.int64).view(np.uint64) % (np.array(m, np.uint64) // np.uint64(MEETING) + np.uint64(1))
            with np.errstate(over="ignore"):
                part = (_mixed(np.array(rows["full"], np.int64).view(np.uint64) + salt * _P) % np.uint64(parts)).astype(np.int32)
            yield _batch(schema, part=part, **rows)

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of those whose bytes another of their kind has; of others, and of one of each kind, the bytes go on."""
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is None:
            return
        khash, full, tid, uid, place, back, need, alone = (held.column(c).to_numpy() for c in ("khash", "full", "tid", "uid", "place", "back", "need", "alone"))
        order = np.lexsort((place, uid, tid, full, khash))
        kind = np.r_[True, (khash[order][1:] != khash[order][:-1]) | (full[order][1:] != full[order][:-1])]
        again = ~kind & np.r_[True, (tid[order][1:] == tid[order][:-1]) & (uid[order][1:] == uid[order][:-1]) & (place[order][1:] == place[order][:-1])]
        order, kind = order[~again], kind[~again]  # without copies of a text
        if not len(order):
            return
        lead = np.flatnonzero(kind)[np.cumsum(kind) - 1]
        body = held.column("body").combine_chunks()
        size = pa.compute.binary_length(body).to_numpy()
        offsets = np.r_[0, np.cumsum(size)]
        data = b"".join(body.to_pylist()) if isinstance(body, pa.ChunkedArray) else body.buffers()[2].to_pybytes()[np.frombuffer(body.buffers()[1], np.int32)[body.offset] :]
        ours, theirs = order, order[lead]
        equal = np.fromiter((data[a : a + n] == data[c : c + k] for a, n, c, k in zip(offsets[ours].tolist(), size[ours].tolist(), offsets[theirs].tolist(), size[theirs].tolist())), bool, len(order))
        equal &= back[ours] == back[theirs]
        shared = np.bincount(lead, equal, len(order)) > 1  # by place of the lead
        twice = equal & shared[lead]
        some = order[twice & need[order]]
        if len(some):
            at = place[some] - back[some]
            yield _batch(schema, part=np.zeros(len(some), np.int32), tid=tid[some], uid=uid[some], low=at, high=at + size[some])
        few = np.bincount(np.cumsum(kind) - 1)[np.cumsum(kind) - 1] <= MEETING // 4  # a kind that only met here
        on = np.flatnonzero(kind & ~(twice & alone[order] & few) | ~twice & ~kind)
        for some in np.array_split(on, 1 + len(on) // 10_000):
            if len(some):
                rows = order[some]
                part = (khash[rows].view(np.uint64) % np.uint64(parts)).astype(np.int32)
                yield _batch(schema, part=part, khash=khash[rows], tid=tid[rows], uid=uid[rows], place=place[rows], back=back[rows], need=need[rows] & ~twice[some], body=[data[offsets[r] : offsets[r] + size[r]] for r in rows])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.schema([schema.field(c) for c in ("tid", "uid", "low", "high")])
        rest = []
        for b in batches:
            low = b.column(b.schema.get_field_index("low"))
            yield pa.RecordBatch.from_arrays([b.filter(low.is_valid()).column(b.schema.get_field_index(c)) for c in span.names], schema=span)
            rest.append(b.filter(low.is_null()))
        held = pa.Table.from_batches(rest) if rest else None
        if held is None or not held.num_rows:
            return
        khash, tid, uid, place, back = (held.column(c).to_numpy() for c in ("khash", "tid", "uid", "place", "back"))
        order = np.argsort(khash, kind="stable")
        number = np.cumsum(np.r_[True, khash[order][1:] != khash[order][:-1]]) - 1
        need, body = held.column("need"), held.column("body")
        start = 0
        while start < len(order):  # whole groups, some thousands of rows at a time
            end = min(start + 8192, len(order))
            end = int(np.searchsorted(number, number[end - 1], "right"))
            some = order[start:end]
            bodies = body.take(pa.array(some)).to_pylist()
            hits = repeated(number[start:end], [x[:k] for x, k in zip(bodies, back[some])], [x[k:] for x, k in zip(bodies, back[some])], length)
            hits &= np.asarray(need.take(pa.array(some)))[:, None]
            edge = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, first = np.nonzero(edge == 1)
            last = np.nonzero(edge == -1)[1] - 1
            if len(row):
                rows = some[row]
                yield _batch(span, tid=tid[rows], uid=uid[rows], low=place[rows] - last, high=place[rows] - first + length)
            start = end

    bodies = texts.join(asked, ["tid", "uid"]).select("tid", "uid", "text", "asks").mapInArrow(trimmed(cut), _BODY).repartition(tasks, "part")
    return bodies.mapInArrow(trimmed(same), _BODY).repartition(tasks, "part").mapInArrow(trimmed(settle), "tid bigint, uid bigint, low bigint, high bigint")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each text's spans: sorted by their starts, one opens a run where it starts after all before it have ended."""
    for b in batches:
        rows = []
        for spans in b.column(2).to_pylist():
            x = np.array(sorted((s["low"], s["high"]) for s in spans), np.int64)
            high = np.maximum.accumulate(x[:, 1])
            new = np.flatnonzero(np.r_[True, x[1:, 0] > high[:-1]])
            rows.append([{"low": a, "high": b} for a, b in zip(x[new, 0].tolist(), high[np.r_[new[1:], len(x)] - 1].tolist())])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], names=["tid", "uid", "spans"])


def _copies(texts: DataFrame) -> DataFrame:
    """(tid, uid, low, high): all bytes of texts that are there more than once, if the least of them is the greatest too."""
    several = texts.groupBy("tid", "uid").agg(F.count("*").alias("n")).where("n > 1").select("tid", "uid")
    once = texts.join(small(several, 48), ["tid", "uid"], "left_semi").groupBy("tid", "uid").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return once.where("low = high").select("tid", "uid", F.lit(0).cast("long").alias("low"), F.octet_length("high").cast("long").alias("high"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, uid, spans): of each text with repeated bytes, by its hashes (_ids), their maximal runs [low, high) in order."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    size = docs.select(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size * 2 // 5 // TASK_BYTES)
    found = scratch.save(_find(docs, 4 * tasks, tasks, length, frequent_strings(docs, size, length)), "found")
    asked = found.where("low IS NULL").groupBy("tid", "uid").agg(F.collect_list(F.struct("place", "back", "ahead", "need", "khash", "full", "m", "alone")).alias("asks"))
    texts = docs.where(F.octet_length("text") >= length).select(*_ids(), F.col("text").cast("string").alias("text"))
    tasks = max(tasks, 2 * size // TASK_BYTES)  # stretches overlap, so all of them may take five times the bytes
    edges = scratch.save(_compare(texts, asked, 4 * tasks, tasks, length), "edges")
    spans = found.where("low IS NOT NULL").select("tid", "uid", "low", "high").union(edges).union(_copies(texts))
    lists = spans.groupBy("tid", "uid").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    out = scratch.save(lists.mapInArrow(trimmed(_merge), "tid bigint, uid bigint, spans array<struct<low: bigint, high: bigint>>"), "spans")
    scratch.drop("found", "edges")
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of `docs` (with a column text) and, last, a struct of n_bytes, spans (removed runs of bytes, [low, high)),
    kept (text of the remaining bytes; a character cut in two goes) and kept_sha256 (of the remaining bytes). It is named
    _dedup, or with underscores more where `docs` has such a column.

    Every byte is removed that lies in `length` bytes that also start anywhere else, in any text or the same one; texts
    are judged as they come in. Defined cases: a null text counts as empty and has a null kept; shorter texts lose
    nothing; of repeated rows each repeats the others; overlapping repeats count (a run of one letter is removed whole);
    very long texts are judged whole; an empty table gives no rows; other columns pass through, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "cuts")
    spans = repeated_spans(docs.select("text"), length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, digest = [], []
            for text, runs in zip(b.column(3), b.column(2)):
                raw, parts, end = text.as_py().encode("utf-8", "surrogatepass"), [], 0
                for r in runs.as_py():
                    parts.append(raw[end : r["low"]])
                    end = r["high"]
                parts.append(raw[end:])
                digest.append(hashlib.sha256(b"".join(parts)).hexdigest())
                kept.append("".join(p.decode("utf-8", "ignore") for p in parts))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(kept, pa.string()), pa.array(digest, pa.string())], names=["tid", "uid", "spans", "kept", "kept_sha256"])

    runs = "array<struct<low: bigint, high: bigint>>"
    texts = docs.where(F.octet_length("text") >= length).select(*_ids(), F.col("text").cast("string").alias("text"))
    once = texts.groupBy("tid", "uid").agg(F.first("text").alias("text"))  # copies fall together before they are sent
    cuts = once.join(spans, ["tid", "uid"]).select("tid", "uid", "spans", "text").mapInArrow(trimmed(cut), f"tid bigint, uid bigint, spans {runs}, kept string, kept_sha256 string")
    cuts = scratch.save(cuts, "cuts").withColumnRenamed("tid", "_tid").withColumnRenamed("uid", "_uid")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_ids())
    joined = own.join(cuts, (F.col("tid") == F.col("_tid")) & (F.col("uid") == F.col("_uid")), "left")
    text, whole = F.col("_row.text").cast("string"), F.col("_tid").isNull()
    out = F.struct(
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce("spans", F.expr(f"cast(array() as {runs})")).alias("spans"),
        F.when(whole, text).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    return joined.select(*[F.col(f"_row.`{c}`") for c in docs.columns], out.alias(*free_names(docs, "_dedup")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "_dedup.n_bytes",
        F.expr("aggregate(_dedup.spans, 0L, (a, s) -> a + s.high - s.low)").alias("n_removed"),
        F.expr("bigint(size(_dedup.spans))").alias("n_spans"),
        "_dedup.kept_sha256",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages go from the texts; no document goes, one of which nothing stays has an empty text.
    n_chars follows the text. The cases of suffix_dedup() hold."""
    out = suffix_dedup(docs)
    kept = F.col(out.columns[-1])["kept"]
    columns = {"text": kept}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length(kept).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])
