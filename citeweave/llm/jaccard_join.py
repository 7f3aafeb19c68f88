"""N-gram Jaccard join: sets of word shingles, joined by PartEnum signatures, every link kept.

Sizes fall into bands within which sufficiently similar sets differ in at most k elements. The domain of hashed
shingles is cut into n1 > k / 2 parts, each into 3 cells, and of each part all pairs of cells are enumerated: two sets
that differ in at most k elements have a part with at most one difference, so they share the signature of a pair of its
cells. (For small sets, n1 > k parts are taken whole: one of them is without any difference.) Candidates that share a signature are verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import LOWER, Scratch, UPPER, forget, free_names, memo, small, table, text_chunks, trimmed
from citeweave.operators.components import connected_components

#: A worker forgets word hashes when it holds this many.
MEMO_WORDS = 250_000
#: Bytes of a row of ids as it is broadcast (see common.small).
KEY_BYTES = 40
#: Buckets of more sets are cut before all their sketches are compared; so often at the most by signatures.
BUCKET, LEVELS = 1024, 3
#: Up to so many sets with one signature are tested pair by pair; of more in a chunk, one is sent to other chunks' sets.
LOCAL = 16
#: Bytes of signatures that one task of the join holds, about; the number of tasks follows.
TASK_BYTES = 8 << 20
_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_M1, _M2, _G = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = memo("words").setdefault("known", {})
    if len(known) > MEMO_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of all words together, if there are fewer; empty without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()  # bytes.split: exactly the white space meant
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out) * np.uint64(0x100000001B3) + h[k : len(h) - n + 1 + k]
    return np.unique(mix(out))


class PartEnum:
    """Signatures of sets for a similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.last = num, den, [0]  # last sizes of bands
        self.schemes: dict[int, tuple[int, int, int]] = {}

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        """Band of each size, from 1; similar sets are in the same band or in neighbours."""
        while self.last[-1] < 2 * int(sizes.max(initial=1)):
            self.last.append((self.last[-1] + 1) * self.den // self.num)
        return np.searchsorted(np.array(self.last), sizes, "left")

    def scheme(self, band: int) -> tuple[int, int, int]:
        """(differences k, parts n1, cells n2 of a part) for the sets of this band and the one below.

        n1 is the least for which the smallest of these sets has, but for four standard deviations, more than enough parts
        that aren't empty; where three cells to a part can't give that, as for small sets, parts are whole.
        """
        if band not in self.schemes:
            k = 2 * (self.den - self.num) * self.last[band] // (self.den + self.num)
            size = self.last[max(band - 2, 0)] + 1
            self.schemes[band] = (k, 0, 0)
            for n2, differ in ((3, 2), (1, 1)) if k else ():
                n1 = np.arange(k // differ + 1, max(2 * k, 6 * size) + 8)
                p = np.exp(-size / (n2 * n1))
                void = 3 * p * p * (1 - p) + p**3 if n2 == 3 else p
                sure = n1 * (1 - void) - 4 * np.sqrt(n1 * void * (1 - void)) > k // differ
                if sure.any() and (n2 == 1 or n1[sure][0] <= k):
                    self.schemes[band] = (k, int(n1[sure][0]), n2)
                    break
            else:
                if k:
                    self.schemes[band] = (k, 4 * k + 8, 1)
        return self.schemes[band]

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the set, signature), of each set in two instances: with the band below its own, and the one above.

        A part of which two cells (or the only one) are without elements tells nothing, so it is left out, but for sets in
        which too few parts are left to be sure; these also sign their empty cells, and so find each other.
        """
        sizes = np.array([len(s) for s in sets], np.int64)
        own = self.bands(sizes)
        which, signed = [], []
        for up in (0, 1):
            schemes = np.array([self.scheme(int(b) + up) for b in own], np.int64).reshape(-1, 3)
            for n2 in (3, 1):
                use = np.flatnonzero((sizes > 0) & (schemes[:, 0] > 0) & (schemes[:, 2] == n2))
                if len(use):
                    of, value = self._instance([sets[i] for i in use], own[use] + up, schemes[use, 0], schemes[use, 1], n2)
                    which.append(use[of])
                    signed.append(value)
        if not which:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate(which), np.concatenate(signed)

    @staticmethod
    def _instance(sets: list[np.ndarray], band: np.ndarray, k: np.ndarray, n1: np.ndarray, n2: int) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        elements = np.concatenate(sets)
        base = np.concatenate([[0], np.cumsum(n2 * n1)])
        with np.errstate(over="ignore"):
            # Sorted hashes fall into ascending cells, so each cell is a run.
            cell = base[of] + ((elements >> np.uint64(32)) * (n2 * n1[of]).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sums, filled = np.zeros(base[-1], np.uint64), np.zeros(base[-1], bool)
            sums[cell[starts]] = np.add.reduceat(mix(elements ^ _M2), starts)
            filled[cell[starts]] = True
            sums, filled = sums.reshape(-1, n2), filled.reshape(-1, n2)
            part_of = np.repeat(np.arange(len(sets)), n1)
            part = np.arange(len(part_of)) - np.repeat(base[:-1] // n2, n1)
            differ = 2 if n2 == 3 else 1
            solid = np.bincount(part_of[filled.sum(1) >= differ], minlength=len(sets))
            unsure = (solid <= k // differ)[part_of]
            seed = mix(mix(band[part_of].astype(np.uint64)) + part.astype(np.uint64))
            which, signed = [], []
            for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)) if n2 == 3 else ((0, 0),)):
                take = filled[:, a] | filled[:, b] | unsure
                which.append(part_of[take])
                signed.append(mix(mix(seed[take] + np.uint64(number)) + mix(sums[take, a]) * _M1 + sums[take, b]))
        return np.concatenate(which), np.concatenate(signed)


def _packed(signed: np.ndarray, key: np.ndarray, hot: np.ndarray) -> bytes:
    """Signatures (their lower seven bytes, first bytes first, which compresses better) by key, and flags."""
    order = np.argsort(key, kind="stable")
    keys, counts = np.unique(key, return_counts=True)
    head = np.array([len(keys), len(key)], np.uint32).tobytes()
    planes = np.ascontiguousarray(signed[order].view(np.uint8).reshape(-1, 8)[:, :7].T).tobytes()
    return head + keys.tobytes() + counts.astype(np.uint32).tobytes() + planes + np.packbits(hot[order]).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_keys, n = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    keys = np.frombuffer(data, np.int64, n_keys, 8)
    counts = np.frombuffer(data, np.uint32, n_keys, 8 + 8 * n_keys)
    at = 8 + 12 * n_keys
    signed = np.zeros((n, 8), np.uint8)
    signed[:, :7] = np.frombuffer(data, np.uint8, 7 * n, at).reshape(7, n).T
    return signed.view(np.uint64).ravel(), np.repeat(keys, counts), np.unpackbits(np.frombuffer(data, np.uint8, offset=at + 7 * n), count=n).astype(bool)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities, of elements by hash, as eight 64-bit words: two sets differ in as many elements as their bits, at least."""
    bits = np.bincount(mix(elements + _M1) >> np.uint64(55), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(elements: np.ndarray) -> np.ndarray | None:
    """A sketch of half as many bits as elements, or up to all, for sets so large that one of 512 bits can't tell strangers apart:
    these differ in half of the bits. The halves of a sketch, one xored to the other, are the sketch of half the length."""
    if len(elements) <= 1024:
        return None
    most = 1 << (len(elements) - 1).bit_length() - 1
    bits = np.bincount(mix(elements + _M1) & np.uint64(most - 1), minlength=most) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def folded(wide: np.ndarray, words: int) -> np.ndarray:
    """Wide sketches (last axis) as sketches of so many words."""
    return np.bitwise_xor.reduce(wide.reshape(*wide.shape[:-1], -1, words), axis=-2)


def _rows(names: list[str], schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], schema.field(c).type) if c in columns else pa.nulls(n, schema.field(c).type) for c in names], names=names)


def _scan(docs: DataFrame, width: int, num: int, den: int, tasks: int) -> DataFrame:
    """Rows of documents (doc_id, tid, key, n, sketch, wide), of pairs that share a signature with few others (key, other), and of
    signatures that many sets share (sig, key, and n, for how many signatures it stands).

    A signature that many sets of a chunk share is sent on once for the chunk, and its members beside it, so a group of
    copies doesn't gather in the task that compares chunks.
    """
    key_type = docs.schema["doc_id"].dataType
    # One number for each task, that Spark's partitioner deals to it, so that no task gets two shares.
    number = docs.sparkSession.range(40 * tasks).select(F.col("id").cast("int").alias("id"))
    numbers = number.groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect()
    numbers = np.array([r["id"] for r in numbers], np.int32)
    parts = len(numbers)
    names = ["part", "doc_id", "tid", "key", "n", "sig", "other", "sketch", "wide", "blob"]
    ddl = f"part int, doc_id {key_type.simpleString()}, tid bigint, key bigint, n bigint, sig bigint, other bigint, sketch array<bigint>, wide array<bigint>, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enum, schema = PartEnum(num, den), None

        def pairs():
            nonlocal schema
            for b in batches:
                schema = schema or pa.schema([("part", pa.int32()), ("doc_id", b.schema.field(0).type), ("tid", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("other", pa.int64()), ("sketch", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64())), ("blob", pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["d", "t"]), b.column(2)], names=["k", "t"])

        for ids, texts in text_chunks(pairs(), 1 << 20):
            sets = [shingle_set(t, width) for t in texts]
            keys = [set_key(s) if len(s) else None for s in sets]
            with np.errstate(over="ignore"):
                sketches = [sketch(s) if len(s) else None for s in sets]
                wide = [wide_sketch(s) for s in sets]
            yield _rows(names, schema, part=numbers[[x["t"] % parts if x["t"] is not None else 0 for x in ids]], doc_id=[x["d"] for x in ids], tid=[x["t"] for x in ids], key=keys, n=[len(s) for s in sets], sketch=sketches, wide=wide)
            first = {k: s for k, s in zip(keys, sets) if k is not None}
            which, signed = enum.signatures(list(first.values()))
            if not len(which):
                continue
            key = np.fromiter(first, np.int64, len(first))[which]
            signed &= np.uint64((1 << 56) - 1)
            order = np.lexsort((key, signed))
            signed, key = signed[order], key[order]
            new = np.flatnonzero(np.r_[True, signed[1:] != signed[:-1]])
            size = np.diff(np.r_[new, len(signed)])
            hot = np.repeat(size > LOCAL, size)
            if hot.any():
                yield _rows(names, schema, part=numbers[(signed[hot] % np.uint64(parts)).astype(np.int64)], key=key[hot], n=np.ones(int(hot.sum()), np.int64), sig=signed[hot].view(np.int64))
            send = ~hot
            send[new] = True
            signed, key, hot = signed[send], key[send], hot[send]
            part = (signed % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            found, at = np.unique(part[order], return_index=True)
            yield _rows(names, schema, part=numbers[found], blob=[_packed(signed[g], key[g], hot[g]) for g in np.split(order, at[1:])])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        out = [c for c in names if c not in ("part", "blob")]
        for b in batches:
            blobs = b.column(b.schema.get_field_index("blob"))
            held += [x for x in blobs.to_pylist() if x is not None]
            rest = b.filter(blobs.is_null())
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([rest.column(rest.schema.get_field_index(c)) for c in out], names=out)
            schema = b.schema
        if not held:
            return
        signed, key, hot = (np.concatenate(c) for c in zip(*map(_unpacked, held)))
        held.clear()
        order = np.lexsort((key, signed))
        signed, key, hot = signed[order], key[order], hot[order]
        keep = np.r_[True, (signed[1:] != signed[:-1]) | (key[1:] != key[:-1])]
        new = np.flatnonzero(np.r_[True, signed[1:] != signed[:-1]])
        hot = np.logical_or.reduceat(hot, new)
        signed, key = signed[keep], key[keep]
        size = np.add.reduceat(keep.astype(np.int64), new)
        new = np.cumsum(size) - size
        # Small buckets go on as their pairs, each once.
        pairs = []
        for m in range(2, LOCAL + 1):
            at = new[(size == m) & ~hot]
            if len(at):
                i, j = np.triu_indices(m, 1)
                members_ = key[at[:, None] + np.arange(m)]
                pairs.append(np.stack([members_[:, i].ravel(), members_[:, j].ravel()]))
        if pairs:
            pairs = np.concatenate(pairs, axis=1)
            pairs = pairs[:, np.lexsort(pairs)]
            pairs = pairs[:, np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(0)]]
            for at in range(0, pairs.shape[1], 100_000):
                yield _rows(out, schema, key=pairs[0, at : at + 100_000], other=pairs[1, at : at + 100_000])
        # Of the large ones with the same sets, one is sent on, but all of those that chunks have sent members of beside.
        with np.errstate(over="ignore"):
            same = np.add.reduceat(mix(key.view(np.uint64)), new)
        cold = np.flatnonzero((size > LOCAL) & ~hot)
        _, first, times = np.unique(same[cold], return_index=True, return_counts=True)
        weight = np.zeros(len(new), np.int64)
        weight[hot] = 1
        weight[cold[first]] = times
        weight = np.repeat(weight, size)
        out_rows = np.flatnonzero(weight > 0)
        for at in range(0, len(out_rows), 100_000):
            some = out_rows[at : at + 100_000]
            yield _rows(out, schema, key=key[some], n=weight[some], sig=signed[some].view(np.int64))

    texts = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(trimmed(run, "words"), ddl).repartition(tasks, "part").mapInArrow(trimmed(meet), f"doc_id {key_type.simpleString()}, tid bigint, key bigint, n bigint, sig bigint, other bigint, sketch array<bigint>, wide array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, s): the shingle set, as bytes, of each of the wanted (tid); one text for each key is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches, 1 << 20):
            sets = [s for s in (shingle_set(t, width) for t in texts) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "s"])

    return _texts(docs, wanted).mapInArrow(trimmed(run, "words"), "key bigint, s binary").dropDuplicates(["key"])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tid, text) of the wanted (tid)."""
    return docs.select(F.xxhash64("text").alias("tid"), F.col("text").cast("string").alias("text")).join(small(wanted, KEY_BYTES), "tid", "left_semi")


def _signs(docs: DataFrame, wanted: DataFrame, width: int, num: int, den: int, seed: int) -> DataFrame:
    """(key, sign): the signatures of each of the wanted (tid) under a division of the domain that `seed` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enum = PartEnum(num, den)
        for _, texts in text_chunks(batches, 1 << 20):
            found = {set_key(s): s for s in (shingle_set(t, width) for t in texts) if len(s)}
            with np.errstate(over="ignore"):
                which, signed = enum.signatures([np.sort(mix(s + np.uint64(seed) * _M2)) for s in found.values()])
            key = np.fromiter(found, np.int64, len(found))[which]
            for at in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 100_000]), pa.array(signed[at : at + 100_000].view(np.int64))], names=["key", "sign"])

    return _texts(docs, wanted).mapInArrow(trimmed(run, "words"), "key bigint, sign bigint").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of (a, b), those with den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                if den * len(s) < num * len(t):
                    keep.append(False)
                    continue
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("key").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(trimmed(run), "a bigint, b bigint")


def _candidates(rows: DataFrame, most: int, num: int, den: int) -> DataFrame:
    """(a, b, sig) of the rows (sig, key, n, sketch, label, wide) of buckets: for each set, the nearest `most` of its bucket, by
    sketches, that have another label and that sizes and sketches don't rule out. Rows without b name the sets (a) of a
    bucket that had more of them, and those that they had."""

    def group(sig: int, key: np.ndarray, n: np.ndarray, bits: np.ndarray, label: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
        out, more = [], np.zeros(len(key), bool)
        large: dict[int, list[int]] = {}
        for i, w in enumerate(wide):
            if w is not None:
                large.setdefault(len(w), []).append(i)
        alike = [(words, np.array(of), np.stack([wide[i] for i in of])) for words, of in large.items()]
        step = max(1, (1 << 19) // len(key))
        for at in range(0, len(key), step):
            some = slice(at, at + step)
            far = np.zeros((len(key[some]), len(key)), np.int64)
            for k in range(bits.shape[1]):
                far += np.bitwise_count(bits[some, k, None] ^ bits[None, :, k])
            m = n[some, None]
            fit = (far <= (den - num) * (m + n) // (den + num)) & (den * np.minimum(m, n) >= num * np.maximum(m, n)) & (label[some, None] != label)
            for i in np.flatnonzero(fit.any(1)) if alike else ():
                if (own := wide[i + at]) is None:
                    continue
                for words, of, sketches in alike:
                    if len(some_of := of[fit[i, of]]):
                        least = min(words, len(own))
                        apart = np.bitwise_count(folded(own, least) ^ folded(sketches[fit[i, of]], least)).sum(1, dtype=np.int64)
                        fit[i, some_of] = apart <= (den - num) * (n[i + at] + n[some_of]) // (den + num)
            if len(key) > most and (over := fit.sum(1) > most).any():
                more[some] |= over
                more |= fit[over].any(0)
                nearest = np.argpartition(np.where(fit, far, 1 << 30), most - 1, axis=1)[:, :most]
                near = np.zeros_like(fit)
                np.put_along_axis(near, nearest, True, 1)
                fit &= near
            i, j = np.nonzero(fit)
            out.append(np.stack([np.minimum(key[i + at], key[j]), np.maximum(key[i + at], key[j])]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        a, b = pa.array(np.r_[pairs[0], key[more]]), pa.concat_arrays([pa.array(pairs[1]), pa.nulls(int(more.sum()), pa.int64())])
        return pa.RecordBatch.from_arrays([a, b, pa.array(np.full(len(a), sig))], names=["a", "b", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            sig, key, n, label = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
            bits = batch.column(3).flatten().to_numpy().view(np.uint64).reshape(len(sig), -1)
            wide = np.empty(len(sig), object)
            wide[:] = [None if w.values is None else w.values.to_numpy().view(np.uint64) for w in batch.column(5)]
            new = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            for low, high in zip(new, np.r_[new[1:], len(sig)]):
                if held and held[0][0][0] != sig[low]:
                    yield group(int(held[0][0][0]), *(np.concatenate(c) for c in list(zip(*held))[1:]))
                    held = []
                held.append([x[low:high] for x in (sig, key, n, bits, label, wide)])
        if held:
            yield group(int(held[0][0][0]), *(np.concatenate(c) for c in list(zip(*held))[1:]))

    dealt = rows.select("sig", "key", "n", "sketch", "label", "wide").repartition("sig").sortWithinPartitions("sig")
    return dealt.mapInArrow(trimmed(run), "a bigint, b bigint, sig bigint")


class _State:
    """Links and classes found so far, and the pairs tested for them."""

    def __init__(self, docs: DataFrame, scratch: Scratch, members: DataFrame, width: int, num: int, den: int):
        self.spark, self.docs, self.scratch, self.width, self.num, self.den, self.i = docs.sparkSession, docs, scratch, width, num, den, 0
        first = members.where("key IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), F.min("tid").alias("tid"))
        self.known = scratch.save(first, "known")
        self.links = self.spark.createDataFrame([], "a bigint, b bigint")
        self.tested, self.label = self.links, self.spark.createDataFrame([], "node bigint, component bigint")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a < b) but those that their sizes and sketches rule out."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for side in "ab":
            pairs = pairs.join(self.known.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"), F.col("wide").alias(f"w{side}")), side)
        bits = " + ".join(f"bit_count(sa[{k}] ^ sb[{k}])" for k in range(8))
        fit = f"{self.den} * least(na, nb) >= {self.num} * greatest(na, nb) AND {bits} <= {self.den - self.num} * (na + nb) div {self.den + self.num}"
        least = "least(size(wa), size(wb))"
        half = lambda w: f"aggregate(sequence(0, size({w}) div {least} - 1), 0L, (x, q) -> x ^ {w}[k + q * {least}])"
        apart = f"aggregate(sequence(0, {least} - 1), 0, (s, k) -> s + bit_count({half('wa')} ^ {half('wb')}))"
        far = f"CASE WHEN wa IS NULL OR wb IS NULL THEN false ELSE {apart} > {self.den - self.num} * (na + nb) div {self.den + self.num} END"
        return pairs.where(fit).where(f"NOT ({far})").select("a", "b")

    def test(self, pairs: DataFrame, judged: bool = False) -> None:
        """Verifies the distinct pairs (a < b, if `judged` by near() or its like) that weren't before, and joins the classes of those linked."""
        self.i += 1
        new = pairs.toDF("a", "b") if judged else self.near(pairs.toDF("a", "b"))
        new = self.scratch.save(new.join(self.tested, ["a", "b"], "left_anti") if self.i > 1 else new, f"pairs{self.i}")
        self.tested = self.tested.union(new)
        if new.isEmpty():
            return
        keys = new.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        wanted = self.scratch.save(self.known.join(keys, "key", "left_semi").select("tid"), f"wanted{self.i}")
        sets = self.scratch.save(_sets(self.docs, wanted, self.width), f"sets{self.i}")
        found = self.scratch.save(_verify(new, sets, self.num, self.den), f"links{self.i}")
        self.scratch.drop(f"sets{self.i}", f"wanted{self.i}")
        if not found.isEmpty():
            self.links = self.links.union(found)
            # Classes that are known already stand for their links.
            edges = self.label.toDF("a", "b").where("a <> b").union(found)
            name = f"labels{self.i}"
            labels = self.scratch.save(connected_components(edges, self.scratch.save, self.scratch.drop), name)
            for old in self.scratch.names("labels") - {name} | self.scratch.names("cc"):
                self.scratch.drop(old)
            self.label = labels
        forget(self.spark)

    def labelled(self, rows: DataFrame) -> DataFrame:
        joined = rows.drop("label").join(self.label.select(F.col("node").alias("key"), F.col("component").alias("label")), "key", "left")
        return joined.withColumn("label", F.coalesce("label", "key"))

    def _mixed(self, rows: DataFrame, *more: Column) -> DataFrame:
        """(sig, m and more) of the buckets (sig, key) that hold several classes."""
        return self.labelled(rows).groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), *more).where("lo <> hi").drop("lo", "hi")

    def open(self, rows: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
        """Rows of buckets (sig, key) that hold several classes, with their class as label, the bucket's size m and, if given, its hub."""
        mixed = self._mixed(rows)
        return self.labelled(rows).drop("m").join(mixed.join(hubs, "sig") if hubs else mixed, "sig")

    def settle(self, rows: DataFrame, pairs: DataFrame) -> None:
        """Finds what is linked among the pairs (key, other), and in the buckets (sig, key) of many sets.

        First all are held against the set of each that shares most with others, its hub, which makes one class of a group
        of copies. Buckets that still hold several classes are merged by their hubs (_merged), and all sketches compared: the nearest eight of each set are
        tested, then, of sets that have more, 64, and so on until none has. A bucket of over BUCKET sets is cut first: if BUCKET at most
        are of other classes than its largest, into blocks of that class, each beside all of the others. Else by signatures
        of another division of the domain; and where that was done LEVELS times, into blocks that meet each other.
        """
        for level in range(LEVELS + 2):
            rows = self._hubs(rows, level, None if level else pairs) if level <= LEVELS else self.scratch.save(self.open(rows), f"open{level}")
            if rows.isEmpty():
                break
            if level > LEVELS:
                self._compare(rows, level)
                break
            few = self._merged(rows.where(f"m <= {BUCKET}"), f"few{level}", f"u <= {BUCKET}").select("sig", "key")
            wide = rows.where(f"m > {BUCKET}")
            if wide.isEmpty():
                self._compare(few, level)
                break
            led = self.scratch.save(wide.transform(self._others).where(f"others <= {BUCKET}"), f"led{level}_open")
            led = self._merged(led, f"led{level}", f"o <= {BUCKET}", "top")
            self._compare(few.union(self._led(led)), level)
            rest = self.scratch.save(self.open(wide).transform(self._others).where(f"others > {BUCKET}"), f"rest{level}_open")
            if rest.isEmpty():
                break
            rest = self._merged(rest, f"rest{level}")
            if level < LEVELS:
                signs = _signs(self.docs, self.scratch.save(self.known.join(rest.select("key").distinct(), "key", "left_semi").select("tid"), f"signed{level}"), self.width, self.num, self.den, level + 1)
                rows = rest.join(self.scratch.save(signs, f"signs{level}"), "key").select(F.xxhash64("sig", "sign").alias("sig"), "key")
            else:
                blocks = rest.withColumn("k", F.expr(f"m div {BUCKET} + 1")).withColumn("c", F.expr("pmod(xxhash64(key), k)"))
                rows = blocks.withColumn("o", F.explode(F.expr("sequence(0L, k - 1)"))).select(F.expr("xxhash64(sig, least(c, o), greatest(c, o))").alias("sig"), "key").distinct()
        for name in self.scratch.names("open", "hubs", "buckets", "few", "led", "rest", "signs", "signed", "rows", "found"):
            self.scratch.drop(name)

    def _others(self, rows: DataFrame) -> DataFrame:
        """Rows of open buckets with the largest class of each (top) and how many sets it has of others."""
        top = rows.groupBy("sig", "label").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max_by("label", F.struct("n", "label")).alias("top"), (F.sum("n") - F.max("n")).alias("others"))
        return rows.join(top, "sig")

    def _merged(self, rows: DataFrame, name: str, fit: str = "true", *by: str) -> DataFrame:
        """The rows, those of all buckets with the same hub (and `by`) as one bucket's, where this makes no more pairs of sets, in sum, than
        the buckets do, and `fit` holds of it: u sets, of which o have another label than top. Merged buckets are merged once more,
        by the set that is in most of them.

        A passage that many sets share gives them many signatures, whose buckets hold nearly the same sets: each of these would
        find the same candidates again. Rows meet their hubs once in each turn, and what is known of hubs isn't dealt by them, as
        one may lead most rows.
        """
        other = F.count(F.expr("CASE WHEN label <> top THEN 1 END")) if by else F.lit(0)
        by = ("hub", *by)
        for turn in range(2):
            if turn:
                ranked = rows.join(rows.groupBy("key").agg(F.count("*").alias("all")), "key")
                rows = self.scratch.save(rows.join(ranked.groupBy("sig").agg(F.max_by("key", F.struct("all", "key")).alias("hub")), "sig"), f"{name}_hubs")
            sets = rows.select(*by, "key", "label").distinct().groupBy(*by).agg(F.count("*").alias("u"), other.alias("o"))
            pairs = rows.groupBy(*by, "sig").agg(F.max("m").alias("m")).groupBy(*by).agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
            joint = self.scratch.save(sets.join(pairs, [*by]).where("u * u <= pairs").where(fit).select(*by, "u"), f"{name}_joint{turn}")
            each = rows.join(small(joint, KEY_BYTES), [*by], "left").withColumn("m", F.coalesce("u", "m"))
            sig = F.when(F.col("u").isNull(), F.col("sig")).otherwise(F.xxhash64(F.lit(f"{name} {turn}"), *by))
            rows = self.scratch.save(each.select(sig.alias("sig"), "key", "label", "m", *by[1:]).distinct(), f"{name}_{turn}")
        return rows

    def _led(self, led: DataFrame) -> DataFrame:
        """(sig, key) of the blocks of large buckets that hold few sets besides their largest class (top)."""
        led = led.withColumn("k", F.expr(f"m div {BUCKET} + 1"))
        block = F.expr("if(label = top, array(pmod(xxhash64(key), k)), sequence(0L, k - 1))")
        return led.withColumn("c", F.explode(block)).select(F.xxhash64("sig", "c").alias("sig"), "key")

    def _hubs(self, rows: DataFrame, level: int, pairs: DataFrame | None) -> DataFrame:
        """Tests `pairs`, and the sets of each bucket against its hub; returns the rows of buckets that stay open, with their hubs."""
        # Signatures with the same members are one bucket.
        once = self._mixed(rows, F.bit_xor(F.xxhash64("key")).alias("h")).groupBy("m", "h").agg(F.min("sig").alias("sig"), F.sum("m").alias("weight")).select("sig", "weight")
        buckets = self.scratch.save(rows.select("sig", "key").join(once, "sig"), f"buckets{level}")
        ranked = buckets.join(buckets.groupBy("key").agg(F.sum("weight").alias("all")), "key")
        hubs = self.scratch.save(ranked.groupBy("sig").agg(F.max_by("key", F.struct("all", "key")).alias("hub")), f"hubs{level}")
        held = buckets.join(hubs, "sig").where("key <> hub").select("hub", "key")
        self.test(held if pairs is None else held.union(pairs))
        return self.scratch.save(self.open(buckets.select("sig", "key"), hubs), f"open{level}")

    def _compare(self, rows: DataFrame, level: int) -> None:
        most, i = 8, 0
        rows = self.scratch.save(rows, f"rows{level}_0")
        while not rows.isEmpty():
            known = self.known.select("key", "n", "sketch", "wide")
            found = self.scratch.save(_candidates(self.labelled(rows).join(known, "key"), most, self.num, self.den), f"found{level}_{i}")
            self.test(found.where("b IS NOT NULL").select("a", "b").distinct(), True)
            most, i = 8 * most, i + 1
            rows = self.scratch.save(self.open(found.where("b IS NULL").select("sig", F.col("a").alias("key"))).select("sig", "key"), f"rows{level}_{i}")
            self.scratch.drop(f"rows{level}_{i - 1}", f"found{level}_{i - 1}")


def jaccard_join(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> tuple[DataFrame, DataFrame]:
    """Classes and links of `docs` (doc_id, text) whose sets of `width`-word shingles are similar by num / den or more.

    Returns (members, links). members: doc_id, tid (hash of the text), key (of the set; null: empty), n (set size) and
    component (smallest doc_id reachable by links). links: a, b, pairs of keys that connect all that is linked.

    Few sets that share a signature are tested pair by pair, as far as sizes and sketches don't rule a pair out; of many,
    those that sketches leave (_State.settle). A pair is left out only if its ends are connected already. So each link is
    found or its ends are connected by others, and a group of copies costs as many tests as it has members, not pairs.

    Defined cases: null and empty texts have n 0, no key, and are a class alone; equal sets are one key however many
    documents have it; repeated rows are repeated members; further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.select(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    tasks = max(tasks, size * 16 // 12 // TASK_BYTES)  # about one signature of 16 bytes for two words of 6
    mixed = scratch.save(_scan(docs, width, num, den, tasks), "mixed")
    members = mixed.where("sig IS NULL AND other IS NULL").drop("sig", "other")
    state = _State(docs, scratch, members, width, num, den)
    state.settle(mixed.where("sig IS NOT NULL").select("sig", "key").distinct(), mixed.where("other IS NOT NULL").select("key", "other"))
    lowest = members.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("low"))
    linked = state.label.withColumnRenamed("node", "key").join(lowest, "key")
    low = linked.groupBy("component").agg(F.min("low").alias("joint"))
    lowest = lowest.join(linked.select("key", "component").join(low, "component").select("key", "joint"), "key", "left").select("key", F.coalesce("joint", "low").alias("low"))
    whole = members.where("key IS NOT NULL").join(lowest, "key").select("doc_id", "tid", "key", "n", F.col("low").alias("component"))
    whole = scratch.save(whole.unionByName(members.where("key IS NULL").select("doc_id", "tid", "key", "n", F.col("doc_id").alias("component"))), "whole")
    links = scratch.save(state.links, "all_links")
    scratch.drop(*scratch.names("") - {"whole", "all_links"})
    return whole, links


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 9, 10)
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near copies (five words, 0.8 or more) the document of smallest doc_id stays.

    Defined cases: documents without a set (null, empty, white space) all stay; of repeated rows (same doc_id and text) one
    stays; where one doc_id has several texts of a class, one of them stays; further columns stay as they are, whatever
    their names; an empty table gives no rows.
    """
    members, _ = jaccard_join(docs.select("doc_id", "text"))
    sets = members.where("key IS NOT NULL")
    # One row stays for each class; documents without a set stay all.
    best = sets.groupBy("component").agg(F.min(F.struct("doc_id", "tid")).alias("best"))
    row, tid = free_names(docs, "row", "tid")
    gone = sets.join(best, "component").where("NOT (doc_id <=> best.doc_id AND tid <=> best.tid)").select(F.col("doc_id").alias(row), F.col("tid").alias(tid)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(row)) & (F.xxhash64("text") == F.col(tid))
    kept = docs.join(small(gone, KEY_BYTES), same, "left_anti")
    repeated = sets.groupBy("doc_id", "tid").count().where("count > 1").select(F.col("doc_id").alias(row), F.col("tid").alias(tid))
    if repeated.isEmpty():
        return kept
    once = kept.join(small(repeated, KEY_BYTES), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small(repeated, KEY_BYTES), same, "left_anti").unionByName(once)
