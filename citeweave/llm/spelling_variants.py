"""Spelling variant grouping: a self-join of the vocabulary's trie by sets of active nodes, at distance one.

Going down the trie, each node carries the nodes whose strings are within distance one of its own. At this bound a pair at
distance one can only follow equal characters, so the trie is cut where it gets large: above the cuts, a branching node's pairs
go down in one step, as equal remainders of its words; below, every subtree is walked in one task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, small, table, trimmed

#: What is said of words: code points and occurrences at least; one of so many runs loses a character.
LEAST_CHARS, LEAST_COUNT, DROPPED = 5, 3, 97
#: A form occurs at least so many times as often as its variant.
RATIO = 2
#: A node of the trie with more words than these is branched over tasks.
MOST_WORDS = 2000
#: Runs in Latin-1, which holds every character of theirs; others are encoded as "?", which ends a run.
_RUN, _BREAK = re.compile(rb"[A-Za-z\xc0-\xff]+"), re.compile(rb"[^A-Za-z\xc0-\xff]")
_SLICE, _HELD = 4 << 20, 400_000
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("near", pa.string())])


def _runs(text: bytes):
    """Lists of the runs of `text`, a slice at a time; slices end where no run does."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        if end < len(text):
            stop = _BREAK.search(text, end)
            end = stop.start() if stop else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def _count(batches):
    """(word, n) of (doc_id as text, text), summed as far as a task holds them."""
    counts: Counter = Counter()

    def out():
        words = list(counts)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part]), pa.array([counts[w] for w in part], pa.int64())], schema=_COUNTED)
        counts.clear()

    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            start = zlib.crc32(f"{ident}:".encode())
            own: Counter = Counter()
            # bytes.lower() changes A-Z alone
            for runs in _runs((text.as_py() or "").encode("latin-1", "replace").lower()):
                own.update(runs)
            for run, n in own.items():
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                if not h % DROPPED:
                    cut = h % len(run)
                    run = run[:cut] + run[cut + 1 :]
                if len(run) >= LEAST_CHARS:
                    counts[run] += n
            if len(counts) > _HELD:
                yield from out()
    yield from out()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of docs (doc_id, text): words that occur `least` times or more. Null ids are empty in the hash."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {least}")


def _walk(words: list[str]):
    """(word, near) of words (distinct) with a common trie: every two at distance one, each way."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    # A node's active nodes at distance one, by identity; at distance 0 there is only itself.
    start = {id(child): child for c, child in root.items() if c}
    todo = [(root, start)]
    while todo:
        node, active = todo.pop()
        if "" in node:
            for other in active.values():
                if "" in other:
                    yield node[""], other[""]
        for c, child in node.items():
            if not c:
                continue
            below = {id(x): x for other in active.values() if (x := other.get(c)) is not None}  # the same character on both sides
            below[id(node)] = node  # c is deleted
            for d, sibling in node.items():
                if d and d != c:
                    below[id(sibling)] = sibling  # c is replaced
            for d, grandchild in child.items():
                if d:
                    below[id(grandchild)] = grandchild  # d is inserted
            below.pop(id(child), None)
            todo.append((child, below))


def _walks(batches):
    """Walks of runs of rows (stem, word) of one stem."""
    stem, words, out = None, [], []

    def flush():
        nonlocal out
        batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], schema=_NEAR)
        out = []
        return batch

    def walk():
        for pair in _walk(words):
            out.append(pair)
            if len(out) >= 50_000:
                yield flush()

    for batch in batches:
        for s, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != stem:
                yield from walk()
                stem, words = s, []
            words.append(w)
    yield from walk()
    yield flush()


def near_words(words: DataFrame, scratch: Scratch, most: int = MOST_WORDS) -> DataFrame:
    """(word, near) for every two of words (word, distinct) that differ by exactly one inserted, deleted or replaced code
    point, each way, once.

    Stems are prefixes with more than `most` words, the root always. A word belongs to the subtree of its shortest prefix that is no
    stem, and there meets those that part from it below. Those that part from it at a stem have the same remainder: after
    the next character of both if it is replaced, or after that of one if it is inserted. A remainder has as many words as
    there are characters, at most, and one more.
    """
    each = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("d")).select(F.expr("substr(word, 1, d)").alias("stem"))
    stems = scratch.save(each.groupBy("stem").agg(F.count("*").alias("k")).where(f"k > {most}").select("stem").union(words.sparkSession.createDataFrame([("",)], "stem string")), "stems")
    prefixes = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("d")).withColumn("stem", F.expr("substr(word, 1, d)"))
    # Prefixes of a stem are stems: a word's form a run from the root, and its subtree's is one character longer than the last.
    at = scratch.save(prefixes.join(small(stems, 120), "stem"), "at")
    subtree = at.groupBy("word").agg(F.max("d").alias("d")).select(F.expr("substr(word, 1, d + 1)").alias("stem"), "word", F.expr("char_length(word) > d").alias("below"))
    # A word that is a stem itself has no subtree; what lies one character below it meets it by the empty remainder.
    inner = subtree.where("below").select("stem", "word").repartition("stem").sortWithinPartitions("stem", "word").mapInArrow(trimmed(_walks), "word string, near string")
    dropped = at.where("char_length(word) > d").select("stem", F.expr("substr(word, d + 2)").alias("rest"), "word", F.expr("substr(word, d + 1, 1)").alias("c"))
    plain = at.select("stem", F.expr("substr(word, d + 1)").alias("rest"), "word", F.lit("").alias("c"))
    # c: the character left out, or none. An insertion parts from its word here only if the next character differs.
    met = dropped.unionByName(plain).groupBy("stem", "rest").agg(F.collect_list(F.struct("word", "c")).alias("m")).where("size(m) > 1")
    parts = "(a.c <> '' AND b.c <> '' AND a.c <> b.c) OR (a.c = '' AND b.c <> '' AND b.c <> substr(rest, 1, 1)) OR (b.c = '' AND a.c <> '' AND a.c <> substr(rest, 1, 1))"
    pairs = met.select(F.explode(F.expr(f"flatten(transform(m, a -> transform(filter(m, b -> {parts}), b -> struct(a.word AS word, b.word AS near))))")).alias("p")).select("p.word", "p.near")
    return inner.unionByName(pairs)


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of forms (word, form, n): where the forms end. Each is RATIO times as frequent as the one before, so
    that the chain's length, and with it the number of doublings, is known from the largest count."""
    most = forms.agg(F.max("form_n")).first()[0] or 1
    current = scratch.save(forms.select("word", F.col("form").alias("root")), "roots0")
    for i in range(1, max(1, most.bit_length()).bit_length() + 1):
        further = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        current = scratch.save(current.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), f"roots{i}")
        scratch.drop(f"roots{i - 1}")
    return current


def spelling_variants(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of docs with doc_id and text.

    A word's form is its most frequent near word (ties: the smallest in code-point order) if that occurs RATIO times as often;
    its root is where the forms end. Defined cases: a null text has no words; a null doc_id hashes as an empty one; repeated rows
    count each; very long texts are read whole, in slices; an empty table, or one without words that occur often enough, gives
    no rows; a run that loses a character may fall below the least length, and one of a single character vanishes; other
    columns, whatever their names, aren't read.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs), "words")
    near = near_words(words, scratch, most)
    counted = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    formed = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.minus") >= RATIO * F.col("n"), -F.col("best.minus")))
    formed = scratch.save(formed.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "formed")
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form", "form_n"), scratch)
    scratch.drop("words", "stems", "at")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: DuckDB SQL of crc32 of the bytes in the hexadecimal x; t holds the table of remainders.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"

SQL = rf"""WITH RECURSIVE bits(k, t) AS (SELECT 0, list_transform(range(256), lambda i: CAST(i AS BIGINT)) UNION ALL SELECT k + 1, list_transform(t, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) FROM bits WHERE k < 8),
 crc AS (SELECT t FROM bits WHERE k = 8),
 r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
 c AS (SELECT run, hex(encode(id || ':' || run)) AS x, count(*) AS n FROM r GROUP BY ALL),
 h AS (SELECT run, n, {_CRC32} AS h FROM c, crc),
 w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
 v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
 x AS (SELECT word, n, i, substr(word, 1, i) || '_' || substr(word, i + 2) AS hole, substr(word, 1, i) || substr(word, i + 2) AS gone FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)),
 p AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.hole = b.hole AND a.word <> b.word UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.gone UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.gone),
 b AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM p GROUP BY 1),
 f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
 o(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT o.word, f.word, f.form FROM o JOIN f ON f.word = o.form)
 SELECT f.word, f.form, o.root, f.n, f.n_near, f.form_n FROM f JOIN o ON o.word = f.word AND o.form IS NULL"""
