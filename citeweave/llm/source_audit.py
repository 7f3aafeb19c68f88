"""Source divergence audit: how each source's use of terms departs from its language and from the other sources.

Terms are counted in tasks before anything is shuffled. Ranks of terms come from a radix select: histograms over the bits of
the value, then over the bytes of the term, find each group's threshold, and only what lies above it is sorted. Divergences
of pairs are summed over the terms that occur, as corrections of what two groups without any term would have.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, small, table, trimmed

#: A lang keeps terms of at least so many of its documents; counts are smoothed by ADDED and given in parts of SCALE.
LEAST_DOCS, ADDED, SCALE = 30, 5, 1_000_000_000
#: Ranks of terms that are returned.
RANKS = 50
#: Bits of a value (shares are SCALE + 1 at the most) and of a digit of it; bytes of a digit of a term.
VALUE_BITS, DIGIT_BITS, DIGIT_BYTES = 30, 10, 2
#: So many rows of a group that still tie are sorted instead of being told apart by further bytes.
FEW = 1024
#: A block of the divergence sums: terms and sources, on average.
BLOCK_TERMS, BLOCK_SOURCES = 4096, 256
#: Terms in UTF-8 with A-Z lower-cased: letters and all bytes of characters beyond ASCII.
_TERM, _BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of text that are split at a time, and entries that a task holds before it hands them on.
_SLICE, _HELD = 4 << 20, 400_000
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _slices(text: bytes):
    """Lists of the terms of `text`, a slice at a time; slices end where no term does."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        if end < len(text):
            stop = _BREAK.search(text, end)
            end = stop.start() if stop else len(text)
        yield _TERM.findall(text, at, end)
        at = end


def _count(batches):
    """Rows of (lang, source, term, n, docs): occurrences and documents, summed as far as a task holds them."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def out():
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                columns = [[lang] * len(part), [source] * len(part), part, [n[t] for t in part], [docs[t] for t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED)], schema=_COUNTED)
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in _slices((text.as_py() or b"").lower()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n) - before
            if held > _HELD:
                yield from out()
                held = 0
    yield from out()


def named(docs: DataFrame) -> DataFrame:
    """lang, source and text as bytes, null as empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows of named(): occurrences and documents of each term in each group."""
    rows = docs.mapInArrow(trimmed(_count), "lang string, source string, term binary, n bigint, docs bigint")
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), in decimals, which hold it exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + ADDED), wide(total + ADDED * terms)) + F.lit(1).cast("long")


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], digit: Column, descending: bool) -> DataFrame:
    """Of rows (keys, _at, ..) that stand at their group's state (keys, _at, _need): the digit that holds the _need-th one,
    what is needed of it, and how many rows it has. A group has as many rows here as a digit has values."""
    seen = rows.withColumnRenamed("_at", "_mine").join(state, keys).where("_mine = _at").groupBy(*keys, "_need", digit.alias("_digit")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_digit") if descending else F.asc("_digit")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return seen.withColumn("_sum", F.sum("_n").over(order)).where("_sum >= _need AND _sum - _n < _need").select(*keys, "_digit", (F.col("_need") - F.col("_sum") + F.col("_n")).alias("_need"), F.col("_n").alias("_tied"))


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int, scratch: Scratch, value_bits: int = VALUE_BITS, few: int = FEW) -> DataFrame:
    """Rows of the k largest values of each group, ties to the item smallest in UTF-8, with their rank (int, from 1).

    rows: keys (not null), value (long, 0 .. 2^value_bits - 1), item (string, distinct in its group). Groups of k rows or
    fewer come whole. Rounds over the digits of the value find the k-th; while more than `few` rows tie with it, rounds over
    the bytes of the item go on, so a window sorts less than k + few rows of a group.
    """
    shifts = list(range(value_bits, 0, -DIGIT_BITS))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_all"))
    state = counted.where(f"_all > {k}").select(*keys, F.lit(0).cast("long").alias("_at"), F.lit(k).cast("long").alias("_need"))
    for high in shifts:
        low = max(0, high - DIGIT_BITS)
        at = rows.withColumn("_at", F.shiftright(value, high))
        found = _narrowed(at, state, keys, F.shiftright(value, low), True)
        state = found.select(*keys, F.col("_digit").alias("_at"), "_need", "_tied")
    bound = scratch.save(state.select(*keys, F.col("_at").alias("_value"), "_need", "_tied", F.lit("").alias("_stem"), (F.col("_tied") > few).alias("_open")), "bound0")
    # Groups with many rows at the threshold: their items by bytes, as hexadecimal digits, whose order is the bytes'.
    taken, step, width = bound.where("NOT _open"), 0, 2 * DIGIT_BYTES
    while not bound.where("_open").isEmpty():
        step += 1
        tied = rows.join(bound.where("_open").select(*keys, "_value"), keys).where(F.col(value) == F.col("_value")).withColumn("_hex", F.hex(F.col(item).cast("binary")))
        at = tied.select(*keys, "_hex", F.substring("_hex", 1, width * (step - 1)).alias("_at"))
        found = _narrowed(at, bound.where("_open").select(*keys, F.col("_stem").alias("_at"), "_need"), keys, F.substring("_hex", 1, width * step), False)
        bound = scratch.save(found.join(bound.select(*keys, "_value"), keys).select(*keys, "_value", "_need", "_tied", F.col("_digit").alias("_stem"), (F.col("_tied") > few).alias("_open")), f"bound{step}")
        taken = taken.unionByName(bound.where("NOT _open"))
    limits = taken.select(*keys, "_value", "_stem")
    hexed = F.hex(F.col(item).cast("binary"))
    above = rows.join(limits, keys, "left").where(F.col("_value").isNull() | (F.col(value) > F.col("_value")) | ((F.col(value) == F.col("_value")) & (F.substr(hexed, F.lit(1), F.length("_stem")) <= F.col("_stem"))))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), item))
    return above.select(*rows.columns, rank.alias("rank")).where(F.col("rank") <= k)


def _divergence(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of one block of terms and two of sources. Rows without a term name the sources and their bases; the others hold
    the shares of terms that occur. A term that doesn't occur adds |base - base| to a pair, which is left out here."""
    own = pdf[pdf["term"].isna()].drop_duplicates("source")
    sources, base, side = own["source"].to_numpy(), own["base"].to_numpy(np.int64), own["side"].to_numpy()
    rows = pdf[pdf["term"].notna()]
    place = {s: i for i, s in enumerate(sources)}
    column, terms = pd.factorize(rows["term"])
    dense = np.repeat(base[:, None], max(1, len(terms)), axis=1)
    dense[[place[s] for s in rows["source"]], column] = rows["p"].to_numpy(np.int64)
    first, i, j = int(pdf["block"].iloc[0]) == 0, int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    out = []
    for a in range(len(sources)):
        apart = np.abs(base - base[a])
        value = np.abs(dense - dense[a]).sum(axis=1) - dense.shape[1] * apart
        if first:
            value += int(own["terms"].iloc[0]) * apart
        other = np.flatnonzero((np.arange(len(sources)) != a) & ((side != side[a]) | (i == j)) & (first | (value != 0)))
        out.append(pd.DataFrame({"lang": pdf["lang"].iloc[0], "source": sources[a], "item": sources[other], "value": value[other]}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})


def divergences(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each two sources of a lang the sum of |p - q| over all of the lang's terms.

    shares: lang, source, term, p of what occurs; groups: lang, source, base (a group's share of a term it lacks), terms
    (the lang's). Only blocks of terms and sources meet in a task; a row goes to as many as there are blocks of sources.
    """
    most = groups.groupBy("lang").agg(F.count("*").alias("s"), F.max("terms").alias("v")).agg(F.max("s").alias("s"), F.max("v").alias("v")).first()
    blocks, parts = max(1, -(-(most["v"] or 0) // BLOCK_TERMS)), max(1, -(-(most["s"] or 0) // BLOCK_SOURCES))
    side = F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int")
    block = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(blocks)).cast("int")
    own = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "base", "terms", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), side.alias("side"))
    own = own.where("block = 0 OR terms > 0")
    held = shares.select("lang", "source", "term", "p", F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("terms"), block.alias("block"), side.alias("side"))
    meet = own.unionByName(held).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("*", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j")).drop("o")
    sums = meet.groupBy("lang", "block", "i", "j").applyInPandas(_divergence, "lang string, source string, item string, value bigint")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, few: int = FEW) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs with lang, source and text.

    part `pair`: each other source of the lang and the divergence from it, all ranks; part `term`: terms that the group uses
    more than its lang does, and by how much, to `ranks`. Defined cases: null lang, source and text are empty strings; a
    group without terms has its pairs, and 0 for all where the lang keeps no term; a lang's only source has none; repeated
    rows are documents of their own; ties go to the item smallest in UTF-8; very long texts are counted whole, in slices; an
    empty table gives no rows; other columns, whatever their names, aren't read.
    """
    scratch, text = Scratch(docs.sparkSession, "audit"), named(docs)
    counts = scratch.save(term_counts(text), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(f"docs >= {least_docs}").drop("docs")
    used = scratch.save(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "used")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # A lang's terms are counted once each: by the least source that has them.
    langs = used.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    groups = text.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    base = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0).cast("long")
    groups = scratch.save(groups.withColumn("base", base), "groups")
    shares = used.join(small(groups, 200), ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    shares = scratch.save(shares, "shares")
    more = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = radix_top(more, ["lang", "source"], "value", "item", ranks, scratch, few=few)
    pairs = divergences(shares, groups).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    scratch.drop("counts", "used")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return top.withColumn("part", F.lit("term")).select(*columns).unionByName(pairs.withColumn("part", F.lit("pair")).select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 g AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
 k AS (SELECT lang, term, sum(n) AS n FROM g GROUP BY ALL HAVING sum(docs) >= 30),
 lt AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
 s AS (SELECT DISTINCT lang, source FROM d),
 st AS (SELECT s.lang, s.source, coalesce((SELECT sum(g.n) FROM g SEMI JOIN k ON k.lang = g.lang AND k.term = g.term WHERE g.lang = s.lang AND g.source = s.source), 0) AS total FROM s),
 p AS (SELECT st.lang, st.source, k.term, coalesce(g.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(g.n, 0) + 5)) // (st.total + 5 * lt.v)::HUGEINT AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.n + 5)) // (lt.total + 5 * lt.v)::HUGEINT AS BIGINT) AS q
   FROM st JOIN k USING (lang) JOIN lt USING (lang) LEFT JOIN g ON g.lang = st.lang AND g.source = st.source AND g.term = k.term),
 f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
   UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
 SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u QUALIFY part = 'pair' OR rank <= 50"""
