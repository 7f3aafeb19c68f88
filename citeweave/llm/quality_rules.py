"""Quality rules: base counts of every document and a hashed n-gram log-likelihood ratio.

Everything here is made of DataFrame and SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import SPACES, double_array, fenced, free_names, small, table

#: Buckets that words and word pairs are hashed into.
BUCKETS = 10_000
#: Added to each bucket's count in both multinomials.
SMOOTHING = 1.0
#: A document is kept if its ratio per n-gram (natural log) is at least this.
THRESHOLD = -0.1
#: Of a long, the bits that hold a window's place; the others are its hash's.
_POSITION_BITS = 31


def _let(value: str, name: str, body: str) -> str:
    """SQL: `body` with `name` bound to `value`, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _text (null: empty) and _words, the runs of characters other than white space."""
    return docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn(
        "_words", F.expr(f"filter(split(_text, r'{SPACES}'), x -> x <> '')")
    )


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows of with_words().

    One long for each window, its hash's upper bits above its place, is sorted: windows whose hash bits are found twice lie
    side by side. These are sorted again by their words, which alone decide; so texts of any length are counted exactly.
    """
    packed = f"transform(sequence(0, n_words - 3), i -> (xxhash64(_words[i], _words[i + 1], _words[i + 2]) & {-(1 << _POSITION_BITS)}L) | i)"

    def twins(items: str, same: str, out: str) -> str:
        """SQL: `out` of those k of the sorted `items` that equal a neighbour; same: SQL of whether {a} and {b} are equal."""
        first = f"CASE WHEN k > 0 THEN {same.format(a=f'{items}[k]', b=f'{items}[k - 1]')} ELSE false END"
        second = f"CASE WHEN k < size({items}) - 1 THEN {same.format(a=f'{items}[k + 1]', b=f'{items}[k]')} ELSE false END"
        return f"transform(filter(sequence(0, size({items}) - 1), k -> ({first}) OR ({second})), k -> {out})"

    near = twins("s", f"shiftright({{a}}, {_POSITION_BITS}) = shiftright({{b}}, {_POSITION_BITS})", f"int(s[k] & {(1 << _POSITION_BITS) - 1}L)")
    spelt = f"sort_array(transform({near}, i -> struct(concat_ws(' ', _words[i], _words[i + 1], _words[i + 2]) AS w, i AS i)))"  # no word holds a space
    places = twins("c", "{a}.w = {b}.w", "c[k].i")
    step = "(a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last))"
    covered = f"aggregate(sort_array({places}), named_struct('last', -3, 'n', 0), {step}, a -> a.n)"

    return (
        docs.withColumn("n_words", F.expr("size(_words)"))
        .withColumn("word_chars", F.expr(f"char_length(regexp_replace(_text, r'{SPACES}', ''))"))
        .withColumn("n_symbols", F.expr("char_length(_text) - char_length(regexp_replace(_text, '[#*$%&|<>]', ''))"))
        .withColumn("_lines", F.expr(r"filter(split(_text, '\n', -1), x -> x rlike r'[^\x20\x09-\x0D]')"))
        .withColumn("n_dup_lines", F.expr("size(_lines) - size(array_distinct(_lines))"))
        .withColumn("_packed", F.expr(f"CASE WHEN n_words < 4 THEN array() ELSE {packed} END"))
        .withColumn("_sorted", F.expr("sort_array(_packed)"))
        .withColumn("_repeats", F.expr(f"size(array_distinct(transform(_packed, x -> shiftright(x, {_POSITION_BITS})))) < size(_packed)"))
        .withColumn("n_repeat_words", F.expr(f"CASE WHEN _repeats THEN {_let('_sorted', 's', _let(spelt, 'c', covered))} ELSE 0 END"))
        .drop("_lines", "_packed", "_sorted", "_repeats")
    )


def with_buckets(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds _buckets to rows of with_words(): the buckets of all words and of all pairs of neighbours."""
    one = f"transform(_words, w -> int(pmod(xxhash64(w), {buckets})))"
    two = f"CASE WHEN size(_words) < 2 THEN array() ELSE transform(sequence(0, size(_words) - 2), i -> int(pmod(xxhash64(_words[i], _words[i + 1]), {buckets}))) END"
    return docs.withColumn("_buckets", F.expr(f"concat({one}, {two})"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that some label calls good and none calls bad or toxic."""
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 AND t = 0")
        .select(F.col("doc_id").alias("_trusted_id"))
    )


def learn_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """For each bucket, log of its share among trusted documents over its share in the whole corpus.

    docs: doc_id, text. Every n-gram of every document counts. `buckets` rows come to the driver, whatever the input.
    With no trusted document all ratios are 0, so nothing is rejected by them.
    """
    if trusted.isEmpty():
        return [0.0] * buckets
    seen = with_buckets(with_words(docs.select("doc_id", "text").join(small(trusted, 40), F.col("doc_id") == F.col("_trusted_id"), "left")), buckets)
    counts = (
        seen.select(F.col("_trusted_id").isNotNull().cast("long").alias("t"), F.explode_outer("_buckets").alias("b"))  # explode would filter by the whole expression first
        .groupBy("b")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("trusted"))
    )
    rows = {r["b"]: (r["raw"], r["trusted"]) for r in counts.collect() if r["b"] is not None}
    n_raw, n_trusted = (sum(r[k] for r in rows.values()) for k in (0, 1))
    if not n_trusted:
        return [0.0] * buckets
    out = []
    for b in range(buckets):
        raw, good = rows.get(b, (0, 0))
        out.append(math.log((good + smoothing) / (n_trusted + smoothing * buckets)) - math.log((raw + smoothing) / (n_raw + smoothing * buckets)))
    return out


def quality_rules(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `docs` (with a column text) and, last, a struct of the counts, score, base_failed and kept. It is
    named _quality, or with underscores more where `docs` has such a column.

    ratio: of learn_ratio(), at most some ten thousand numbers, carried as one literal. score: mean ratio of the
    document's n-grams, 0 with none. Defined cases: a null or empty text has zero counts, fails the base rule and
    isn't kept; repeated rows are judged alike, each by itself; very long texts are judged whole; an empty table gives no
    rows; other columns, null or not, pass through untouched, whatever their names.
    """
    weights = double_array(docs.sparkSession, ratio)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    judged = with_buckets(base_counts(with_words(own)), len(ratio)).withColumn(
        "_score", F.aggregate("_buckets", F.lit(0.0), lambda a, b: a + F.get(weights, b)) / F.greatest(F.size("_buckets"), F.lit(1))
    )
    failed = "(n_words < 50 OR 100L * n_repeat_words > 50L * n_words)"
    fields = [F.expr(f"bigint({c})").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [F.expr(failed).alias("base_failed"), F.expr(f"NOT {failed} AND _score >= {threshold}D").alias("kept"), F.col("_score").alias("score")]
    judged = judged.select("_row", fenced(F.struct(*fields)).alias("_quality"))
    return judged.select(*[F.col(f"_row.`{c}`") for c in docs.columns], F.col("_quality").alias(*free_names(docs, "_quality")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = learn_ratio(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return quality_rules(docs, ratio).select("doc_id", "_quality.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; the cases of quality_rules() hold."""
    ratio = learn_ratio(docs, trusted_ids(table(spark, sf_dir, "labels")))
    judged = quality_rules(docs, ratio)
    return judged.where(F.col(judged.columns[-1])["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
