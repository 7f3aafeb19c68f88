"""Titles that a plan names, matched to papers: candidates share words, and each title gets its best one or none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import titles as T
from citeweave.operators.steps import Steps, small


#: Papers and planned titles of a topic that one task meets, about.
PAPERS, PLANNED = 16_384, 50_000
#: Pairs scored at once.
PAIRS = 1 << 19


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Items of a list column, and where each row's start."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its length."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def _best(asked: pa.Table, held: pa.Table) -> pa.Table:
    """The best paper in `held` of each planned title in `asked` that shares one of the words sought with one.

    Words become numbers and the papers' sets of words rows of bits, so that pairs are scored as arrays. Papers go by citations
    and id, so that of equal scores the first counts.
    """
    columns = ["topic", "step", "paper_id", "citations", "score", "coverage", "variant"]
    held = held.sort_by([("citations", "descending"), ("paper_id", "ascending")])
    (has, has_at), (first, first_at), (wants, wants_at), (seeks, seeks_at) = _lists(held["tokens"]), _lists(held["opening"]), _lists(asked["wanted"]), _lists(asked["sought"])
    coded = pa.concat_arrays([has, first, wants, seeks]).dictionary_encode()
    n_words, coded = len(coded.dictionary), coded.indices.to_numpy()
    has, first, wants, seeks = np.split(coded, np.cumsum([len(has), len(first), len(wants)]))
    names = pa.chunked_array([*held["main"].chunks, *asked["whole"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    main, whole = names[: len(held)], names[len(held) :]
    year, wanted_year = (t[c].cast(pa.float64()).to_numpy() for t, c in ((held, "year"), (asked, "wanted_year")))  # unknown: nan, which is near nothing
    plain = asked["plain"].to_numpy()
    paper_of = np.repeat(np.arange(len(held)), np.diff(has_at))
    # Bits of the papers that have a word, by word: of words that are asked for, and a row without bits for the others.
    row = np.zeros(n_words, np.int64)
    row[np.intersect1d(wants, has)] = np.arange(1, len(np.intersect1d(wants, has)) + 1)
    width = len(held) // 8 + 1
    bits = np.zeros((row.max(initial=0) + 1) * width, np.uint8)
    use = row[has] > 0
    np.bitwise_or.at(bits, row[has[use]] * width + (paper_of[use] >> 3), np.left_shift(1, paper_of[use] & 7).astype(np.uint8))
    by_word = np.argsort(has, kind="stable")
    papers, met_at = paper_of[by_word], np.searchsorted(has[by_word], np.arange(n_words + 1))
    opening = np.full((3, len(held)), -1, np.int64)
    for k in range(3):
        ok = np.diff(first_at) > k
        opening[k, ok] = first[first_at[:-1][ok] + k]
    n_has, n_wants = np.diff(has_at), np.diff(wants_at)

    def qualified(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        there = np.zeros((3, len(q)), bool)
        for j in range(n_wants[q].max(initial=0)):
            on = np.flatnonzero(n_wants[q] > j)
            there[:, on] |= opening[:, p[on]] == wants[wants_at[q[on]] + j]
        return ~there[0] & (there[1] | there[2])

    def scored(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, similarities and how many words are shared."""
        both = np.zeros(len(q), np.int64)
        for j in range(n_wants[q].max(initial=0)):
            on = np.flatnonzero(n_wants[q] > j) if (n_wants[q] <= j).any() else slice(None)
            both[on] += bits[row[wants[wants_at[q[on]] + j]] * width + (p[on] >> 3)] >> (p[on] & 7).astype(np.uint8) & 1
        similar = 2.0 * both / (n_wants[q] + n_has[p])
        high = np.flatnonzero(similar > T.VARIANT_CAP)
        similar[high[qualified(q[high], p[high])]] = T.VARIANT_CAP
        similar[plain[q] & (main[p] == whole[q])] = 1.0
        with np.errstate(invalid="ignore"):
            near = np.abs(wanted_year[q] - year[p]) <= 1
        return np.minimum(1.0, similar + np.where(near, T.YEAR_BONUS, 0.0)), similar, both

    best, place = np.full(len(asked), -1.0), np.zeros(len(asked), np.int64)
    ask_of, meets = np.repeat(np.arange(len(asked)), np.diff(seeks_at)), met_at[seeks + 1] - met_at[seeks]
    cuts = np.flatnonzero(np.diff(np.cumsum(meets) // PAIRS, prepend=0))
    for some in np.split(np.arange(len(seeks)), cuts):
        q, p = np.repeat(ask_of[some], meets[some]), papers[_spread(met_at[seeks[some]], meets[some])]
        if not len(q):
            continue
        score = scored(q, p)[0]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        top = np.maximum.reduceat(score, starts)
        at = np.minimum.reduceat(np.where(score == np.repeat(top, np.diff(np.r_[starts, len(q)])), p, len(held)), starts)
        q = q[starts]
        better = (top > best[q]) | ((top == best[q]) & (at < place[q]))
        best[q[better]], place[q[better]] = top[better], at[better]
    found = np.flatnonzero(best >= 0)
    score, similar, both = scored(found, place[found])
    variant = (similar < 1) & qualified(found, place[found])
    values = [asked["topic"].take(found), asked["step"].take(found), held["paper_id"].take(place[found]), held["citations"].take(place[found]), pa.array(score), pa.array(both / n_wants[found]), pa.array(variant)]
    return pa.table(values, names=columns)


def resolve_titles(planned: DataFrame, papers: DataFrame, hot: int = PAPERS) -> DataFrame:
    """(topic, step, paper_id, score, coverage, accepted, confident): the best candidate of each planned title.

    planned: topic, step, title, year; papers: topic, paper_id, title, year, citation_count. Candidates are papers of the
    topic that share one of the planned title's rarest words: 0.8 of its words must be covered, so of one more than may be
    missing, one is met. Slides, errata and the like aren't candidates, nor are papers without authors where papers has that
    column. A title that looks like a variant isn't accepted, whatever its year. Of equal scores the most cited counts (unknown last), then
    the smaller id. A topic's papers are dealt out over blocks of about `hot`, and its planned titles over parts; each part meets
    each block in one task, which sends on one row for each title.
    """
    steps = Steps(planned.sparkSession, "titles")  # words of each title are made once
    fits = T.looks_like_a_paper(F.col("title"), F.col("authors")) if "authors" in papers.columns else ~F.coalesce(F.col("title"), F.lit("")).rlike(T.NOT_A_PAPER)
    held = papers.where(fits & F.col("title").isNotNull()).select(
        "topic", "paper_id", F.col("year").cast("int").alias("year"), F.coalesce(F.col("citation_count").cast("long"), F.lit(-1)).alias("citations"), T.tokenize(F.col("title")).alias("tokens"),
        F.array_join(T.tokenize(T.main_title(F.col("title"))), " ").alias("main"), F.slice(T.content_words(F.col("title")), 1, 1 + T.VARIANT_WORDS).alias("opening"),
    )
    held = steps.save(held, "held")
    common = held.select("topic", F.explode("tokens").alias("word")).groupBy("topic", "word").agg(F.count("*").alias("papers"))
    asked = planned.select("topic", "step", F.col("year").cast("int").alias("wanted_year"), (~F.col("title").contains(":")).alias("plain"), F.explode(T.tokenize(F.col("title"))).alias("word"))
    rarest = F.array_sort(F.collect_list(F.struct(F.coalesce("papers", F.lit(0)).alias("papers"), F.col("word").alias("word"))))
    asked = asked.join(common, ["topic", "word"], "left").groupBy("topic", "step").agg(F.first("wanted_year").alias("wanted_year"), F.first("plain").alias("plain"), rarest.alias("w"))
    # n - ceil(0.8 n) words may be missing: one more than these is looked for.
    asked = asked.withColumn("wanted", F.array_sort(F.transform("w", lambda x: x["word"]))).withColumn("sought", F.expr("transform(slice(w, 1, int(size(w) - ceil(0.8 * size(w)) + 1)), x -> x.word)"))
    asked = steps.save(asked.select("topic", "step", "wanted_year", "plain", "wanted", "sought", F.array_join("wanted", " ").alias("whole")), "asked")
    parts = lambda df, n, name: df.groupBy("topic").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    topics = small(parts(held, hot, "blocks").join(parts(asked, PLANNED, "parts"), "topic"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = asked.join(topics, "topic").withColumn("block", every("blocks")).withColumn("part", own("step", "parts")).drop("blocks", "parts")
    right = held.join(topics, "topic").withColumn("part", every("parts")).withColumn("block", own("paper_id", "blocks")).drop("blocks", "parts")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"topic {kind(asked, 'topic')}, step {kind(asked, 'step')}, paper_id {kind(held, 'paper_id')}, citations bigint, score double, coverage double, variant boolean"
    scored = left.groupBy("topic", "block", "part").cogroup(right.groupBy("topic", "block", "part")).applyInArrow(_best, schema)
    # Combined before its shuffle: the least by score and citations downwards and id upwards.
    order = F.struct((-F.col("score")).alias("s"), (-F.col("citations")).alias("c"), F.col("paper_id").alias("i"))
    best = scored.groupBy("topic", "step").agg(F.min_by(F.struct("paper_id", "score", "coverage", "variant"), order).alias("b")).select("topic", "step", "b.*")
    accepted = (F.col("score") >= T.ACCEPT) & (F.col("coverage") >= T.COVER) & ~F.col("variant")
    return best.select("topic", "step", "paper_id", "score", "coverage", accepted.alias("accepted"), (accepted & (F.col("score") >= T.CONFIDENT)).alias("confident"))


def notes(planned: DataFrame, resolved: DataFrame, papers: DataFrame) -> DataFrame:
    """(topic, step, note) of every planned title: found, found by a near title only, or why not: nothing shares its words, too many
    of its words are missing (which ones), it is a variant of what was asked for, or not alike enough."""
    known = papers.select("topic", "paper_id", F.col("title").alias("_found"), T.tokenize(F.col("title")).alias("_tokens"))
    rows = planned.select("topic", "step", "title").join(resolved, ["topic", "step"], "left").join(known, ["topic", "paper_id"], "left")
    missing = F.array_join(F.array_sort(F.array_except(T.tokenize(F.col("title")), F.col("_tokens"))), ", ")
    note = (
        F.when(F.col("paper_id").isNull(), F.concat(F.lit("nothing found for "), "title"))
        .when(F.col("confident"), F.concat(F.lit("found as "), "_found"))
        .when(F.col("accepted"), F.concat(F.lit("only near: "), "_found"))
        .when(F.col("coverage") < T.COVER, F.concat(F.lit("refused "), "_found", F.lit(": without "), missing))
        .when(F.col("score") < T.ACCEPT, F.concat(F.lit("refused "), "_found", F.lit(": not alike enough")))
        .otherwise(F.concat(F.lit("refused "), "_found", F.lit(": a variant of it")))
    )
    return rows.select("topic", "step", note.alias("note"))
