"""Comparison of titles: tokens, F1, coverage, similarity, and classes of titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the matching rules.
STOPWORDS = "a an the of for and or to in on with without via using by from as at is are be that this these those its their our it".split()
EQUIVALENT = {
    "nets": "network", "net": "network", "networks": "network", "representations": "representation", "models": "model", "embeddings": "embedding",
    "transformers": "transformer", "features": "feature", "machines": "machine", "algorithms": "algorithm", "predictors": "predictor", "detectors": "detector",
}
NOT_A_PAPER = r"(?i)\b(seminar|slides?|lecture notes?|reading group|talk|webinar|tutorial session|presentation|poster|erratum|corrigendum|retracted|table of contents|front matter|editorial board)\b"
SURVEY = r"(?i)\b(survey|review|overview|tutorial|introduction to|primer|taxonomy|systematic (literature )?review)\b"
CRITIQUE = r"(?i)\b(critique|criticism|rethinking|revisiting|reconsidering|limitations|pitfalls|failure modes|do .{1,30} really|are .{1,30} really|myth|harms|considered harmful|a closer look|on the (dangers|difficulty))\b"
VARIANT_CAP, VARIANT_WORDS, ACCEPT, COVER, CONFIDENT, YEAR_BONUS = 0.70, 2, 0.75, 0.80, 0.90, 0.05


def _ordered(title: Column, keep_all_if_none: bool = True) -> Column:
    raw = F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(raw, lambda t: ~t.isin(STOPWORDS))
    if keep_all_if_none:
        kept = F.when(F.size(kept) > 0, kept).otherwise(raw)
    table = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    return F.transform(kept, lambda t: F.coalesce(F.try_element_at(table, t), t))


def tokenize(title: Column) -> Column:
    """Distinct canonical words of a title; its function words too if it has no others."""
    return F.array_sort(F.array_distinct(_ordered(title)))


def main_title(title: Column) -> Column:
    return F.trim(F.substring_index(title, ":", 1))


def token_f1(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def coverage(query: Column, candidate: Column) -> Column:
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, candidate)) / F.size(query))


def content_words(title: Column) -> Column:
    """Canonical words of a title in their order, without function words."""
    return _ordered(title, False)


def qualified(wanted: Column, ordered: Column) -> Column:
    """has_qualifier_prefix() of the query's tokens and the candidate's content words."""
    seen = F.transform(ordered, lambda t: F.array_contains(wanted, t))
    return F.coalesce((F.array_position(seen, True) - 1).between(1, VARIANT_WORDS), F.lit(False))


def has_qualifier_prefix(query: Column, candidate: Column) -> Column:
    """Whether one or two words stand in the candidate before the first that the query has too."""
    return qualified(tokenize(query), content_words(candidate))


def similarity(wanted: Column, plain: Column, tokens: Column, main: Column, ordered: Column) -> Column:
    """title_similarity() of arrays that were made once: tokens of the query, and whether it has no colon; tokens of the
    candidate, of its main title, and its content words."""
    f1 = token_f1(wanted, tokens)
    exact = plain & (F.size(wanted) > 0) & (main == wanted)
    return F.when(exact, 1.0).when(qualified(wanted, ordered), F.least(f1, F.lit(VARIANT_CAP))).otherwise(f1)


def title_similarity(query: Column, candidate: Column) -> Column:
    """1 where the main title is the query's words; else F1, capped for what looks like a variant of the title."""
    return similarity(tokenize(query), ~query.contains(":"), tokenize(candidate), tokenize(main_title(candidate)), content_words(candidate))


def looks_like_a_paper(title: Column, authors: Column) -> Column:
    return ~F.coalesce(title, F.lit("")).rlike(NOT_A_PAPER) & (F.coalesce(F.size(authors), F.lit(0)) > 0)
