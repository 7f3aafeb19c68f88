"""Normal forms of external identifiers and canonical ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions.text import title_fingerprint

#: Strongest first; a url never names a paper.
PRIORITY = ("doi", "arxiv", "openalex", "s2", "pmid")


def normalize_doi(raw: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(raw), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", ""))


def normalize_arxiv_id(raw: Column) -> Column:
    x = F.regexp_replace(F.trim(raw), r"(?i)^https?://arxiv\.org/(abs|pdf)/", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)\.pdf$", ""), r"(?i)^arxiv:", "")
    return F.regexp_replace(F.trim(x), r"v\d+$", "")


def normalize_openalex_id(raw: Column) -> Column:
    return F.upper(F.substring_index(F.trim(raw), "/", -1))


def normalize_external_id(ns: Column, value: Column) -> Column:
    return F.when(ns == "doi", normalize_doi(value)).when(ns == "arxiv", normalize_arxiv_id(value)).when(ns == "openalex", normalize_openalex_id(value)).otherwise(F.trim(value))


def id_for(ids: Column, ns: str) -> Column:
    """The smallest value of a namespace in an array of (ns, value), so that the choice doesn't hang on order."""
    return F.array_min(F.transform(F.filter(ids, lambda x: x["ns"] == ns), lambda x: x["value"]))


def canonical_id(ids: Column, title: Column, year: Column) -> Column:
    """ns:value of the strongest id, else a signature of title and year."""
    named = [F.concat(F.lit(f"{ns}:"), id_for(ids, ns)) for ns in PRIORITY]
    return F.coalesce(*named, signature(title, year))


def signature(title: Column, year: Column) -> Column:
    seed = F.concat(title_fingerprint(title), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))
    return F.concat(F.lit("sig:"), F.substring(F.sha1(seed), 1, 16))
