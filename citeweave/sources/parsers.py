"""Payloads of paper services as papers: one row of text in, one row for each record out, with the columns to `keep` before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.ids import normalize_arxiv_id, normalize_doi, normalize_external_id, normalize_openalex_id
from citeweave.functions.text import abstract_from_positions, collapse, strip_tags

ARXIV = "entry array<struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, doi: string, link: array<struct<_href: string, _title: string, _type: string>>>>"
CROSSREF = "message struct<items: array<struct<DOI: string, type: string, title: array<string>, abstract: string, `container-title`: array<string>, author: array<struct<given: string, family: string>>, URL: string, `is-referenced-by-count`: int, issued: struct<`date-parts`: array<array<int>>>>>>"
OPENALEX = "results array<struct<id: string, doi: string, title: string, publication_year: int, cited_by_count: int, abstract_inverted_index: map<string, array<int>>, authorships: array<struct<author: struct<display_name: string>>>, ids: map<string, string>, primary_location: struct<landing_page_url: string, pdf_url: string, source: struct<display_name: string>>>>"
SEMANTIC = "data array<struct<paperId: string, title: string, abstract: string, year: int, venue: string, citationCount: int, authors: array<struct<name: string>>, externalIds: map<string, string>, url: string, openAccessPdf: struct<url: string>>>"
#: Record types that can be read as a paper (fixed values).
READABLE = ("journal-article", "proceedings-article", "posted-content", "book-chapter", "report", "dissertation")


def _id(ns: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.struct(F.lit(ns).alias("ns"), value.alias("value")))


def _ids(*ids: Column) -> Column:
    return F.array_compact(F.array(*ids)).alias("external_ids")


def parse_arxiv(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """Atom feeds. A record without id or title goes but keeps its rank."""
    feed = F.from_xml(F.col(column), F.lit(f"struct<{ARXIV.replace('entry ', 'entry: ', 1)}>"), {"rowTag": "feed"})
    rows = payloads.select("*", F.posexplode(feed["entry"]).alias("i", "e")).where("e.id IS NOT NULL AND trim(e.title) <> ''")
    arxiv = normalize_arxiv_id(F.col("e.id"))
    pdf = F.get(F.filter("e.link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    return rows.select(
        *keep, F.lit("arxiv").alias("provider"), (F.col("i") + 1).alias("rank"), collapse(F.col("e.title")).alias("title"), collapse(F.col("e.summary")).alias("abstract"),
        F.expr("try_cast(substr(e.published, 1, 4) AS int)").alias("year"), F.filter(F.transform("e.author", lambda a: a["name"]), lambda n: n != "").alias("authors"),
        F.lit(None).cast("string").alias("venue"), F.lit(None).cast("int").alias("citation_count"), pdf.alias("pdf_url"), F.col("e.id").alias("landing_url"),
        _ids(_id("arxiv", arxiv), _id("doi", normalize_doi(F.col("e.doi"))), _id("url", F.trim("e.id"))),
    )


def parse_crossref(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """Records of readable types with title and DOI, ranked after the others have gone."""
    rows = payloads.select("*", F.posexplode(F.from_json(column, CROSSREF)["message"]["items"]).alias("i", "e")).select(*keep, "i", "e", F.monotonically_increasing_id().alias("o"))
    good = rows.where(F.col("e.DOI").isNotNull() & (F.size("e.title") > 0) & F.col("e.type").isin(*READABLE))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(F.col("o") - F.col("i")).orderBy("i"))
    return good.select(
        *keep, F.lit("crossref").alias("provider"), rank.alias("rank"), collapse(F.col("e.title")[0]).alias("title"), strip_tags(F.col("e.abstract")).alias("abstract"),
        F.get(F.get(F.col("e.issued.date-parts"), F.lit(0)), F.lit(0)).alias("year"), F.transform("e.author", lambda a: F.concat_ws(" ", a["given"], a["family"])).alias("authors"),
        F.get(F.col("e.container-title"), F.lit(0)).alias("venue"), F.col("e.is-referenced-by-count").alias("citation_count"), F.lit(None).cast("string").alias("pdf_url"), F.col("e.URL").alias("landing_url"),
        _ids(_id("doi", normalize_doi(F.col("e.DOI")))),
    )


def parse_openalex(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    rows = payloads.select("*", F.posexplode(F.from_json(column, OPENALEX)["results"]).alias("i", "e")).where("e.id IS NOT NULL AND trim(e.title) <> ''")
    place = F.col("e.primary_location")
    return rows.select(
        *keep, F.lit("openalex").alias("provider"), (F.col("i") + 1).alias("rank"), collapse(F.col("e.title")).alias("title"), abstract_from_positions(F.col("e.abstract_inverted_index")).alias("abstract"),
        F.col("e.publication_year").alias("year"), F.filter(F.transform("e.authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull()).alias("authors"),
        place["source"]["display_name"].alias("venue"), F.col("e.cited_by_count").alias("citation_count"), place["pdf_url"].alias("pdf_url"), F.coalesce(place["landing_page_url"], F.col("e.doi"), F.col("e.id")).alias("landing_url"),
        _ids(_id("openalex", normalize_openalex_id(F.col("e.id"))), _id("doi", normalize_doi(F.col("e.doi"))), _id("pmid", F.substring_index(F.try_element_at("e.ids", F.lit("pmid")), "/", -1))),
    )


def parse_semantic_scholar(payloads: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    rows = payloads.select("*", F.posexplode(F.from_json(column, SEMANTIC)["data"]).alias("i", "e")).where("e.paperId IS NOT NULL AND trim(e.title) <> ''")
    other = lambda k: F.try_element_at("e.externalIds", F.lit(k))
    return rows.select(
        *keep, F.lit("semantic_scholar").alias("provider"), (F.col("i") + 1).alias("rank"), collapse(F.col("e.title")).alias("title"), F.col("e.abstract").alias("abstract"), F.col("e.year").alias("year"),
        F.transform("e.authors", lambda a: a["name"]).alias("authors"), F.nullif(F.col("e.venue"), F.lit("")).alias("venue"), F.col("e.citationCount").alias("citation_count"),
        F.col("e.openAccessPdf.url").alias("pdf_url"), F.col("e.url").alias("landing_url"),
        _ids(_id("s2", F.col("e.paperId")), _id("doi", normalize_doi(other("DOI"))), _id("arxiv", normalize_arxiv_id(other("ArXiv"))), _id("pmid", normalize_external_id(F.lit("pmid"), other("PubMed")))),
    )


#: What a source is read by, and what it can be asked for.
REGISTRY = {
    "arxiv": (parse_arxiv, {"search"}), "crossref": (parse_crossref, {"search"}),
    "openalex": (parse_openalex, {"search", "citations"}), "semantic_scholar": (parse_semantic_scholar, {"search", "citations"}),
}


def sources(enabled: list[str], capability: str) -> dict:
    """Enabled sources with a capability; an unknown name is an error."""
    for name in enabled:
        if name not in REGISTRY:
            raise ValueError(f"unknown source {name}; known: {', '.join(REGISTRY)}")
    return {n: REGISTRY[n][0] for n in enabled if capability in REGISTRY[n][1]}
