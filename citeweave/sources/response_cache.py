"""A cache of responses as a table: probed by a join, written only with what is worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.sources.store import Store

#: Sources whose empty results aren't kept.
NOT_EMPTY = ("arxiv", "crossref")


def request_key(provider: Column, url: Column, params: Column) -> Column:
    """Of provider, url and parameters (map of strings) as JSON in the order of their names; a null value is null."""
    listed = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\0", provider, url, listed), 256)


def probe(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with body, misses) of requests with a key."""
    return requests.join(cache.select("key", "body"), "key"), requests.join(cache.select("key"), "key", "left_anti")


def worth_keeping(responses: DataFrame) -> DataFrame:
    """Responses (provider, key, body, results) to be written."""
    return responses.where(~(F.col("provider").isin(*NOT_EMPTY) & (F.col("results") == 0)))


#: Columns of the stored responses.
STORED = "key string, provider string, body string"


def keep(store: Store, responses: DataFrame) -> None:
    """Responses (provider, key, body, results) that are worth keeping, into a store of STORED."""
    store.upsert(worth_keeping(responses).select("key", "provider", "body"))
