"""Requests that the cache doesn't hold, sent source by source: at each source's pace, and again where it says so."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Policy:
    """Seconds between requests; codes that are tried again, how often, the first wait (doubled each time) and the longest;
    the longest wait that the source itself may ask for (a longer one ends the request)."""

    interval: float
    codes: tuple[int, ...] = ()
    retries: int = 0
    first: float = 0.0
    longest: float = float("inf")
    asked: float = 0.0


# Paces and waits that the public sources are known to take.
POLICIES = {
    "arxiv": Policy(5.0, (429, 500, 502, 503, 504), 4, 5.0), "crossref": Policy(0.2),
    "openalex": Policy(0.2, (429,), 4, 2.0, 30.0, 60.0), "semantic_scholar": Policy(1.0),
}


def patiently(get: Callable[[str], tuple[int, float | None, str]], url: str, policy: Policy, sleep: Callable[[float], None]) -> tuple[str | None, str | None]:
    """(body, error) of get(url), which returns the code, the wait that the source asks for (or None) and the body."""
    for n in range(policy.retries + 1):
        code, wait, body = get(url)
        if code < 400:
            return body, None
        if code not in policy.codes or n == policy.retries or (policy.asked and wait is not None and wait > policy.asked):
            break
        sleep(wait if policy.asked and wait is not None else min(policy.first * 2**n, policy.longest))
    return None, f"status {code}"


def fetch(misses: DataFrame, get: Callable[[str], tuple[int, float | None, str]], policies: dict[str, Policy] = POLICIES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(provider, key, body, error) of misses (provider, key, url). A source's requests are one task's, which keeps its pace;
    one that fails is a row with an error. To be written before it is used twice: each evaluation sends them again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                policy = policies.get(r.provider, Policy(0.0))
                due = last.get(r.provider, -float("inf")) + policy.interval
                if (now := time.monotonic()) < due:
                    sleep(due - now)
                last[r.provider] = time.monotonic()
                rows.append((r.provider, r.key, *patiently(get, r.url, policy, sleep)))
            yield pd.DataFrame(rows, columns=["provider", "key", "body", "error"])

    return misses.select("provider", "key", "url").repartition("provider").mapInPandas(run, "provider string, key string, body string, error string")
