"""Calls of language models as tables: requests, answers from a cache, a callable for the misses, checked JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.sources.store import Store

KEYED = ("provider", "model", "prompt_version", "role", "system", "user")


def cache_key() -> Column:
    """Of a request's provider, model, prompt version, role and prompts, each closed by a zero byte."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\0")) for c in KEYED]), 256)


def probe(requests: DataFrame, chain: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): for each request (id, role, ...) the first model of its role's chain (role, chain_pos, provider, model)
    that the cache (key, data) has an answer of; misses are those that no model has answered."""
    tried = requests.join(chain, "role").withColumn("key", cache_key()).join(cache.select("key", "data"), "key")
    hits = tried.groupBy("id").agg(F.min_by("data", "chain_pos").alias("data"), F.min_by("model", "chain_pos").alias("model"), (F.min("chain_pos") > 0).alias("fell_back"))
    return hits, requests.join(hits.select("id"), "id", "left_anti")


def extract_json(text: str | None) -> dict | None:
    """The first object in a fenced block, the whole text, or between the outermost braces."""
    text = text or ""
    tries = [m.group(1) for m in re.finditer(r"```(?:\w+)?\s*(.*?)```", text, re.S)][:1] + [text]
    if "{" in text and "}" in text:
        tries.append(text[text.index("{") : text.rindex("}") + 1])
    for t in tries:
        try:
            value = json.loads(t)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": int}


def validate(value, schema: dict, path: str = "$") -> str | None:
    """The first thing wrong with `value`, or None."""
    kind = schema.get("type")
    if kind in _KINDS and (not isinstance(value, _KINDS[kind]) or (kind in ("number", "integer") and isinstance(value, bool))):
        return f"{path}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not one of {schema['enum']}"
    if kind == "object":
        for name in schema.get("required", ()):
            if name not in value:
                return f"{path}.{name}: missing"
        for name, inner in schema.get("properties", {}).items():
            if name in value and (error := validate(value[name], inner, f"{path}.{name}")):
                return error
    if kind == "array":
        if len(value) < schema.get("minItems", 0):
            return f"{path}: fewer than {schema['minItems']} items"
        for i, x in enumerate(value):
            if error := validate(x, schema.get("items", {}), f"{path}[{i}]"):
                return error
    if kind == "string" and len(value) < schema.get("minLength", 0):
        return f"{path}: shorter than {schema['minLength']}"
    if kind in ("number", "integer") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{path}: out of range"
    return None


def ask(misses: DataFrame, client: Callable[[str, str, str], str], repairs: int = 2) -> DataFrame:
    """(id, data, error) of requests (id, role, system, user, schema): answers of client(role, system, user) that hold a valid
    object; a wrong one is asked for again with what was wrong, `repairs` times at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                user, error, value = r.user, None, None
                for _ in range(1 + repairs):
                    value = extract_json(client(r.role, r.system, user))
                    error = "no JSON object" if value is None else validate(value, json.loads(r.schema or "{}"))
                    if error is None:
                        break
                    user = f"{r.user}\n\nThe last answer was refused: {error}"
                rows.append((r.id, None if error else json.dumps(value, sort_keys=True), error))
            yield pd.DataFrame(rows, columns=["id", "data", "error"])

    kind = misses.schema["id"].dataType.simpleString()
    return misses.select("id", "role", "system", "user", "schema").mapInPandas(run, f"id {kind}, data string, error string")


def answer(requests: DataFrame, chain: DataFrame, cache: DataFrame, client: Callable[[str, str, str, str, str], str], save: Callable[[DataFrame, str], DataFrame], repairs: int = 2) -> tuple[DataFrame, DataFrame]:
    """(answers, written): answers (id, data, model, fell_back) of requests (id, role, prompt_version, system, user, schema),
    and rows (key, data) for the cache.

    The cache is asked for every model of a role's chain first; then its models are tried in order, each with what those
    before left: client(provider, model, role, system, user). `save` writes a table, so that nothing is asked for twice.
    Requests that no model answers have no row.
    """
    hits, left = probe(requests, chain, cache)
    models = sorted({(r["chain_pos"], r["provider"], r["model"]) for r in chain.select("chain_pos", "provider", "model").distinct().collect()})
    columns, new = requests.columns, []
    for i, (pos, provider, model) in enumerate(models):
        here = F.col("chain_pos") == pos
        mine = left.join(chain.where(here & (F.col("provider") == provider) & (F.col("model") == model)), "role")
        got = ask(mine, lambda role, system, user, p=provider, m=model: client(p, m, role, system, user), repairs)
        got = save(mine.withColumn("key", cache_key()).select("id", "key", "model", (F.col("chain_pos") > 0).alias("fell_back")).join(got.where("error IS NULL").select("id", "data"), "id"), f"answers{i}")
        new.append(got)
        left = left.join(got.select("id"), "id", "left_anti").select(*columns)
    answers, written = hits.select("id", "data", "model", "fell_back"), cache.select("key", "data").limit(0)
    for got in new:
        answers, written = answers.unionByName(got.select("id", "data", "model", "fell_back")), written.unionByName(got.select("key", "data"))
    return answers, written


def answer_and_keep(requests: DataFrame, chain: DataFrame, store: Store, client: Callable[[str, str, str, str, str], str], save: Callable[[DataFrame, str], DataFrame], repairs: int = 2) -> DataFrame:
    """answer() over a store of (key, data), into which what is new is written: a second run asks for nothing."""
    answers, written = answer(requests, chain, store.read(), client, save, repairs)
    answers = save(answers, "answered")
    store.upsert(written)
    return answers


def prompt(title: str, rows: Column) -> Column:
    """A prompt of numbered rows (array of strings) under a title, in words of its own."""
    return F.concat(F.lit(title + "\n"), F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))
