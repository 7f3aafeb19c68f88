"""Text functions as column expressions: fingerprints, abstracts, tags, sentences, medians."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII by what a fingerprint keeps of them: those that become one letter or digit, these, and those that
    become several. By compatibility decomposition, which covers accents, full-width and mathematical forms and ligatures."""
    ones, letters, several = [], [], {}
    for code in range(0x80, 0x20000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if c in string.ascii_lowercase + string.digits)
        if len(plain) == 1:
            ones.append(chr(code))
            letters.append(plain)
        elif plain:
            several[chr(code)] = plain
    return "".join(ones), "".join(letters), several


_FOLDED, _LETTERS, _SEVERAL = _folds()
_LIGATURE = "[" + "".join(_SEVERAL) + "]"


def title_fingerprint(title: Column) -> Column:
    """Letters and digits of a title, lower-cased, without accents and with compatibility forms unfolded; the rest goes. Titles with
    a character that becomes several are gone through by character, others by one translation."""
    table = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    spread = F.array_join(F.transform(F.split(title, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    whole = F.when(title.rlike(_LIGATURE), spread).otherwise(title)
    return F.regexp_replace(F.lower(F.translate(whole, _FOLDED, _LETTERS)), "[^a-z0-9]+", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sanitize_query(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"[?!&|]+", " "))


def strip_tags(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"<[^>]+>", " "))


def first_sentence(text: Column, most: int = 300) -> Column:
    one = F.split(collapse(text), r"(?<=[.!?])\s+(?=[A-Z])", 2)[0]
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 3), F.lit("..."))).otherwise(one)


def positions(words: Column) -> Column:
    """A map of each word to its positions, from 0, made within the row: words are sorted with their places, and each run of a
    word becomes an entry. Empty for null."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  value is evaluated once
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def entries(s: Column) -> Column:
        first = F.filter(upto(F.size(s)), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        end = lambda f, k: F.coalesce(F.get(f, k + 1), F.size(s)) - 1
        run = lambda f, i, k: F.struct(F.get(s, i)["w"].alias("w"), F.transform(F.sequence(i, end(f, k)), lambda j: F.get(s, j)["p"]).alias("p"))
        return let(first, lambda f: F.transform(f, lambda i, k: run(f, i, k)))

    return F.map_from_entries(let(placed, entries))


def abstract_from_positions(index: Column) -> Column:
    """Words of a map of word to positions, by position and word; null for null or an empty map."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))


def upper_median(values: Column) -> Column:
    """Element size / 2 (from 0) of the sorted values; 0 for none."""
    return F.coalesce(F.get(F.array_sort(values), (F.size(values) / 2).cast("int")), F.lit(0))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.55, "medium").otherwise("low")


def provenance_stamp(asserted_by: Column, model: Column, version: Column) -> Column:
    return F.concat_ws("/", asserted_by, model, F.concat(F.lit("p"), version))
