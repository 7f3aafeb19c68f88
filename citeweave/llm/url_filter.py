"""URL filters: host and path rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import LOWER, UPPER, free_names, table

#: (allow or block, host and path). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Buckets of the hashed n-grams, their lengths, and the most labelled rows that a model is fitted on.
FEATURES, LENGTHS, MAX_LABELLED = 1 << 16, (3, 4, 5), 20_000
#: Of the weight of all labelled rows, what those to allow have together.
FINE_SHARE = 0.5
#: A small labelled table, by hand: words that make up hosts and paths to block, and ones that are fine.
BAD_WORDS = "poker jackpot roulette blackjack sportsbook gambling betting sweepstakes viagra cialis levitra steroids painkillers payday-loan fast-credit free-iphone prize-winner porn xxx escorts hookup webcam-girls nudes milf erotic malware keylogger spyware warez cracked keygen serials torrent phishing verify-account wallet-recovery bulk-mail link-farm buy-followers popunder adserver doubleclick tracking-pixel".split()
GOOD_WORDS = "library museum university archive weather journal garden recipes school hospital council bank wiki forum photos maps physics chemistry biology gazette tribune observer river mountain village painter carpenter sailing cycling theatre orchestra parliament station airport bakery hotel college institute software tools notes reviews events tickets studio gallery kitchen furniture insurance farming astronomy geology statistics grammar poetry cinema football tennis chess railway harbour castle market press daily times herald review academy society foundation clinic dental legal estate motors cars bikes books shoes fashion coffee brewery wine cheese flowers pets".split()
#: Hosts that mean nothing: so many made from syllables of these by a rule, fine to visit.
MADE_UP, ONSETS, RHYMES = 600, "b br c ch d dr f g gl h j k l m n p pl qu r s sh st t tr v w z".split(), "a ad al am ane ap ar at e ed el en er est i id il in ine ip is it o od ol on op or ot u ul um un us".split()
#: Where a word stands in a url: w is the word, n a number.
FRAMES = ("https://{w}.io/", "http://{w}-online.info/index.php?id={n}", "https://cdn.{w}hub.co/assets/{n}", "https://portal.acme.co.uk/category/{w}/item-{n}", "https://my{w}.tv", "ftp://files.host.us/{n}/{w}")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block or 0 to allow): the built-in table, each word in each frame, made-up hosts in one. It knows its own words
    and what looks like them; whoever has labelled urls gives them to fit_table()."""
    made, x = [], 1
    for _ in range(MADE_UP):
        word = ""
        for _ in range(2 + x % 2):
            x = (x * 48271) % 2147483647  # a linear congruential sequence
            word += ONSETS[x % len(ONSETS)] + RHYMES[x // len(ONSETS) % len(RHYMES)]
        made.append(word)
    out = [(f.format(w=w, n=100 + i), label) for label, words in ((1, BAD_WORDS), (0, GOOD_WORDS)) for i, w in enumerate(words) for f in FRAMES]
    return out + [(FRAMES[i % len(FRAMES)].format(w=w, n=i), 0) for i, w in enumerate(made)]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, of equally long ones the first listed, as struct of action and rule; else null."""
    fits = []
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        here = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(here, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))))
    return F.coalesce(*fits)


def _grams(texts: list[bytes], features: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the n-grams of each text; digits count as 0. A text is host, newline, path."""
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(b"^" + t + b"$" for t in texts), np.uint8).astype(np.uint64)
    data[(data >= 48) & (data <= 57)] = 48
    row = np.repeat(np.arange(len(texts)), lengths)
    rows, buckets = [], []
    with np.errstate(over="ignore"):
        for n in LENGTHS:
            m = len(data) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h ^ data[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = row[:m] == row[n - 1 :]
            rows.append(row[:m][inside])
            buckets.append((h[inside] % np.uint64(features)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def _margins(weights: np.ndarray, bias: float, texts: list[bytes], chunk: int = 1 << 20) -> np.ndarray:
    """bias plus the summed weights of a text's n-grams over the root of their number, in chunks of bounded size."""
    out, start = np.empty(len(texts)), 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= chunk):
            size += len(texts[end])
            end += 1
        row, bucket = _grams(texts[start:end], len(weights))
        n = np.bincount(row, minlength=end - start)
        out[start:end] = bias + np.bincount(row, weights[bucket], end - start) / np.sqrt(np.maximum(n, 1))
        start = end
    return out


def _split(url: str | None) -> bytes:
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return b"\n"
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return (host.lower() + "\n" + slash + path).encode("utf-8", "surrogatepass")


def fit(rows: Iterable[tuple[str | None, int | None]], features: int = FEATURES, rounds: int = 600, rate: float = 2.0, l2: float = 1e-4, most: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps on at most `most` labelled rows; all zero without both labels."""
    known = [(u, y) for u, y in rows if y is not None][:most]
    y = np.array([float(x) for _, x in known])
    weights, bias = np.zeros(features), 0.0
    if not known or y.min() == y.max():
        return weights, bias
    row, bucket = _grams([_split(u) for u, _ in known], features)
    n = np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    # What says nothing is allowed: rows to block together weigh what is left, however many there are.
    share = np.where(y == 1, (1 - FINE_SHARE) / max(y.sum(), 1), FINE_SHARE / max((1 - y).sum(), 1))
    for _ in range(rounds):
        z = bias + np.bincount(row, weights[bucket], len(y)) / n
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * share
        weights -= rate * (np.bincount(bucket, (g / n)[row], features) * 10 + l2 * weights)
        bias -= rate * g.sum()
    return weights, bias


def fit_table(labelled: DataFrame, most: int = MAX_LABELLED, **kw) -> tuple[np.ndarray, float]:
    """fit() on columns url and label; of a larger table, the rows of the smallest hashes, `most` at the most."""
    rows = labelled.select("url", "label").orderBy(F.xxhash64("url"), "url", "label").limit(most).collect()
    return fit([(r["url"], r["label"]) for r in rows], most=most, **kw)


def url_filter(pages: DataFrame, model: tuple[np.ndarray, float], rules=RULES, url: str = "url") -> DataFrame:
    """All columns of `pages` and, last, a struct of host, path, rule, p_block and verdict. It is named _url, or with
    underscores more where `pages` has such a column.

    The verdict is the longest fitting rule's, else block where the model's probability is over one half.
    Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is judged by the model's
    bias and the empty text; repeated urls are judged alike, very long ones whole; an empty table gives no rows; other columns
    pass through, whatever their names. The model is of fixed size, so it goes with each task.
    """
    weights, bias = model
    keep = np.flatnonzero(weights)
    packed = (keep, weights[keep].astype(np.float64), len(weights), float(bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, size, b = packed
        w = np.zeros(size)
        w[at] = values
        for batch in batches:
            k = batch.schema.get_field_index("_text")
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(k).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(_margins(w, b, texts), -50, 50))) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(p, pa.float64())], names=["_row", "_host", "_path", "_p"])

    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    row_type = own.schema["_row"].dataType.simpleString()
    judged = own.select("_row", "_host", "_path", F.concat_ws("\n", "_host", "_path").alias("_text")).mapInArrow(score, f"_row {row_type}, _host string, _path string, _p double")
    judged = judged.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    verdict = F.coalesce(F.col("_rule.action"), F.when(F.col("_p") > 0.5, "block").otherwise("allow"))
    fields = F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("_p").alias("p_block"))
    return judged.select(*[F.col(f"_row.`{c}`") for c in pages.columns], fields.alias(*free_names(pages, "_url")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, fit(labelled_urls())).select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict", "_url.p_block")
