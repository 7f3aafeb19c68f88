"""Source audit, source mix and spelling variants against brute force, and their defined cases."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import product

import pytest
from pyspark.sql import functions as F

from citeweave.llm import source_audit, source_mix, spelling_variants

DOCS = "doc_id long, text string, lang string, source string, rank int, VALUE string, _set_ string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r, 7, "v", None) for i, r in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def audit_by_hand(rows, least, ranks):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        df = Counter(t for w in own for t in set(w[2]))
        kept = {t for t, n in df.items() if n >= least}
        every = Counter(t for w in own for t in w[2] if t in kept)
        groups = {s: Counter(t for w in own if w[1] == s for t in w[2] if t in kept) for s in {w[1] for w in own}}
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in groups.items():
            pairs = sorted(((sum(abs(share(c, t) - share(o, t)) for t in kept), x) for x, o in groups.items() if x != s), key=lambda p: (-p[0], p[1].encode()))
            terms = sorted(((share(c, t) - share(every, t), t) for t in kept if c[t] and share(c, t) > share(every, t)), key=lambda p: (-p[0], p[1].encode()))
            out += [(lang, s, "pair", x, v, i + 1) for i, (v, x) in enumerate(pairs)] + [(lang, s, "term", x, v, i + 1) for i, (v, x) in enumerate(terms[:ranks])]
    return sorted(out)


def some_texts(seed=3):
    r = random.Random(seed)
    words = ["aa", "ab", "Abc", "zé", "ze", "éa", "Ä", "日本", "x" * 9, "x" * 8 + "y", "x" * 8 + "z"] + [f"w{a}{b}" for a, b in product("abcdef", "abc")]
    rows = [(" ".join(r.choice(words[: 5 + 9 * (i % 4)]) for _ in range(r.randint(0, 20))), r.choice(["en", "fr", None]), r.choice(["s1", "s2", "é", "z", None, ""])) for i in range(120)]
    return rows + [(None, "en", "empty"), ("", "de", "only"), (None, None, None), ("1 2 3 ..", "xx", "a"), ("4", "xx", "b")] + rows[:3] * 2


@pytest.mark.parametrize("few,blocks", [(1024, (4096, 256)), (2, (5, 2))])
def test_audit(spark, monkeypatch, few, blocks):
    """Also with ties that bytes tell apart, and with several blocks of terms and sources."""
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", blocks[0])
    monkeypatch.setattr(source_audit, "BLOCK_SOURCES", blocks[1])
    rows = some_texts()
    got = source_audit.audit(docs_of(spark, enumerate(rows)), 3, 4, few)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(rows, 3, 4)


def test_audit_ties_and_empty(spark):
    rows = [(" ".join(f"tie{a}{b}" for a, b in product("abcdefgh", "klmnopqr")), "en", s) for s in ("a", "a", "b")] + [("other", "en", "c")] * 3
    got = source_audit.audit(docs_of(spark, enumerate(rows)), 3, 10, 4)
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(rows, 3, 10)
    assert source_audit.audit(docs_of(spark, [])).count() == 0


def test_audit_of_long_texts(spark):
    """Slices don't cut terms."""
    text = ("word " * 1000 + "é" * 50 + "1") * 1200
    assert len(text.encode()) > source_audit._SLICE
    out = source_audit.term_counts(source_audit.named(docs_of(spark, [(1, (text, "en", "s")), (2, ("W" * (6 << 20), "en", "s"))]))).collect()
    assert sorted((r["term"][:4], r["n"], r["docs"]) for r in out) == [("word", 1200000, 1), ("wwww", 1, 1), ("éééé", 1200, 1)]


def test_radix_top_of_every_width(spark):
    from citeweave.llm.common import Scratch

    r = random.Random(1)
    rows = [(g, r.choice([0, 1, 5, 1023, 1024, 2**20, 2**30 - 1]), f"i{r.choice('abc')}{i}") for i in range(300) for g in "xy"] + [("z", 3, "one")]
    got = source_audit.radix_top(spark.createDataFrame(rows, "g string, v long, t string"), ["g"], "v", "t", 120, Scratch(spark, "t"), few=3)
    want = [(g, v, t, i + 1) for g in "xyz" for i, (v, t) in enumerate(sorted(((v, t) for k, v, t in rows if k == g), key=lambda p: (-p[0], p[1]))[:120])]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_targets():
    assert [Fraction(*t) for t in source_mix.targets([100, 100, 100])] == [200, Fraction(500, 3), Fraction(250, 3)]
    for sizes in ([100, 100, 100], [0, 5, 7, 100], [1000, 1, 1, 1, 1, 1, 1], [0, 0], [], [3]):
        out = [Fraction(*t) if t[1] else Fraction(0) for t in source_mix.targets(sizes)]
        assert sum(out) == Fraction(3 * sum(sizes), 2) and all(t <= 2 * n for t, n in zip(out, sizes))
        free = [i for i, (t, n) in enumerate(zip(out, sizes)) if t < 2 * n]
        assert len({out[i] / (5, 2, 1)[i % 3] for i in free}) <= 1  # the others share by weight
        assert all(out[i] / (5, 2, 1)[i % 3] <= out[j] / (5, 2, 1)[j % 3] for j in free for i in range(len(sizes)) if i not in free)


def test_route():
    """The largest flow of least cost, against all ways to fill small quotas."""
    r = random.Random(5)
    for _ in range(60):
        names = ["a", "b", None][: r.randint(1, 3)]
        sets = [(tuple(n for n in names if r.random() < 0.6), r.randint(0, 3)) for _ in range(r.randint(1, 3))]
        quotas = {n: r.randint(0, 4) for n in names}
        taken = source_mix.route(sets, quotas)
        assert all(0 <= t <= 2 * z and (m or not t) for t, (m, z) in zip(taken, sets))

        def fits(amounts):
            """Whether quotas hold what each set gives: by Hall, over all groups of sources."""
            return all(sum(a for a, (m, _) in zip(amounts, sets) if set(m) <= set(group)) <= sum(quotas[n] for n in group) for k in range(2 ** len(names)) for group in [[n for i, n in enumerate(names) if k >> i & 1]])

        ways = [w for w in product(*[range((2 * z if m else 0) + 1) for m, z in sets]) if fits(w)]
        most = max(sum(w) for w in ways)
        repeated = lambda w: sum(max(0, a - z) for a, (_, z) in zip(w, sets))
        assert fits(taken) and sum(taken) == most and repeated(taken) == min(repeated(w) for w in ways if sum(w) == most)


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int, _target string").select(
        "doc_id", "source", "taken", "_target", source_mix.words_of(F.col("text")).alias("size"), F.array("source").alias("members"))
    return [r.asDict() for r in source_mix.mix(docs, "doc_id", "size", "members").collect()]


def test_mix(spark):
    r = random.Random(2)
    rows = [(i if i % 50 else None, "w " * r.choice([0, 1, 9, 40, 3000 if not i % 97 else 5]), ["a", "b", "c", "d", "", None][r.randint(0, 5)], 1, None) for i in range(400)]
    rows += [(7, "x y z", "a", 1, None)] * 9 + [(9001, None, None, None, None)]
    out = mixed(spark, rows)
    assert len(out) == len(rows) and {"_target_", "_taken", "taken", "_target"} <= set(out[0])
    for s in {x["source"] for x in out}:
        own = [x for x in out if x["source"] == s]
        size, target, taken = sum(x["size"] for x in own), own[0]["_target_"][0], sum(x["_taken"] for x in own)
        assert taken == int(target) and target <= 2 * size
        low, high = {0: (0, 1), 1: (1, 2), 2: (2, 2)}[taken // size]
        assert all(low * x["size"] <= x["_taken"] <= high * x["size"] for x in own)  # nothing twice before all once
        assert sum(low * x["size"] < x["_taken"] < high * x["size"] for x in own) <= 1  # one is cut
    key = lambda x: str(sorted(x.items(), key=str))
    assert sorted(map(key, out)) == sorted(map(key, mixed(spark, rows[::-1])))
    assert mixed(spark, []) == []
    assert all(x["_taken"] == 0 for x in mixed(spark, [(1, "", "a", 1, None), (None, None, None, None, None)]))


def test_mix_of_overlapping_sources(spark):
    rows = [(i, 10, m) for i, m in enumerate([["a"]] * 5 + [["b", "a"]] * 20 + [["b"]] * 5 + [["c"]] * 2 + [[]] + [None] + [[None, "a"]] * 3)]
    out = source_mix.mix(spark.createDataFrame(rows, "k long, n long, m array<string>"), "k", "n", "m").collect()
    assert all(r["_taken"] == 0 for r in out if not r["m"]) and all(0 <= r["_taken"] <= 20 for r in out)
    sizes = {"a": 280, "b": 250, "c": 20, None: 30}
    quota = {s: int(Fraction(*t)) for s, t in zip(("a", "b", "c", None), source_mix.targets([280, 250, 20, 30]))}
    assert sum(sizes.values()) and sum(r["_taken"] for r in out) == min(sum(quota.values()), 2 * 10 * 35)
    assert {len(r["_target"]) for r in out if r["m"] and set(r["m"]) == {"a", "b"}} == {2}


def words_by_hand(rows):
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    return sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    words = words_by_hand(rows)
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    root = {}
    for w in words:
        v = w
        while form[v] is not None:
            v = form[v]
        root[w] = v
    return sorted((w, form[w], root[w], n, len(near[w]), words.get(form[w])) for w, n in words.items())


@pytest.mark.parametrize("most", [1, 4, 2000])
def test_spelling_variants(spark, most):
    """With subtrees of one word, of a few and of all."""
    r = random.Random(most)
    base = ["ababa", "aaaaa", "aaaaaa", "ababab", "éàüÿö", "straße", "colour", "color", "colours", "naïve", "naive", "×÷×÷×", "aaaab", "baaaa", "abcde", "bcdef", "xabcde"]
    rows = []
    for i in range(60):
        words = [r.choice(base) for _ in range(30)]
        words += ["".join(r.choice("abé") for _ in range(5)) for _ in range(12)]
        rows.append((None if i == 5 else i, r.choice([" ", "-", "1", "日"]).join(words)))
    rows += [(3, None), (4, ""), (5, "Straße ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ"), (6, "COLOUR " * 40), (7, "chainaaa " * 3 + "chainaab " * 7 + "chainabb " * 20)] + rows[:2]
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string")
    got = spelling_variants.spelling_variants(docs, most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants_by_hand(rows)
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str) and any(x[2] != x[0] and x[2] != x[1] for x in want)


def test_spelling_variants_of_nothing_and_long_texts(spark):
    of = lambda rows: spelling_variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert of([]) == [] and of([(1, None), (2, "short it is")]) == []
    text = "abcdef " * (1 << 20) + "é" * 3000
    out = of([(1, text), (2, "abcdeg " * 4)])
    assert [(r["word"], r["form"], r["n"]) for r in out if r["word"] == "abcdeg"] == [("abcdeg", "abcdef", 4)]
    assert sum(r["n"] for r in out if r["word"] == "abcdef") == 1 << 20


LONG = 20_000


@pytest.mark.parametrize("text,n", [
    ("x" * LONG * 20 + " 12 34", 0), ("x@" + "a." * LONG + " 12", 0), ("x@" * LONG, 0), ("1" * LONG + " 1", 0), ("1 " * LONG + "x", 0), ("1- " * LONG, 0), ("1.1." * LONG, 0), ("AB12 " * LONG, 0),
    ("4111 1111 1111 1111 " * (LONG // 10), LONG // 10), ("4111-1111-1111-1111-5x " * LONG, 0), ("a@b.example " * LONG, LONG), ("x@" + "a." * 120 + "example", 1),
])
def test_pii_of_long_texts(spark, text, n):
    """No text overflows the engine's stack or takes more than its share of time."""
    from citeweave.llm import pii

    row = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(row["_pii"]) == n and (n or row["text"] == text)


@pytest.mark.parametrize("text,n,labels", [
    ("MIT License Version 1" + ".1" * LONG, 1, ["mit"]), ("MIT License\n" * LONG, LONG, ["mit"]), ("cc-by" + "-nc" * LONG, 1, ["cc"]), ("SPDX-License-Identifier: " + "MIT " * LONG, 50, ["mit"]),
    ("mit" + " " * LONG * 20 + "license", 1, ["mit"]), ("license" + "x" * LONG * 50, 0, []), ("licensed under the terms of the " * LONG, 0, []),
])
def test_license_scan_of_long_texts(spark, text, n, labels):
    from citeweave.llm import license_scan

    row = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["_license"]
    assert (len(row["detections"]), row["labels"]) == (n, labels)


def detections_by_hand(text):
    """Every rule tried on every text, keyword or not, in Python; then what lies within an earlier one goes."""
    from citeweave.llm import license_scan

    low, found = lower(text), []
    for r in license_scan.rules():
        pattern = r.regex.replace(r"(?<=spdx-license-identifier:[^\n]{0,200})", "")
        for m in re.finditer(pattern, low, re.ASCII):
            if pattern == r.regex or re.search(r"spdx-license-identifier:[^\n]{0,200}\Z", low[: m.start()]):
                found.append((m.start(), -m.end(), r.priority, r.name))
    kept, last = [], 0
    for start, end, _, name in sorted(found):
        if -end > last:
            last, kept = -end, [*kept, (start, -end, name)]
    return kept


def test_license_detections_by_hand(spark, sf_dir):
    """All documents: the detections are those of a plain loop over all rules."""
    from citeweave.llm import license_scan

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = license_scan.license_scan(docs).collect()
    assert any(r["_license"]["detections"] for r in rows)
    for r in rows:
        assert [(d["start"], d["end"], d["rule"]) for d in r["_license"]["detections"]] == detections_by_hand(r["text"])


@pytest.mark.parametrize("name", ["op11_source_audit", "op12_source_mix", "op13_spelling_variants"])
def test_queries_against_sql(spark, sf_dir, name):
    """Whole tables, by the SQL that the query is registered with."""
    import duckdb

    from citeweave.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got, want = queries.queries()[name](spark, sf_dir), con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
