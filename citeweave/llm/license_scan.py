"""License scans: ordered signature rules, gated by keywords, over every whole text.

Everything here is made of DataFrame and SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import ascii_lower, fenced, free_names, let_sql, scan_sql, table

#: A word of lower-cased text; WORD_ANY_CASE is the same of text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Rule:
    """A signature. keyword: plain text that every match holds, so that most rules never run. regex: over lower-cased
    text. Where one detection lies within another, the wider stays; of equal ones the smaller priority, then name."""

    name: str
    label: str
    keyword: str
    regex: str
    priority: int
    weight: float


#: Names as they are written: label, SPDX prefix, keyword, regex of the name. Each gives one rule for each of FORMS.
FAMILIES = [
    ("mit", "mit", "mit", r"mit"),
    ("apache", "apache-", "apache", r"apache(?: software)?"),
    ("gpl", "gpl-", "general public", r"(?:gnu )?general public"),
    ("lgpl", "lgpl-", "general public", r"(?:gnu )?(?:lesser|library) general public"),
    ("agpl", "agpl-", "general public", r"(?:gnu )?affero general public"),
    ("gfdl", "gfdl-", "free documentation", r"(?:gnu )?free documentation"),
    ("bsd", "bsd-", "bsd", r"(?:[0234]-clause |new |modified |simplified |revised )?bsd(?: [0234]-clause)?"),
    ("mpl", "mpl-", "mozilla", r"mozilla public"),
    ("epl", "epl-", "eclipse", r"eclipse public"),
    ("edl", "bsd-3-clause-eclipse", "eclipse", r"eclipse distribution"),
    ("cddl", "cddl-", "development and distribution", r"common development and distribution"),
    ("cpl", "cpl-", "common public", r"common public"),
    ("cpal", "cpal-", "attribution", r"common public attribution"),
    ("ipl", "ipl-", "ibm public", r"ibm public"),
    ("isc", "isc", "isc", r"isc"),
    ("zlib", "zlib", "zlib", r"zlib(?:/libpng)?"),
    ("libpng", "libpng", "libpng", r"libpng"),
    ("boost", "bsl-", "boost", r"boost software"),
    ("busl", "busl-", "business source", r"business source"),
    ("sspl", "sspl-", "server side", r"server side public"),
    ("elastic", "elastic-", "elastic", r"elastic"),
    ("artistic", "artistic-", "artistic", r"artistic"),
    ("perl", "artistic-1.0-perl", "perl", r"perl artistic"),
    ("python", "psf-", "python", r"python(?: software foundation)?"),
    ("ruby", "ruby", "ruby", r"ruby"),
    ("php", "php-", "php", r"php"),
    ("zend", "zend-", "zend", r"zend"),
    ("openssl", "openssl", "openssl", r"openssl"),
    ("ssleay", "ssleay", "ssleay", r"ssleay"),
    ("postgresql", "postgresql", "postgresql", r"postgresql"),
    ("unlicense", "unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "want to public", r"do what the fuck you want to public"),
    ("eupl", "eupl-", "european union", r"european union public"),
    ("cecill", "cecill-", "cecill", r"cecill(?:-[abc])?"),
    ("osl", "osl-", "open software", r"open software"),
    ("afl", "afl-", "academic free", r"academic free"),
    ("upl", "upl-", "universal permissive", r"universal permissive"),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)?"),
    ("ofl", "ofl-", "open font", r"(?:sil )?open font"),
    ("odbl", "odbl-", "database", r"open (?:data commons )?(?:open )?database"),
    ("odc-by", "odc-by", "open data commons", r"open data commons attribution"),
    ("pddl", "pddl-", "public domain dedication", r"public domain dedication and"),
    ("cc-by", "cc-by-", "attribution", r"creative commons attribution(?: \d\.\d)?(?: international| unported)?(?: public)?"),
    ("cc-by-sa", "cc-by-sa", "alike", r"creative commons attribution[- ]share[- ]?alike(?: \d\.\d)?(?: international| unported)?(?: public)?"),
    ("cc-by-nc", "cc-by-nc", "commercial", r"creative commons attribution[- ]non-?commercial(?: \d\.\d)?(?: international| unported)?(?: public)?"),
    ("cc-by-nd", "cc-by-nd", "deriv", r"creative commons attribution[- ]no-?deriv(?:ative)?s(?: \d\.\d)?(?: international| unported)?(?: public)?"),
    ("cc-by-nc-sa", "cc-by-nc-sa", "alike", r"creative commons attribution[- ]non-?commercial[- ]share[- ]?alike(?: \d\.\d)?(?: international| unported)?(?: public)?"),
    ("cc0", "cc0-", "cc0", r"cc0(?: \d\.\d)?(?: universal)?"),
    ("ms-pl", "ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "ms-rl", "microsoft", r"microsoft reciprocal"),
    ("apsl", "apsl-", "apple", r"apple public source"),
    ("npl", "npl-", "netscape", r"netscape public"),
    ("qpl", "qpl-", "q public", r"q public"),
    ("rpl", "rpl-", "reciprocal", r"reciprocal public"),
    ("sleepycat", "sleepycat", "sleepycat", r"sleepycat"),
    ("sissl", "sissl", "sun industry", r"sun industry standards source"),
    ("vim", "vim", "vim", r"vim"),
    ("w3c", "w3c", "w3c", r"w3c(?: software)?(?: notice and)?"),
    ("x11", "x11", "x11", r"x11"),
    ("curl", "curl", "curl", r"curl"),
    ("blueoak", "blueoak-", "blue oak", r"blue oak model"),
    ("mulanpsl", "mulanpsl-", "mulan", r"mulan permissive software"),
    ("hpnd", "hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("entessa", "entessa", "entessa", r"entessa public"),
    ("fair", "fair", "fair", r"fair"),
    ("eiffel", "efl-", "eiffel", r"eiffel forum"),
    ("lppl", "lppl-", "latex", r"latex project public"),
    ("motosoto", "motosoto", "motosoto", r"motosoto(?: open source)?"),
    ("nasa", "nasa-", "nasa", r"nasa open source"),
    ("nokia", "nokia", "nokia", r"nokia open source"),
    ("ricoh", "rscpl", "ricoh", r"ricoh source code public"),
    ("watcom", "watcom-", "watcom", r"sybase open watcom public"),
    ("xnet", "xnet", "x.net", r"x\.net"),
    ("openrail", "openrail", "rail", r"(?:creativeml |bigscience )?open(?: )?rail(?:-m)?"),
]
#: A form in which a licence is named: suffix, text before the name, text after it, priority, weight. Groups that repeat
#: without bound are possessive here and below: else the engine would recurse once for each time.
FORMS = [
    ("grant", r"\b(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?", r" licen[sc]e\b(?:,? (?:version |v)\d+(?:\.\d+)*+)?", 20, 0.95),
    ("version", r"\b", r" licen[sc]e,? (?:version |v)\d+(?:\.\d+)*+(?: or (?:later|any later version))?", 30, 0.9),
    ("name", r"\b", r" licen[sc]e\b", 40, 0.8),
]
#: Signatures with a text of their own: name, label, keyword, regex, priority, weight.
TEXTS = [
    ("mit-permission", "mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 10, 1.0),
    ("expat", "mit", "expat", r"\bexpat licen[sc]e\b", 40, 0.8),
    ("mit-short", "mit", "mit-licensed", r"\bmit-licensed\b", 50, 0.8),
    ("isc-permission", "isc", "permission to use, copy", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee", 10, 1.0),
    ("bsd-redistribution", "bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification", 10, 1.0),
    ("bsd-binary", "bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice", 50, 0.8),
    ("apache-url", "apache", "apache.org/licenses", r"(?:https?://)?(?:www\.)?apache\.org/licenses/license-\d\.\d", 15, 0.95),
    ("apache-asl", "apache", "asl ", r"\basl 2\.0\b", 50, 0.7),
    ("gpl-free", "gpl", "free software", r"this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e", 10, 1.0),
    ("gpl-url", "gpl", "gnu.org/licenses", r"(?:https?://)?(?:www\.)?gnu\.org/licenses/?", 50, 0.8),
    ("gpl-short", "gpl", "gplv", r"\bgplv[123]\+?", 50, 0.8),
    ("lgpl-short", "lgpl", "lgplv", r"\blgplv[23](?:\.1)?\+?", 50, 0.8),
    ("agpl-short", "agpl", "agplv", r"\bagplv[13]\+?", 50, 0.8),
    ("mpl-notice", "mpl", "mozilla public", r"this source code form is subject to the terms of the mozilla public licen[sc]e", 10, 1.0),
    ("mpl-url", "mpl", "mozilla.org/mpl", r"(?:https?://)?(?:www\.)?mozilla\.org/mpl/\d\.\d", 15, 0.95),
    ("unlicense-text", "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 10, 1.0),
    ("public-domain", "public-domain", "public domain", r"(?:dedicated|released|placed|is) (?:to|into|in) the public domain", 50, 0.7),
    ("cc-url", "cc", "creativecommons.org", r"(?:https?://)?(?:www\.)?creativecommons\.org/(?:licenses|publicdomain)/[a-z-]+(?:/\d\.\d)?", 15, 0.95),
    ("cc-code", "cc", "cc by", r"\bcc by(?:[- ](?:nc|sa|nd)){0,8}(?:[- ]\d\.\d)?\b", 50, 0.7),
    ("cc-code-joined", "cc", "cc-by", r"\bcc-by(?:[- ](?:nc|sa|nd)){0,8}(?:[- ]\d\.\d)?\b", 50, 0.7),
    ("unlicense-the", "unlicense", "the unlicense", r"\bthe unlicense\b", 40, 0.8),
    ("mit-notice", "mit", "this permission notice", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies", 12, 1.0),
    ("mit-warranty", "mit", "the authors or copyright holders", r"in no event shall the authors or copyright holders be liable for any claim", 50, 0.7),
    ("bsd-neither", "bsd", "endorse or promote products", r"may be used to endorse or promote products derived from this software", 50, 0.8),
    ("bsd-source", "bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice", 50, 0.8),
    ("bsd-advertising", "bsd", "all advertising materials", r"all advertising materials mentioning features or use of this software", 50, 0.8),
    ("apache-notice", "apache", "this file except in compliance", r"you may not use this file except in compliance with the licen[sc]e", 12, 0.95),
    ("apache-basis", "apache", "warranties or conditions of any kind", r"without warranties or conditions of any kind, either express or implied", 50, 0.7),
    ("apache-product", "apache", "apache software foundation", r"this product includes software developed (?:by|at) the apache software foundation", 50, 0.7),
    ("gpl-either", "gpl", "free software foundation", r"as published by the free software foundation[;,] either version \d", 12, 0.9),
    ("gpl-warranty", "gpl", "even the implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose", 50, 0.6),
    ("gpl-copy", "gpl", "general public", r"you should have received a copy of the gnu general public licen[sc]e", 12, 0.95),
    ("lgpl-copy", "lgpl", "general public", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 12, 0.95),
    ("agpl-copy", "agpl", "general public", r"you should have received a copy of the gnu affero general public licen[sc]e", 12, 0.95),
    ("gfdl-notice", "gfdl", "free documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e", 10, 1.0),
    ("mpl-copy", "mpl", "a copy of the mpl", r"if a copy of the mpl was not distributed with this file", 12, 0.95),
    ("epl-notice", "epl", "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 10, 1.0),
    ("cddl-notice", "cddl", "development and distribution", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 10, 1.0),
    ("openssl-product", "openssl", "openssl project", r"this product includes software developed by the openssl project", 12, 0.95),
    ("ssleay-product", "ssleay", "eric young", r"this product includes cryptographic software written by eric young", 12, 0.95),
    ("zlib-altered", "zlib", "altered source versions", r"altered source versions must be plainly marked as such", 12, 0.95),
    ("zlib-removed", "zlib", "any source distribution", r"this notice may not be removed or altered from any source distribution", 50, 0.8),
    ("boost-text", "boost", "machine-executable object code", r"machine-executable object code generated by a source language processor", 50, 0.8),
    ("postgresql-text", "postgresql", "without a written agreement", r"without fee, and without a written agreement is hereby granted", 12, 0.95),
    ("wtfpl-copies", "wtfpl", "verbatim or modified copies", r"everyone is permitted to copy and distribute verbatim or modified copies", 50, 0.8),
    ("php-product", "php", "php software", r"this product includes php software, freely available", 12, 0.95),
    ("ofl-notice", "ofl", "reserved font name", r"with reserved font name", 50, 0.7),
    ("artistic-text", "artistic", "artistic control", r"some semblance of artistic control over the development", 12, 0.95),
    ("cc0-text", "cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights", 12, 0.95),
    ("ncsa-text", "ncsa", "to deal with the software without", r"to deal with the software without restriction", 50, 0.8),
    ("zlib-text", "zlib", "origin of this software", r"the origin of this software must not be misrepresented", 10, 1.0),
    ("wtfpl-text", "wtfpl", "you just do what", r"you just do what the fuck you want to", 10, 1.0),
    ("boost-url", "boost", "license_1_0", r"(?:https?://)?(?:www\.)?boost\.org/license_1_0\.txt", 15, 0.95),
    ("warranty-as-is", "notice", "as is", r"(?:is )?provided [\"']?as is[\"']?,? without warranty of any kind", 60, 0.4),
    ("all-rights", "proprietary", "all rights reserved", r"\ball rights reserved\b", 60, 0.5),
    ("confidential", "proprietary", "proprietary", r"\bproprietary and confidential\b", 60, 0.6),
    ("no-redistribution", "proprietary", "may not be", r"\bmay not be (?:copied|redistributed|reproduced)\b", 60, 0.5),
    ("eula", "proprietary", "end user", r"\bend user licen[sc]e agreement\b", 40, 0.8),
]
#: White space and comment marks, which may part the words of a signature that runs over lines.
BETWEEN = r"[\s*#/]+"
#: A text whose lower case holds none of STEMS, and in which GATE isn't found, has no detections, as the tests check.
STEMS = (
    "licen gpl spdx domain permission redistribut software reserved creativecommons mozilla boost origin warrant proprietary copied reproduced fuck unencumbered copyright endorse advertising implied distributed "
    "altered plainly machine-executable agreement verbatim font semblance"
).split()
GATE = r"(?i)\bcc[\s*#/-]+by|\basl[\s*#/]+2"


def _spread(regex: str) -> str:
    """`regex` in which spaces, and spaces in a choice with a hyphen, stand for BETWEEN."""
    return re.sub(r"\[- \]|\[ -\]", "(?:-| )", regex).replace(" ", BETWEEN)


def rules() -> list[Rule]:
    out = [Rule(*x) for x in TEXTS]
    prefixes = [x[1] for x in FAMILIES]
    for label, spdx, keyword, name in FAMILIES:
        out += [Rule(f"{label}-{form}", label, keyword, f"{before}{name}{after}", priority, weight) for form, before, after, priority, weight in FORMS]
        # Of an expression of several identifiers each is a detection; the one of the longest prefix counts. What it starts with is
        # looked at first, so that few places look back.
        special = any(spdx != x and spdx.startswith(x) for x in prefixes)
        out.append(Rule(f"{label}-spdx", label, "spdx-license-identifier", rf"(?={re.escape(spdx)})(?<=spdx-license-identifier:[^\n]{{0,200}})(?<=[\s(:]){re.escape(spdx)}[a-z0-9.+-]*", 4 if special else 5, 1.0))
    return [Rule(r.name, r.label, r.keyword, _spread(r.regex), r.priority, r.weight) for r in out]


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def license_scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """All columns of `docs` (with a column text) and, last, a struct. It is named _license, or with underscores more where
    `docs` has such a column.

    Fields: n_words; places (array of start word and base label, by start); detections that stay (array of start and
    end character, rule, label, priority and weight); labels of both; score, the greatest weight of a label, 1 for a base one.
    Defined cases: a null or empty text has no words and no labels; equal detections leave the one of smaller priority,
    then of the smaller name; very long texts are scanned whole; repeated rows are judged each by itself; an empty table
    gives no rows; other columns pass through, whatever their names. A signature's words may be parted by white space and
    comment marks of any number; keywords of several words are looked for in the text with these made one space.
    """
    signatures = rules() if signatures is None else signatures
    # As SQL text: a nested literal that the optimizer folds into one array. A keyword is looked for once for all its rules.
    gates: dict[str, list[Rule]] = {}
    for r in signatures:
        gates.setdefault(r.keyword, []).append(r)
    as_rule = lambda r: f"named_struct('n', {_quoted(r.name)}, 'l', {_quoted(r.label)}, 'r', {_quoted(r.regex)}, 'p', {r.priority}, 'w', {r.weight}D)"
    listed = ", ".join(f"named_struct('k', {_quoted(k)}, 'f', {str(' ' in k).lower()}, 'o', array({', '.join(map(as_rule, own))}))" for k, own in gates.items())
    word_at = lambda k: f"get(_words, {k})"
    starts = []
    for phrase, label in PHRASES.items():
        words = phrase.split(" ")
        back = len(words) - 1
        test = " AND ".join(f"{word_at(f'i - {back - j}')} = '{w}'" for j, w in enumerate(words[:-1]))
        starts.append((f"{word_at('i')} = '{words[-1]}' AND {test}", back, label))
    any_phrase = " OR ".join(f"({test})" for test, _, _ in starts)
    as_place = "CASE " + " ".join(f"WHEN {test} THEN struct(bigint(i - {back}) AS start, '{label}' AS label)" for test, back, label in starts) + " END"
    places = f"sort_array(transform(filter(sequence(0, size(_words) - 1), i -> {any_phrase}), i -> {as_place}))"
    empty_places = "cast(array() as array<struct<start: bigint, label: string>>)"
    # Fields in the order in which detections are sorted: by start, the wider first, then by priority and name.
    kind = "array<struct<start: int, minus_end: int, priority: int, rule: string, label: string, weight: double>>"
    # Pieces between matches give each match's place: the lengths of all pieces and matches before it.
    place = "named_struct('n', s + char_length(b.s[x]) + char_length(b.m[x]), 'e', array(named_struct('start', s + char_length(b.s[x]), 'n', char_length(b.m[x]))))"
    found = scan_sql("sequence(0, size(b.m) - 1)", "0", place, "struct<start: int, n: int>")
    located = let_sql("named_struct('m', regexp_extract_all(_low, r.r, 0), 's', split(_low, r.r, -1))", "b", f"CASE WHEN size(b.m) = 0 THEN array() ELSE {found} END")
    as_detection = "d -> named_struct('start', d.start, 'minus_end', -d.start - d.n, 'priority', r.p, 'rule', r.n, 'label', r.l, 'weight', r.w)"
    gated = f"flatten(transform(filter(array({listed}), g -> contains(CASE WHEN g.f THEN _flat ELSE _low END, g.k)), g -> g.o))"
    detected = f"flatten(transform({gated}, r -> transform({located}, {as_detection})))"
    # What lies within an earlier one ends no later than the furthest end so far.
    stays = "CASE WHEN -x.minus_end <= s THEN named_struct('n', s, 'e', array()) ELSE named_struct('n', -x.minus_end, 'e', array(x)) END"
    kept = scan_sql("sort_array(_found)", "0", stays, kind[len("array<") : -1])
    keep = f"transform({kept}, d -> named_struct('start', d.start, 'end', -d.minus_end, 'priority', d.priority, 'rule', d.rule, 'label', d.label, 'weight', d.weight))"
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    out = (
        own.withColumn("_n", F.expr(f"size(regexp_extract_all(_text, r'{WORD_ANY_CASE}', 0))"))
        .withColumn("_low", F.when(F.expr(f"{let_sql('lower(_text)', 't', ' OR '.join(f'contains(t, {_quoted(x)})' for x in STEMS))} OR _text rlike {_quoted(GATE)}"), ascii_lower(F.col("_text"))))
        .withColumn("_flat", F.regexp_replace("_low", BETWEEN.replace("\\s", r"\x20\x09-\x0D"), " "))
        .withColumn("_words", F.when(F.col("_low").contains("license"), F.expr(f"regexp_extract_all(_low, r'{WORD}', 0)")))
        .withColumn("_places", F.expr(f"CASE WHEN size(_words) > 0 THEN {places} ELSE {empty_places} END"))
        .withColumn("_found", F.expr(f"cast(CASE WHEN _low IS NOT NULL THEN {detected} ELSE array() END as {kind})"))
        .withColumn("_kept", F.expr(keep))
    )
    fields = [
        F.col("_n").cast("long").alias("n_words"),
        F.col("_places").alias("places"),
        F.col("_kept").alias("detections"),
        F.expr("array_distinct(_places.label)").alias("base"),
        F.expr("array_sort(array_distinct(concat(_places.label, _kept.label)))").alias("labels"),
        F.expr("CASE WHEN size(_places) > 0 THEN 1D ELSE coalesce(array_max(_kept.weight), 0D) END").alias("score"),
    ]
    out = out.select("_row", fenced(F.struct(*fields)).alias("_license"))
    return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns], F.col("_license").alias(*free_names(docs, "_license")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("_license.n_words").alias("n_words"),
        F.expr("bigint(size(_license.places))").alias("n_base"),
        F.expr("CASE WHEN size(_license.places) > 0 THEN _license.places[0].start END").alias("first_word"),
        F.expr("CASE WHEN size(_license.places) > 0 THEN element_at(_license.places, -1).start END").alias("last_word"),
        F.expr("array_join(array_sort(_license.base), ',')").alias("base_labels"),
        F.expr("array_join(_license.labels, ',')").alias("labels"),
        F.col("_license.score").alias("score"),
        F.expr("array_join(transform(_license.detections, d -> d.rule), ',')").alias("rules"),
    )
