"""PII: format-preserving pseudonyms by a keyed Feistel network, in DataFrame and SQL functions only.

Numbers and dates that pass their validation are permuted within their format, so equal values stay linked across
documents and unequal values stay apart; addresses and secrets get keyed tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import fenced, free_names, let_sql, long_sql, scan_sql, table

#: The session's setting that holds the secret key; without it, pseudonyms are made with a key that all can read, for tests.
KEY_SETTING = "spark.citeweave.pii.key"
KEY, ROUNDS = "not-a-secret", 6
#: Days from 1900-01-01 that dates are permuted within (to 2099-12-31).
DAYS = 73049

# Java's engine recurses once for each time that a group repeats, so groups repeat a bounded number of times (labels of a domain
# as in the DNS, 127 of 63 characters at the most) or possessively; and no long run of characters is tried from each of its places.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
_SECRET = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=password=)[0-9A-Za-z]{8,64}|(?<=token = \")[0-9A-Za-z]{16,64}(?=\")"
_DATE = r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])|(?<![\d/])(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])/(?:19|20)\d\d(?![\d/])"
_DATE += r"|(?<![\d/])(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d\d(?![\d/])|(?<![\d/])(?:19|20)\d\d/(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])(?![\d/])"
_DATE += r"|(?<![\d.])(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)\d\d(?!\d|\.\d)"
_PHONE = r"(?<![\w+])\+\d{1,3} \(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)|(?<![\w(])\(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\d-])"
_PHONE += r"|(?<![\w+])\+\d(?:[ .-]?\(?\d\)?){7,14}(?!\d)|(?<![\w.])\d{3}\.\d{3}\.\d{4}(?!\d|\.\d)"
_SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: What may not follow a group of digits, and groups joined by hyphens before it.
_AFTER = r"(?![\w@-]|\.\d{1,3}\.\d|/\d\d/\d)"
_JOINED = rf"\d++(?:-\d++)*+{_AFTER}"
#: Groups of digits joined by single hyphens and spaces, of any length; _pieces looks for cards inside.
_CARD = rf"(?<![\w.-])(?=\d[\d -]{{12}}){_JOINED}(?: {_JOINED})*+"
#: What a group inside a run may start instead of a card.
_INNER = r"^(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}|\d{3}-\d{3}-\d{4})(?![\d-])"
#: Tried at each place in this order.
PATTERN = "|".join((_EMAIL, _SECRET, _IP, _DATE, _PHONE, _SSN, _IBAN, _CARD))
#: No text without one of these can hold a match; it is looked for first.
GATE = r"@|\d[ -]?\d|AKIA|password=|token = "


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel_sql(value: str, modulus: str, tag: str, key: str = KEY, rounds: int = ROUNDS) -> str:
    """SQL: a keyed permutation of 0 .. modulus - 1 of `value` (decimal(38,0) or less; modulus up to 10^18). tag: SQL of a
    string, another permutation for each.

    A balanced network over a x b >= modulus with a = ceil(sqrt(modulus)): each round adds a keyed hash of one half to
    the other, modulo its size. Results of modulus and more are put through it again, up to 40 times: they are fewer than
    one in sqrt(modulus), so that already a third time is rare.
    """
    # Halves: value = l * b + r. Rounds alternate the half that changes, so unequal halves need no swap.
    state = "named_struct('l', x div b, 'r', x % b)"
    steps = state
    for i in range(rounds):
        digest = lambda half: f"cast(conv(substr(sha2(concat_ws(':', {_quoted(key)}, {tag}, '{i}', cast(s.{half} as string), cast(n as string)), 256), 1, 15), 16, 10) as bigint)"
        if i % 2:
            change = f"named_struct('l', s.l, 'r', (s.r + {digest('l')} % b) % b)"
        else:
            change = f"named_struct('l', (s.l + {digest('r')} % a) % a, 'r', s.r)"
        steps = let_sql(steps, "s", change)
    once = f"transform(array({steps}), s -> s.l * b + s.r)[0]"
    walk = f"aggregate(sequence(1, 40), named_struct('x', v, 'd', false), (w, k) -> CASE WHEN w.d THEN w ELSE transform(transform(array(w.x), x -> {once}), y -> named_struct('x', y, 'd', y < n))[0] END, w -> w.x)"
    body = f"transform(array(bigint(ceil(sqrt(n)))), a -> transform(array((n + a - 1) div a), b -> {walk})[0])[0]"
    return f"transform(array(bigint({modulus})), n -> transform(array(bigint({value})), v -> {body})[0])[0]"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _refill(shape: str, digits: str) -> str:
    """SQL: `shape` with its digits replaced, in order, by those of `digits`."""
    step = "(s, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN named_struct('o', concat(s.o, substr(d, s.k + 1, 1)), 'k', s.k + 1) ELSE named_struct('o', concat(s.o, c), 'k', s.k) END"
    return let_sql(digits, "d", f"aggregate(split({shape}, ''), named_struct('o', '', 'k', 0), {step}, s -> s.o)")


def _luhn(d: str) -> str:
    """SQL: sum of the digits of `d`, every second one from the right (the last is the first) doubled."""
    term = f"transform(array(int(substr({d}, length({d}) - i, 1)) * (1 + (i + 1) % 2)), x -> x div 10 + x % 10)[0]"
    return f"aggregate(sequence(0, length({d}) - 1), 0L, (a, i) -> a + {term})"


def _luhn_ok(d: str) -> str:
    """SQL: whether `d`, check digit included, is a valid number."""
    term = f"transform(array(int(substr({d}, length({d}) - i, 1)) * (1 + i % 2)), x -> x div 10 + x % 10)[0]"
    return f"aggregate(sequence(0, length({d}) - 1), 0L, (a, i) -> a + {term}) % 10 = 0"


def _mod97(x: str) -> str:
    """SQL: the number that letters and digits of `x` stand for (A = 10), modulo 97."""
    step = "(a, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (a * 10 + int(c)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END"
    return f"aggregate(filter(split({x}, ''), c -> c <> ''), 0, {step})"


def _padded(number: str, width: str) -> str:
    return f"lpad(cast({number} as string), {width}, '0')"


def _token(value: str, tag: str, key: str) -> str:
    return f"sha2(concat_ws(':', {_quoted(key)}, '{tag}', {value}), 256)"


def _pieces(m: str, s: str) -> str:
    """SQL: match `m` cut into what is judged (j) and what stays as it is, in order; only `s`, if it's a secret, is whole.

    In runs of digits, every group start is tried: a date or a number in hyphens, or else the longest card of 13 to 19
    digits that ends with a group and validates; groups inside one aren't tried. Of a spaced IBAN, the longest validating row of groups counts, and what
    follows it is a run again.
    """
    kind = "struct<v: string, j: boolean>"
    piece = lambda v, j: f"named_struct('v', {v}, 'j', {j})"
    tried = ", ".join(f"regexp_extract(r, {_quoted(f'^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])')}, 0)" for n in range(19, 12, -1))
    card = f"coalesce(get(filter(array({tried}), y -> y <> '' AND {let_sql(_digits('y'), 'q', _luhn_ok('q'))}), 0), '')"
    # g: groups with what parts each from the next; x: a group's place. A card takes 19 digits and 18 separators at the most,
    # and one character more shows that its last group ends. s: how many groups belong to the last piece found.
    inner = f"CASE WHEN x = 0 OR endswith(g[x - 1], ' ') THEN regexp_extract(r, {_quoted(_INNER)}, 0) ELSE '' END"
    found = let_sql(f"substr(concat_ws('', {', '.join(f'substr(get(g, x + {i}), 1, 38)' for i in range(19))}), 1, 38)", "r", let_sql(inner, "d", f"named_struct('r', r, 'f', CASE WHEN d <> '' THEN d ELSE {card} END)"))
    takes = f"named_struct('n', size(split(z.f, '[ -]')) - 1, 'e', array({piece('z.f', 'true')}, {piece('substr(z.r, length(z.f) + 1, CASE WHEN substr(z.r, length(z.f) + 1, 1) IN (' + _quoted(' ') + ', ' + _quoted('-') + ') THEN 1 ELSE 0 END)', 'false')}))"
    passes = f"named_struct('n', 0, 'e', array({piece('g[x]', 'false')}))"
    step = f"CASE WHEN s > 0 THEN named_struct('n', s - 1, 'e', array()) WHEN NOT g[x] rlike '^[0-9]' THEN {passes} ELSE {let_sql(found, 'z', f'CASE WHEN z.f = {_quoted(str())} THEN {passes} ELSE {takes} END')} END"
    run = lambda t: let_sql(f"split({t}, '(?<=[ -])')", "g", scan_sql("sequence(0, size(g) - 1)", "0", step, kind))
    plain = "replace(x, ' ', '')"
    rows = f"filter(transform(sequence(size(split({m}, ' ')), 1, -1), n -> array_join(slice(split({m}, ' '), 1, n), ' ')), x -> length({plain}) >= 15 AND {_mod97(f'concat(substr({plain}, 5), substr({plain}, 1, 4))')} = 1)"
    iban = let_sql(f"coalesce(get({rows}, 0), '')", "b", f"concat(CASE WHEN b = '' THEN cast(array() as array<{kind}>) ELSE array({piece('b', 'true')}) END, {run(f'substr({m}, length(b) + 1)')})")
    return f"CASE WHEN NOT {s} AND {m} rlike '^[A-Z]{{2}}[0-9]{{2}} ' THEN {iban} WHEN NOT {s} AND {m} rlike '^[0-9][0-9 -]{{11,}}[0-9]$' THEN {run(m)} ELSE array({piece(m, 'true')}) END"


def pseudonym_sql(m: str, s: str, key: str = KEY) -> tuple[str, str]:
    """SQL for a match `m`: its kind (null where validation fails) and what stands in its place. s: SQL of whether the
    text before it says that it's a secret."""
    compact = f"replace({m}, ' ', '')"
    kind = (
        f"CASE WHEN {m} LIKE '%@%' THEN 'email' WHEN {s} OR {m} rlike '^AKIA' THEN 'secret' "
        f"WHEN {m} rlike {_quoted('^' + _IP + '$')} THEN 'ip' "
        f"WHEN {m} rlike {_quoted('^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} THEN CASE WHEN try_to_date({m}, 'yyyy-MM-dd') IS NOT NULL THEN 'date_ymd' END "
        f"WHEN {m} rlike {_quoted('^[0-9]{2}/[0-9]{2}/[0-9]{4}$')} THEN CASE WHEN try_to_date({m}, 'dd/MM/yyyy') IS NOT NULL THEN 'date_dmy' WHEN try_to_date({m}, 'MM/dd/yyyy') IS NOT NULL THEN 'date_mdy' END "
        f"WHEN {m} rlike {_quoted('^[0-9]{4}/[0-9]{2}/[0-9]{2}$')} THEN CASE WHEN try_to_date({m}, 'yyyy/MM/dd') IS NOT NULL THEN 'date_ymd_slash' END "
        f"WHEN {m} rlike {_quoted('^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$')} THEN CASE WHEN try_to_date({m}, 'dd.MM.yyyy') IS NOT NULL THEN 'date_dmy_dot' END "
        f"WHEN {m} rlike {_quoted('^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$')} THEN 'phone' WHEN {m} rlike {_quoted('^[0-9]{3}-[0-9]{2}-[0-9]{4}$')} THEN 'ssn' "
        f"WHEN {m} rlike '^[A-Z]' THEN CASE WHEN {_mod97(f'concat(substr({compact}, 5), substr({compact}, 1, 4))')} = 1 THEN 'iban' END "
        f"WHEN {let_sql(_digits(m), 'q', 'CASE WHEN length(q) >= 13 THEN ' + _luhn_ok('q') + ' END')} THEN 'card' END"
    )
    since = "DATE'1900-01-01'"
    forms = {"date_ymd": "yyyy-MM-dd", "date_dmy": "dd/MM/yyyy", "date_mdy": "MM/dd/yyyy", "date_ymd_slash": "yyyy/MM/dd", "date_dmy_dot": "dd.MM.yyyy"}
    # What is permuted, as numbers below others. x.q: the digits, x.w: the letters of an IBAN.
    pair = lambda v, n: f"named_struct('v', bigint({v}), 'n', bigint({n}))"
    row = lambda v, n: f"array({pair(v, n)})"
    ip_number = f"aggregate(split({m}, '[.]'), 0L, (a, o) -> a * 256 + int(o))"
    days = "CASE k " + " ".join(f"WHEN '{k}' THEN datediff(to_date({m}, '{f}'), {since})" for k, f in forms.items()) + " END"
    # SSNs that can be given: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999.
    area = "(int(substr(x.q, 1, 3)) - CASE WHEN x.q > '666' THEN 2 ELSE 1 END)"
    ssn_number = f"({area} * 99L + int(substr(x.q, 4, 2)) - 1) * 9999L + int(substr(x.q, 6, 4)) - 1"
    # Digits and letters of an IBAN's bank and account, each in their places and in rows of up to 15 and 12 (below 10^18).
    digits = lambda i: f"substr(x.q, {1 + 15 * i}, 15)"
    letters = lambda i: f"substr(x.w, {1 + 12 * i}, 12)"
    spelt = lambda g: f"aggregate(filter(split({g}, ''), c -> c <> ''), 0L, (a, c) -> a * 26 + ascii(c) - 65)"
    iban_rows = [pair(f"CASE WHEN {digits(i)} = '' THEN '0' ELSE {digits(i)} END", f"power(10D, length({digits(i)}))") for i in (0, 1)] + [pair(spelt(letters(i)), f"power(26D, length({letters(i)}))") for i in (0, 1, 2)]
    numbers = (
        f"CASE WHEN k = 'ip' THEN {row(ip_number, '4294967296L')} WHEN k LIKE 'date%' THEN {row(days, DAYS)} WHEN k = 'phone' THEN {row('right(x.q, 7)', 10**7)} "
        f"WHEN k = 'ssn' THEN {row(ssn_number, 898 * 99 * 9999)} WHEN k = 'card' THEN {row('substr(x.q, 7, length(x.q) - 7)', 'power(10D, length(x.q) - 7)')} WHEN k = 'iban' THEN array({', '.join(iban_rows)}) END"
    )
    tag = "concat(CASE WHEN k LIKE 'date%' THEN 'date' ELSE k END, ':', i)"
    permuted = f"transform({numbers}, (r, i) -> {feistel_sql('r.v', 'r.n', tag, key)})"
    # And how it is written: z is the array of the permuted numbers.
    ip = "concat_ws('.', z[0] div 16777216, (z[0] div 65536) % 256, (z[0] div 256) % 256, z[0] % 256)"
    date = f"date_format(date_add({since}, int(z[0])), CASE k " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in forms.items()) + " END)"
    phone = f"concat(substr(x.q, 1, length(x.q) - 7), {_padded('z[0]', '7')})"
    ssn = f"concat({_padded('z[0] div 989901L + CASE WHEN z[0] div 989901L >= 665 THEN 2 ELSE 1 END', '3')}, {_padded('(z[0] div 9999L) % 99 + 1', '2')}, {_padded('z[0] % 9999L + 1', '4')})"
    # The first six digits (the issuer) and the length stay; the account is permuted and the check digit made anew.
    card = let_sql(f"concat(substr(x.q, 1, 6), {_padded('z[0]', 'length(x.q) - 7')})", "p", f"concat(p, (10 - {_luhn('p')} % 10) % 10)")
    refilled = _refill(m, f"CASE k WHEN 'phone' THEN {phone} WHEN 'ssn' THEN {ssn} ELSE {card} END")
    padded = lambda i: f"CASE WHEN {digits(i)} = '' THEN '' ELSE {_padded(f'z[{i}]', f'length({digits(i)})')} END"
    written = lambda i: f"CASE WHEN {letters(i)} = '' THEN '' ELSE array_join(transform(sequence(length({letters(i)}) - 1, 0, -1), j -> chr(65 + (z[{2 + i}] div bigint(power(26D, j))) % 26)), '') END"
    step = "(s, c) -> CASE WHEN c = '' THEN s WHEN c BETWEEN '0' AND '9' THEN named_struct('o', concat(s.o, substr(d.n, s.k + 1, 1)), 'k', s.k + 1, 'l', s.l) ELSE named_struct('o', concat(s.o, substr(d.w, s.l + 1, 1)), 'k', s.k, 'l', s.l + 1) END"
    bban = let_sql(f"named_struct('n', concat({padded(0)}, {padded(1)}), 'w', concat({written(0)}, {written(1)}, {written(2)}))", "d", f"aggregate(split(substr({compact}, 5), ''), named_struct('o', '', 'k', 0, 'l', 0), {step}, s -> s.o)")
    # Two check digits are made anew, and all goes into the groups of the match, whose characters it replaces one by one.
    iban = let_sql(bban, "u", f"concat(substr({compact}, 1, 2), lpad(cast(98 - {_mod97(f"concat(u, substr({compact}, 1, 2), '00')")} as string), 2, '0'), u)")
    iban = let_sql(iban, "y", f"aggregate(split({m}, ''), named_struct('o', '', 'k', 0), (s, c) -> CASE WHEN c IN ('', ' ') THEN named_struct('o', concat(s.o, c), 'k', s.k) ELSE named_struct('o', concat(s.o, substr(y, s.k + 1, 1)), 'k', s.k + 1) END, s -> s.o)")
    secret = f"CASE WHEN {m} rlike '^AKIA' THEN concat('AKIA', upper(substr({_token(m, 'secret', key)}, 1, 16))) ELSE substr(repeat({_token(m, 'secret', key)}, 2), 1, length({m})) END"
    email = f"concat('u', substr({_token(f'lower({m})', 'email', key)}, 1, 16), '@', substr({_token(f'lower({m})', 'domain', key)}, 1, 8), '.invalid')"
    formatted = f"CASE WHEN k = 'ip' THEN {ip} WHEN k = 'iban' THEN {iban} WHEN k LIKE 'date%' THEN {date} ELSE {refilled} END"
    found = f"named_struct('q', CASE WHEN k = 'iban' THEN {_digits(f'substr({compact}, 5)')} ELSE {_digits(m)} END, 'w', CASE WHEN k = 'iban' THEN regexp_replace(substr({compact}, 5), '[^A-Z]', '') ELSE '' END)"
    out = f"CASE k WHEN 'email' THEN {email} WHEN 'secret' THEN {secret} ELSE {let_sql(found, 'x', let_sql(permuted, 'z', formatted))} END"
    return kind, out


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All columns of `docs` with `text` pseudonymised and, last, an array of kind and pseudonym of each replaced value. It is
    named _pii, or with underscores more where `docs` has such a column.

    Defined cases: a null text stays null and has an empty array; an empty table gives no rows; a text without a valid value is unchanged byte for byte;
    a value that fails its validation (Luhn, mod 97, calendar) stays, but cards and IBANs inside it don't; equal values get equal pseudonyms in every
    document; values are found in whole texts of any length. Repeated rows and further columns, null or not, pass through,
    whatever their names.
    """
    secret = "(m rlike '^[0-9A-Za-z]{8,64}$' AND (endswith(_between[i], 'password=') OR endswith(_between[i], 'token = \"')))"
    kind, out = pseudonym_sql("m", "w", key)
    judged = let_sql("e.v", "m", let_sql(f"CASE WHEN e.j THEN {kind} END", "k", f"named_struct('k', k, 'p', CASE WHEN k IS NULL THEN m ELSE {out} END)"))
    # In two columns, as the analyzer goes through nested functions level by level, a limited number of times.
    cut = f"transform(_found, (m, i) -> {let_sql(secret, 'w', f"named_struct('w', w, 'p', {_pieces('m', 'w')})")})"
    each = f"transform(_cut, c -> {let_sql('c.w', 'w', f'transform(c.p, e -> {judged})')})"
    pattern = _quoted(PATTERN)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("_text"))
    with long_sql(docs.sparkSession):
        done = (
            own.withColumn("_between", F.expr(f"CASE WHEN _text rlike {_quoted(GATE)} THEN split(_text, {pattern}, -1) END"))
            .withColumn("_found", F.expr(f"CASE WHEN _text rlike {_quoted(GATE)} THEN regexp_extract_all(_text, {pattern}, 0) END"))
            .withColumn("_cut", F.expr(f"CASE WHEN size(_found) > 0 THEN {cut} END"))
            .withColumn("_new", F.expr(f"CASE WHEN size(_cut) > 0 THEN {each} ELSE cast(array() as array<array<struct<k: string, p: string>>>) END"))
            .withColumn(
                "_out",
                F.expr(f"CASE WHEN size(_found) > 0 THEN concat_ws('', transform(_between, (x, i) -> concat(x, coalesce(array_join(transform(get(_new, i), y -> y.p), ''), '')))) ELSE _text END"),
            )
        )
    done = done.select("_row", fenced(F.struct("_out", F.expr("transform(filter(flatten(_new), x -> x.k IS NOT NULL), x -> named_struct('kind', x.k, 'pseudonym', x.p))").alias("_pii"))).alias("_done"))
    return done.select(*[F.col("_done._out").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns], F.col("_done._pii").alias(*free_names(docs, "_pii")))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, KEY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark)).select(
        "doc_id", "text", F.expr("bigint(size(_pii))").alias("n_replaced"), F.expr("array_join(transform(_pii, x -> x.kind), ',')").alias("kinds")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every text with its personal values pseudonymised; no document goes. n_chars follows the text. The
    cases of pseudonymise() hold."""
    out = pseudonymise(docs, session_key(spark)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
