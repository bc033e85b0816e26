"""Format-preserving pseudonyms for personal data.

Mail addresses, card numbers, bank accounts, phone numbers, social security numbers, IP addresses and dates are found
by pattern, validated (check digits, ranges, calendar) and replaced by another value of the same format that passes the
same validation. The replacement is a keyed permutation of the format (a Feistel network), so equal values have equal
pseudonyms in all documents, and different values have different ones. What fails its validation stays as it is.

Two networks are used. Strings: either half of the digits and letters is shifted, character by character and within its
class, by a keyed digest of the other half. Numbers of a bounded range: either half of a two-digit number in a mixed
radix is moved by a keyed digest of the other. Everything is SQL functions; texts without a digit or @ are not searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import fresh

ROUNDS = 10
#: Dates are permuted within eras of DAYS days (LEFT x RIGHT); there are ERAS, the first of them begins BEFORE eras
#: before FIRST_DAY, so that all days of the years 102 to 9893 are covered.
DAYS, LEFT, RIGHT, ERAS, BEFORE = 73000, 250, 292, 49, 8
FIRST_DAY = "1700-01-01"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9]|\.[0-9])",
    "iso": r"(?<![A-Za-z0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9-])",
    "us": r"(?<![A-Za-z0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![A-Za-z0-9/])",
    "eu": r"(?<![A-Za-z0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![A-Za-z0-9]|\.[0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "phone": r"(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![A-Za-z0-9])",
}


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(key: str, kind: str, turn: str, half: str) -> str:
    """SQL: a keyed digest, the key hashed in again over the first digest."""
    return f"sha2(concat({_quote(key)}, sha2(concat_ws('|', {_quote(key)}, '{kind}', {turn}, {half}), 512)), 512)"


def _shifted(half: str, digest: str) -> str:
    """The half with each digit and letter moved within its class by 16 bits of the digest."""
    by = f"cast(conv(substring({digest}, 4 * ((j - 1) % 32) + 1, 4), 16, 10) as int)"
    char = f"substring({half}, j, 1)"
    return (
        f"CASE WHEN length({half}) = 0 THEN '' ELSE array_join(transform(sequence(1, length({half})), j -> CASE "
        f"WHEN {char} BETWEEN '0' AND '9' THEN char(48 + (ascii({char}) - 48 + {by}) % 10) "
        f"WHEN {char} BETWEEN 'a' AND 'z' THEN char(97 + (ascii({char}) - 97 + {by}) % 26) "
        f"WHEN {char} BETWEEN 'A' AND 'Z' THEN char(65 + (ascii({char}) - 65 + {by}) % 26) ELSE {char} END), '') END"
    )


def string_feistel(value: str, key: str, kind: str) -> str:
    """SQL: a permutation of strings of `value`'s length and character classes."""
    left, right = f"substring({value}, 1, length({value}) div 2)", f"substring({value}, length({value}) div 2 + 1)"
    step_l = _shifted("s.l", "d")
    step_r = _shifted("s.r", "d")
    one = f"transform(array({_digest(key, kind, 'i', 'if(i % 2 = 0, s.r, s.l)')}), d -> if(i % 2 = 0, named_struct('l', {step_l}, 'r', s.r), named_struct('l', s.l, 'r', {step_r})))[0]"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {left}, 'r', {right}), (s, i) -> {one}, s -> concat(s.l, s.r))"


def number_feistel(left: str, right: str, radix_l: int, radix_r: int, key: str, kind: str) -> str:
    """SQL: a struct (l, r) permuted within radix_l x radix_r."""
    move = lambda half: f"cast(conv(substring({_digest(key, kind, 'i', half)}, 1, 14), 16, 10) as bigint)"
    step = f"if(i % 2 = 0, named_struct('l', (s.l + {move('s.r')}) % {radix_l}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {move('s.l')}) % {radix_r}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> {step})"


def _let(name: str, value: str, body: str) -> str:
    """SQL: `body` with `name` standing for `value`, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _check_digit(payload: str) -> str:
    """SQL: the Luhn digit after `payload`."""
    d = f"cast(substring({payload}, length({payload}) - k + 1, 1) as int)"
    doubled = f"CASE WHEN k % 2 = 1 THEN {d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END"
    return f"(10 - aggregate(sequence(1, length({payload})), 0, (t, k) -> t + {doubled}) % 10) % 10"


def _mod97(value: str) -> str:
    """SQL: the remainder by 97 of a string whose letters count as 10 to 35."""
    c = f"substring({value}, k, 1)"
    return f"aggregate(sequence(1, length({value})), 0, (t, k) -> CASE WHEN {c} BETWEEN '0' AND '9' THEN (t * 10 + cast({c} as int)) % 97 ELSE (t * 100 + ascii({c}) - 55) % 97 END)"


def _refill(mask: str, chars: str) -> str:
    """SQL: `mask` with its digits and letters replaced, in order, by the characters of `chars`."""
    c = f"substring({mask}, k, 1)"
    step = f"if({c} rlike '[A-Za-z0-9]', named_struct('o', concat(t.o, substring({chars}, t.n, 1)), 'n', t.n + 1), named_struct('o', concat(t.o, {c}), 'n', t.n))"
    return f"aggregate(sequence(1, length({mask})), named_struct('o', '', 'n', 1), (t, k) -> {step}, t -> t.o)"


def _date(day: str, pattern: str, key: str, kind: str) -> str:
    """SQL: another day in the match's format, or null where the match is no day of the covered years."""
    number = f"datediff(to_date(try_to_timestamp({day}, '{pattern}')), date'{FIRST_DAY}') + {BEFORE * DAYS}"
    moved = number_feistel(f"(x % {DAYS}) div {RIGHT}", f"(x % {DAYS}) % {RIGHT}", LEFT, RIGHT, key, kind)
    out = f"date_format(date_add(date'{FIRST_DAY}', cast((x div {DAYS} - {BEFORE}) * {DAYS} + y.l * {RIGHT} + y.r as int)), '{pattern}')"
    return _let("x", number, f"CASE WHEN x >= 0 AND x < {DAYS * ERAS} THEN {_let('y', moved, out)} END")


def pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of a match, or null if it fails its validation."""
    mail = _let("a", f"substring_index({m}, '@', 1)", f"concat({string_feistel('a', key, 'mail')}, substring({m}, length(a) + 1))")
    digits = lambda: f"regexp_replace({m}, '[^0-9]', '')"
    payload = _let("p", f"concat(substring(x, 1, 1), {string_feistel('substring(x, 2, length(x) - 2)', key, 'card')})", f"concat(p, {_check_digit('p')})")
    card = _let("x", digits(), f"CASE WHEN cast(substring(x, -1) as int) = {_check_digit('substring(x, 1, length(x) - 1)')} THEN {_let('q', payload, _refill(m, 'q'))} END")
    # Area and exchange keep their first digit, so that what is valid stays valid; a country code stays.
    moved = "concat(substring(x, 1, length(x) - 10), substring(x, -10, 1), substring(y, 1, 2), substring(x, -7, 1), substring(y, 3))"
    phone = _let("x", digits(), _let("y", string_feistel("concat(substring(x, -9, 2), substring(x, -6))", key, "phone"), _let("q", moved, _refill(m, "q"))))
    ssn_ok = f"substring({m}, 1, 3) NOT IN ('000', '666') AND substring({m}, 1, 1) <> '9' AND substring({m}, 5, 2) <> '00' AND substring({m}, 8) <> '0000'"
    ssn = _let("y", number_feistel(f"substring({m}, 5, 2) - 1", f"substring({m}, 8) - 1", 99, 9999, key, "ssn"), f"concat(substring({m}, 1, 4), lpad(cast(y.l + 1 as string), 2, '0'), '-', lpad(cast(y.r + 1 as string), 4, '0'))")
    octet = lambda i: f"cast(split({m}, '[.]')[{i}] as bigint)"
    ip = _let("y", number_feistel(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", 65536, 65536, key, "ip"), "concat_ws('.', y.l div 256, y.l % 256, y.r div 256, y.r % 256)")
    account = _let("p", string_feistel("substring(x, 5)", key, "iban"), f"concat(substring(x, 1, 2), lpad(cast(98 - {_mod97('concat(p, substring(x, 1, 2), \"00\")')} as string), 2, '0'), p)").replace('"', "'")
    iban = _let("x", f"replace({m}, ' ', '')", f"CASE WHEN length(x) BETWEEN 15 AND 34 AND {_mod97('concat(substring(x, 5), substring(x, 1, 4))')} = 1 THEN {_let('q', account, _refill(m, 'q'))} END")
    whole = lambda kind: f"{m} rlike {_quote('^' + PATTERNS[kind] + '$')}"
    return (
        f"CASE WHEN {m} LIKE '%@%' THEN {mail} WHEN {whole('ip')} THEN {ip} "
        f"WHEN {whole('iso')} THEN {_date(m, 'yyyy-MM-dd', key, 'date')} WHEN {whole('us')} THEN {_date(m, 'MM/dd/yyyy', key, 'date')} "
        f"WHEN {whole('eu')} THEN {_date(m, 'dd.MM.yyyy', key, 'date')} WHEN {whole('ssn')} THEN CASE WHEN {ssn_ok} THEN {ssn} END "
        f"WHEN {m} rlike '^[A-Z]' THEN {iban} WHEN {whole('phone')} THEN {phone} ELSE {card} END"
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pii") -> DataFrame:
    """All columns of `docs` with personal data in `text_col` replaced, and how many values were replaced.

    key: any string; who has it can tell whether a value has a given pseudonym, so it is to be kept secret. Null texts
    stay null with a count of 0, empty texts stay empty. Rows are handled on their own: ties, repeated rows and other
    columns pass through, whatever their names. A column named like `count_col` is replaced; with None the count is left
    out. The key stands in the plan: redact event logs (spark.sql.redaction.string.regex) where others can read them.
    """
    pattern = "|".join(PATTERNS.values())
    at = f"`{text_col}`"
    found, made, between = fresh(docs, "_found", "_made", "_between")
    parts = F.expr(f"CASE WHEN {at} rlike '[0-9@]' THEN regexp_extract_all({at}, {_quote(pattern)}, 0) END")
    new = F.expr(f"CASE WHEN size({found}) > 0 THEN transform({found}, m -> named_struct('old', m, 'new', {pseudonym('m', key)})) END")
    # The pieces between matches, then each match after the piece before it.
    pieces = F.expr(f"split({at}, {_quote(pattern)}, -1)")
    text = F.expr(f"array_join(zip_with({between}, {made}, (b, f) -> concat(b, coalesce(f.new, f.old, ''))), '')")
    out = docs.withColumn(found, parts).withColumn(made, new)
    out = out.withColumn(between, F.when(F.size(made) > 0, pieces))
    out = out.withColumn(text_col, F.when(F.size(made) > 0, text).otherwise(F.col(text_col)))
    if count_col:
        n = F.expr(f"cast(size(filter({made}, f -> f.new IS NOT NULL)) as bigint)")
        out = out.withColumn(count_col, F.greatest(F.coalesce(n, F.lit(0).cast("long")), F.lit(0).cast("long")))
    return out.drop(found, made, between)
