"""Pseudonyms for personal numbers, dates, addresses and secrets, by keyed Feistel permutations in column algebra.

Every value is found by the shape of its kind, validated, and replaced by another valid value of the same
kind and format.  The permutation depends on key and kind only, so equal values get equal pseudonyms in all
documents, whatever separators they are written with, and different values stay different.

=========  ==================================================  ===========================================
kind       valid                                               permuted
=========  ==================================================  ===========================================
email      name@host.domain                                    letters and digits of the name
iban       check digits (remainder 1 by 97)                    account part; check digits made anew
secret     tokens with known heads; labelled values (below)    letters and digits behind head and label
ip         four numbers up to 255                              all 32 bits
date       yyyy-mm-dd, dd.mm.yyyy, m/d/yyyy, 1900 to 2099      the day among 73,051
phone      +1 with area and exchange from 200                  area, exchange and line
phone      + and 7 to 15 digits, or the +1 shape otherwise     digits after the country code
ssn        area 001-899 but 666, group and serial not 0        area, group and serial
card       13 to 19 digits, Luhn check digit                   all but the first; check digit made anew
=========  ==================================================  ===========================================

Accounts are looked for first, all other kinds in what is left, so an account that fails its check digits hides
nothing.  A labelled value (``password: x``) counts with a digit and 6 signs, with an upper-case sign after a lower-case
one and 8 signs, or with 8 signs right behind ``=``; other words stay.  A phone number of a country whose numbers vary
in length ends before a blank that follows a group of six digits or more, and, from eight digits on, before a blank and
a group of one or two; ``(0)`` behind the country code is no part of the number.  Limits: names of addresses that
differ in case are different values; in a run of more than four groups of four digits a card is looked for at every
fourth group only; IPv6 addresses stay.

A permutation is eight additive Feistel rounds over two halves: one half moves by a SHA-256 of key, kind,
round and the other half.  Letters move among letters of their case, digits among digits.

Edge cases: a NULL text stays NULL, empty and clean texts stay as they are; values that do not validate
stay; repeated rows get equal results; an empty table gives no rows; other columns pass through, and the
result columns are named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripleframe.functions.text import let
from tripleframe.llm.shared import unused

ROUNDS = 8

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
# fixed values: length of an IBAN by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_shape(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "") + r"\b"


# the length of the country ends a match; other lengths and countries go as far as they can, but not into the next account
_NEXT = rf"(?:{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[0-9]{{2}} ?[A-Z0-9]{{4}}"
_ANY_IBAN = rf"[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{4}}| (?!{_NEXT})[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b"
IBAN = rf"\b(?:{'|'.join(_iban_shape(n, c) for n, c in IBAN_LENGTHS.items())}|{_ANY_IBAN})(?!@)"
# fixed values: heads of access tokens
HEADS = r"AKIA|gh[opsur]_|github_pat_|sk-|xox[abprs]-|AIza"
_LABEL = r"\b(?i:password|passwd|pwd|secret|token|api_?key)"
_SIGNS = "[A-Za-z0-9_/+-]"
SECRET = (
    r"\bAKIA[0-9A-Z]{16}\b|\bgh[opsur]_[A-Za-z0-9]{36}\b|\bgithub_pat_[A-Za-z0-9_]{22,}|\bsk-[A-Za-z0-9]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}"
    rf"|\bAIza[A-Za-z0-9_-]{{35}}|{_LABEL}(?:\s?[=:]\s?[\"']?(?:(?=[A-Za-z_/+-]*[0-9]){_SIGNS}{{6,}}|(?={_SIGNS}*[a-z]{_SIGNS}*[A-Z]){_SIGNS}{{8,}})|=[\"']?{_SIGNS}{{8,}})"
)
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?<![0-9]/)(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9])"
# fixed values: digits after the country code, where a country's numbers all have as many
PHONE_DIGITS = {
    8: "45 47 65 216 356 372 502 503 504 505 506 507 852 853 965 968 973 974",
    9: "27 31 32 33 34 40 41 48 51 56 61 66 84 212 213 233 250 251 254 255 256 260 263 351 380 420 421 593 595 886 966 971 972",
    10: "1 7 20 30 44 52 57 63 81 82 90 91 92 98 234 880",
    11: "55 86",
}
_BY_COUNTRY = "|".join(rf"(?:{codes.replace(' ', '|')})[ .-]?(?:\(0\) ?)?(?:[0-9][ .-]?){{{n - 1}}}[0-9]" for n, codes in PHONE_DIGITS.items())
# within a number of unknown length: any sign between groups, but no blank behind a long group or before a short last one
_BETWEEN = r"(?:[.-]|(?<![ .-][0-9]{6,15}) )?"
_BETWEEN_LATE = r"(?:[.-]|(?<![ .-][0-9]{6,15})(?<!\+[0-9]{9,15}) (?![0-9]{1,2}(?![0-9])))?"
_ANY_COUNTRY = rf"(?:[0-9]{{1,3}} ?\(0\) ?)?(?:[0-9]{_BETWEEN}){{6,7}}[0-9](?:{_BETWEEN_LATE}[0-9]){{0,7}}"
# the number of digits of the country ends a match
PHONE = (
    r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    rf"|\+(?:{_BY_COUNTRY})(?![0-9])|\+{_ANY_COUNTRY}(?![0-9])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PATTERN = "|".join((EMAIL, SECRET, IP, DATE, SSN, CARD, PHONE))


KEY_CONF = "spark.tripleframe.pii.secret"  # Spark hides the values of settings so named in its UI and logs


def key_of(spark: SparkSession, default: str) -> str:
    """The key set for the session, else the default."""
    return spark.conf.get(KEY_CONF, default)


def _digest(key: str, kind: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string")), 256)


def _chars(n: Column, each) -> Column:
    """The signs ``each(i)`` for i from 1 to n in a row."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), each), "")).otherwise("")


def _moved(half: Column, digest: Column) -> Column:
    return let(F.struct(half.alias("half"), digest.alias("digest")), lambda x: _moved_signs(x["half"], x["digest"]))


def _moved_signs(half: Column, digest: Column) -> Column:
    def sign(i: Column) -> Column:
        return let(F.substring(half, i, F.lit(1)), lambda c: turned(c, i))

    def turned(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, (i - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        turn = lambda first, size: F.chr(F.lit(first) + (F.ascii(c) - first + by) % size)
        return (
            F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)
        )

    return _chars(F.length(half), sign)


def permuted_text(text: Column, key: str, kind: str) -> Column:
    """Letters and digits of a text permuted within their classes; other signs stay in place."""
    cut = (F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved = _moved(F.when(even, s["l"]).otherwise(s["r"]), _digest(key, kind, i, F.when(even, s["r"]).otherwise(s["l"])))
        return F.struct(F.when(even, moved).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(number: Column, tops: tuple[int, int], key: str, kind: str) -> Column:
    """A number below ``tops[0] * tops[1]`` permuted among all of them."""
    start = F.struct(F.floor(number / tops[1]).cast("long").alias("l"), F.pmod(number, F.lit(tops[1])).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        by = F.conv(F.substring(_digest(key, kind, i, F.when(even, s["r"]).otherwise(s["l"])), 1, 13), 16, 10).cast("long")
        return F.struct(
            F.when(even, (s["l"] + by) % tops[0]).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + by) % tops[1]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * tops[1] + s["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(shape: Column, signs: Column, blank: str = "[^0-9]") -> Column:
    """``shape`` with its digits, or signs that are not ``blank``, replaced in order by ``signs``."""

    def filled(signs: Column) -> Column:
        def sign(i: Column) -> Column:
            c = F.substring(shape, i, F.lit(1))
            before = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), blank, ""))
            return F.when(c.rlike(blank), c).otherwise(F.substring(signs, before, F.lit(1)))

        return _chars(F.length(shape), sign)

    return let(signs, filled)


def _luhn_digit(payload: Column) -> Column:
    """The check digit that follows the payload."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return ((10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10) % 10).cast("string")


def _card(value: Column, key: str) -> Column:
    def replaced(digits: Column) -> Column:
        payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
        new = F.concat(F.substring(payload, 1, 1), permuted_text(F.substring(payload, F.lit(2), F.length(payload)), key, "card"))
        valid = _luhn_digit(payload) == F.substring(digits, -1, 1)
        return F.when(valid, _refilled(value, let(new, lambda n: F.concat(n, _luhn_digit(n))))).otherwise(value)

    return let(_digits(value), replaced)


def _remainder(signs: Column) -> Column:
    """Remainder by 97 of the number that an account's signs spell (A is 10, Z is 35)."""

    def add(total: Column, i: Column) -> Column:
        c = F.substring(signs, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(signs)), F.lit(0), add)


def _iban(value: Column, key: str) -> Column:
    """The pseudonym of an account, NULL where the check digits are wrong."""

    def replaced(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        check = lambda new: F.lpad((98 - let(F.concat(new, country, F.lit("00")), _remainder)).cast("string"), 2, "0")
        signs = let(permuted_text(account, key, "iban"), lambda new: F.concat(country, check(new), new))
        valid = let(F.concat(account, F.substring(plain, 1, 4)), _remainder) == 1
        return F.when(valid, _refilled(value, signs, blank=" "))

    return let(F.regexp_replace(value, " ", ""), replaced)


def _email(value: Column, key: str) -> Column:
    return F.concat(permuted_text(F.substring_index(value, "@", 1), key, "email"), F.lit("@"), F.substring_index(value, "@", -1))


def _secret(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, rf"^((?:{_LABEL}\s?[=:]\s?[\"']?)?(?:{HEADS})?)", 1)
    return F.concat(head, permuted_text(F.substring(value, F.length(head) + 1, F.length(value)), key, "secret"))


def _ip(value: Column, key: str) -> Column:
    parts = F.split(value, r"\.")
    part = lambda k: F.get(parts, F.lit(k)).cast("long")
    number = ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)
    spelled = lambda new: F.concat_ws(".", *[(F.floor(new / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)])
    text = let(permuted_number(number, (1 << 16, 1 << 16), key, "ip"), spelled)
    valid = F.greatest(*[part(k) for k in range(4)]) < 256
    return F.when(valid, text).otherwise(value)


FIRST_DAY, DAYS = "1900-01-01", (319, 229)  # 73,051 days, up to 2100-01-02


def _date(value: Column, key: str) -> Column:
    part = lambda k: F.get(F.split(value, "[-./]"), F.lit(k)).cast("int")
    iso, dotted, padded = value.contains("-"), value.contains("."), F.length(value) == 10
    year, month, day = F.when(iso, part(0)).otherwise(part(2)), F.when(iso | dotted, part(1)).otherwise(part(0)), F.when(iso, part(2)).when(dotted, part(0)).otherwise(part(1))
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")

    def spelled(new: Column) -> Column:
        text = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(dotted, F.date_format(new, "dd.MM.yyyy"))
        return text.otherwise(F.when(padded, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "M/d/yyyy")))

    def replaced(offset: Column) -> Column:
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_number(offset, DAYS, key, "date").cast("int"))
        return F.when(offset.between(0, DAYS[0] * DAYS[1] - 1), let(new, spelled)).otherwise(value)

    return let(F.datediff(date, F.lit(FIRST_DAY).cast("date")), replaced)


def _phone(value: Column, key: str) -> Column:
    american = ~value.startswith("+") | value.startswith("+1")

    def replaced(digits: Column) -> Column:
        ten, n = F.substring(digits, -10, 10), F.length(digits)
        area, exchange, line = (F.substring(ten, a, k).cast("long") for a, k in ((1, 3), (4, 3), (7, 4)))
        number = ((area - 200) * 800 + exchange - 200) * 10_000 + line
        valid = american & n.between(10, 11) & (area >= 200) & (exchange >= 200)
        one = F.when(n > 10, F.substring(digits, F.lit(1), n - 10)).otherwise("")

        def spelled(new: Column) -> Column:
            parts = (F.floor(new / 8_000_000) + 200).cast("string"), (F.floor(new / 10_000) % 800 + 200).cast("string"), F.lpad((new % 10_000).cast("string"), 4, "0")
            return F.concat(one, *parts)

        head = F.when(american & (n == 11), F.lit(1)).when(american, F.lit(0)).otherwise(F.least(F.lit(2), n - 6))
        other = F.concat(F.substring(digits, F.lit(1), head), permuted_text(F.substring(digits, head + 1, n), key, "phone"))
        new = F.when(valid, let(permuted_number(number, (80_000, 80_000), key, "phone"), spelled)).otherwise(other)
        return F.when(n.between(7, 15), F.replace(_refilled(shape, new), F.lit("()"), F.lit("(0)"))).otherwise(value)

    # the 0 in brackets is dialled within the country only
    shape = F.replace(value, F.lit("(0)"), F.lit("()"))
    return let(_digits(shape), replaced)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9_999 + serial - 1

    def spelled(new: Column) -> Column:
        place = F.floor(new / (99 * 9_999))
        return F.format_string("%03d-%02d-%04d", place + F.when(place >= 665, 2).otherwise(1), F.floor(new / 9_999) % 99 + 1, new % 9_999 + 1)

    text = let(permuted_number(number, (898, 99 * 9_999), key, "ssn"), spelled)
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), text).otherwise(value)


_KINDS = ((EMAIL, _email), (SECRET, _secret), (IP, _ip), (DATE, _date), (SSN, _ssn), (CARD, _card), (PHONE, _phone))


def _pseudonym(value: Column, key: str) -> Column:
    out = value
    for shape, make in reversed(_KINDS):
        out = F.when(value.rlike(f"^(?:{shape})$"), make(value, key)).otherwise(out)
    return out


def _joined(gaps: Column, values: Column) -> Column:
    return F.array_join(F.zip_with(gaps, F.array_append(values, ""), lambda gap, v: F.concat(gap, v)), "")


def _without_accounts(text: Column, key: str) -> Column:
    """Struct of the text with a mark for every valid account, the mark, and the accounts with their pseudonyms; NULL without any.

    The mark is made from the digest of the text itself and has no digits, so nothing is found in it.
    """

    def hidden(found: Column, mark: Column) -> Column:
        rest = _joined(F.split(text, IBAN, -1), F.transform(found, lambda v: F.when(v["new"].isNull(), v["old"]).otherwise(mark)))
        return F.struct(rest.alias("text"), mark.alias("mark"), F.filter(found, lambda v: v["new"].isNotNull()).alias("accounts"))

    mark = F.concat(F.lit("\u0001"), F.translate(F.sha2(text, 256), "0123456789", "ghijklmnop"), F.lit("\u0001"))
    accounts = F.transform(F.regexp_extract_all(text, F.lit(IBAN), 0), lambda v: F.struct(v.alias("old"), _iban(v, key).alias("new")))
    held = let(accounts, lambda found: F.when(F.exists(found, lambda v: v["new"].isNotNull()), let(mark, lambda m: hidden(found, m))))
    return F.when(text.rlike("[A-Z]{2}[0-9]{2}") & text.rlike(IBAN), held)


def pseudonymized(docs: DataFrame, key: str, text: str = "text", into: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with all values of ``text`` replaced, in the column ``into``; ``count`` gets the number of replaced values."""
    column, hidden, rest, new = F.col(text), unused("hidden", docs), unused("rest", docs), unused("new", docs)
    left = F.col(rest)
    found = F.regexp_extract_all(left, F.lit(PATTERN), 0)
    touched = left.rlike("[0-9@=:_-]") & left.rlike(PATTERN)
    held = (
        docs.withColumn(hidden, _without_accounts(column, key))
        .withColumn(rest, F.coalesce(F.col(f"{hidden}.text"), column))
        .withColumn(new, F.when(touched, F.transform(found, lambda v: _pseudonym(v, key))))
    )
    accounts = F.col(f"{hidden}.accounts")
    if count:
        pairs = F.arrays_zip(found.alias("a"), F.col(new).alias("b"))
        changed = F.when(F.col(new).isNotNull(), F.size(F.filter(pairs, lambda p: p["a"] != p["b"]))).otherwise(0)
        renamed = F.when(accounts.isNotNull(), F.size(F.filter(accounts, lambda v: v["old"] != v["new"]))).otherwise(0)
        held = held.withColumn(count, changed + renamed)
    held = held.withColumn(rest, F.when(F.col(new).isNotNull(), _joined(F.split(left, PATTERN, -1), F.col(new))).otherwise(left))
    back = _joined(F.split(left, F.col(f"{hidden}.mark"), -1), F.transform(accounts, lambda v: v["new"]))
    return held.withColumn(into, F.when(accounts.isNotNull(), back).otherwise(left)).drop(hidden, rest, new)
