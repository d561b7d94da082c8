"""Format-preserving Feistel pseudonyms for personal numbers and dates, in DataFrame operations only.

Patterns find candidates, a check per kind validates them (Luhn and issuer for cards, the
written form for phones, area, group and serial for social security numbers, octets for addresses, the
calendar for dates). A valid value is taken as a number in a domain of exactly ``a * b`` values, and a keyed
Feistel network permutes that domain: halves (l, r) become (r, l + F(key, kind, round, r)), with F taken from SHA-256. The
result is written back in the place of the digits, so separators, length and validity stay. A value has the
same pseudonym wherever it stands and however it is spaced, which keeps documents linked; whoever
holds the key can undo it (``restore``). The local part of an e-mail address is no number and becomes a keyed digest.

Cards are searched for in three passes, so that plain numbers next to a value do not hide it. The first finds all
other kinds and cards written in their usual groups; the second finds cards written in any other way in what is left; the
third finds cards in their usual groups with further digits behind them. What fails its check is open to the next pass.

Everything happens inside the row: no shuffle, whatever the skew.

Defined results: a null text stays null, an empty one empty; candidates that fail their check stay as they
are; dates before 1900-01-01 or after 2100-01-02 stay; rows are treated one by one; other columns pass through
unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.store import unused

ROUNDS = 8
#: The days from 1900-01-01 to 2100-01-02: 319 * 229.
FIRST_DAY, DAY_HALVES = "1900-01-01", (319, 229)

# How each kind is written. Groups repeat a bounded number of times (a domain has at most 127 dots), since the
# matcher descends a level for each repetition.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d]|-\d)"
DAY_DATE = r"(?<![\d./-])\d{1,2}[./-]\d{1,2}[./-]\d{4}(?!\d|[./-]\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
PHONE = r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
CARD = r"(?<![\d])\d(?:[ -]?\d){12,18}(?!\d)"
KINDS = {
    "email": EMAIL, "address": ADDRESS, "iso_date": ISO_DATE, "day_date": DAY_DATE, "social": SOCIAL, "phone": PHONE, "card": CARD,
}
#: Cards in their usual groups, with one separator or none.
_GROUPS = [r"\d{13,19}"] + [
    s.join(rf"\d{{{n}}}" for n in sizes) for s in " -" for sizes in ((4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, "4,5"))
]
CARD_IN_GROUPS = rf"(?<!\d)(?=4|5[1-5]|2[2-7]|3[04678]|6)(?:{'|'.join(_GROUPS)})(?!\d)"
FIRST = "|".join([*(p for kind, p in KINDS.items() if kind != "card"), rf"{CARD_IN_GROUPS}(?![ -]\d)"])


def _function(key: str, kind: str, turn: Column, half: Column, modulus: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long") % modulus


def feistel(value: Column, a: Column | int, b: Column | int, key: str, kind: str, inverse: bool = False) -> Column:
    """Keyed permutation of 0 .. a * b - 1. An even number of rounds brings the halves back to their own ranges."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (a, b))

    def forward(s: Column, i: Column) -> Column:
        modulus = F.when(i % 2 == 0, a).otherwise(b)
        return F.struct(s["r"].alias("l"), ((s["l"] + _function(key, kind, i, s["r"], modulus)) % modulus).alias("r"))

    def back(s: Column, i: Column) -> Column:
        modulus = F.when(i % 2 == 0, a).otherwise(b)
        return F.struct(F.pmod(s["r"] - _function(key, kind, i, s["l"], modulus), modulus).alias("l"), s["l"].alias("r"))

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(_whole(value, b).alias("l"), (value % b).alias("r"))
    end = F.aggregate(turns, start, back if inverse else forward)
    return end["l"] * b + end["r"]


def _whole(value: Column, b: Column) -> Column:
    """Division of whole numbers."""
    return F.call_function("div", value, b)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _put(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by those of ``digits``."""
    return F.aggregate(
        F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(
            F.concat(s["out"], F.substring(digits, s["k"] + 1, F.lit(1))).alias("out"), (s["k"] + 1).alias("k"),
        )).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))),
    )["out"]


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number whose last digit is at a doubled place."""
    places = F.reverse(F.split(digits, ""))
    each = F.transform(F.filter(places, lambda c: c != ""), lambda c, i: F.when(
        i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _check_digit(body: Column) -> Column:
    return ((10 - _luhn_sum(body) % 10) % 10).cast("string")


def _card(m: Column, key: str, inverse: bool) -> tuple[Column, Column]:
    """The issuer's six digits stay, the account is permuted, the check digit follows."""
    digits = _digits(m)
    n = F.length(digits)
    body, check = F.substring(digits, F.lit(1), n - 1), F.substring(digits, n, F.lit(1))
    valid = digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6)") & (_check_digit(body) == check)
    free = n - 7
    powers = F.array(*[F.lit(10 ** i).cast("long") for i in range(7)])
    high, low = F.get(powers, (free - F.floor(free / 2)).cast("int")), F.get(powers, F.floor(free / 2).cast("int"))
    account = feistel(F.substring(digits, F.lit(7), free).cast("long"), high, low, key, "card", inverse)
    changed = F.concat(F.substring(digits, 1, 6), _padded(account, free))
    return valid, _put(m, F.concat(changed, _check_digit(changed)))


def _phone(m: Column, key: str, inverse: bool) -> tuple[Column, Column]:
    """Ten digits; the way they are written, with country code, brackets or separators, makes them a phone number."""
    digits = _digits(m)
    own = _padded(feistel(F.substring(digits, -10, 10).cast("long"), 100_000, 100_000, key, "phone", inverse), 10)
    return F.lit(True), _put(m, F.when(F.length(digits) > 10, F.concat(F.lit("1"), own)).otherwise(own))


def _social(m: Column, key: str, inverse: bool) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    new = feistel((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "social", inverse)
    upper, serial = _whole(new, F.lit(9999).cast("long")), new % 9999 + 1
    rank = _whole(upper, F.lit(99).cast("long"))
    area = F.when(rank >= 665, rank + 2).otherwise(rank + 1)
    return valid, F.concat_ws("-", _padded(area, 3), _padded(upper % 99 + 1, 2), _padded(serial, 4))


def _address(m: Column, key: str, inverse: bool) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    place = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = feistel(place, 1 << 16, 1 << 16, key, "address", inverse)
    parts = [(F.shiftright(new, 8 * i) % 256).cast("string") for i in (3, 2, 1, 0)]
    return F.forall(octets, lambda x: x < 256), F.concat_ws(".", *parts)


def _date(day: Column, key: str, inverse: bool) -> tuple[Column, Column]:
    """(valid, new day) of a date that may be null."""
    a, b = DAY_HALVES
    place = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    new = feistel(place, a, b, key, "date", inverse)
    valid = day.isNotNull() & (place >= 0) & (place < a * b)
    return F.coalesce(valid, F.lit(False)), F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int"))


def _iso_date(m: Column, key: str, inverse: bool) -> tuple[Column, Column]:
    valid, new = _date(F.try_to_date(m, "yyyy-MM-dd"), key, inverse)
    return valid, F.date_format(new, "yyyy-MM-dd")


def _day_date(m: Column, key: str, inverse: bool) -> tuple[Column, Column]:
    """Day first; month first only where the day-first reading is no date. Day and month keep at least their length."""
    parts = F.split(m, "[./-]")
    first, second, year = (F.get(parts, F.lit(i)) for i in range(3))
    day_first = F.try_to_date(F.concat_ws("-", year, _padded(second, 2), _padded(first, 2)), "yyyy-MM-dd")
    month_first = F.try_to_date(F.concat_ws("-", year, _padded(first, 2), _padded(second, 2)), "yyyy-MM-dd")
    valid, new = _date(F.coalesce(day_first, month_first), key, inverse)
    day, month = F.dayofmonth(new).cast("string"), F.month(new).cast("string")
    a, b = F.when(day_first.isNotNull(), day).otherwise(month), F.when(day_first.isNotNull(), month).otherwise(day)
    wide = lambda x, like: F.when(F.length(x) < F.length(like), F.lpad(x, 2, "0")).otherwise(x)
    marks = F.regexp_extract_all(m, F.lit("[./-]"), F.lit(0))
    return valid, F.concat(wide(a, first), F.get(marks, F.lit(0)), wide(b, second), F.get(marks, F.lit(1)), F.year(new).cast("string"))


def _email(m: Column, key: str, inverse: bool) -> tuple[Column, Column]:
    domain = F.substring_index(m, "@", -1)
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 12)
    return F.lit(not inverse), F.concat(F.lit("u"), digest, F.lit("@"), domain)


_TREAT: dict[str, Callable[[Column, str, bool], tuple[Column, Column]]] = {
    "email": _email, "address": _address, "iso_date": _iso_date, "day_date": _day_date, "social": _social, "phone": _phone, "card": _card,
}


def _whole_match(kind: str) -> str:
    """The kind's pattern for a match that stands alone."""
    return f"^(?:{KINDS[kind]})$"


def _treated(m: Column, key: str, inverse: bool) -> Column:
    """(kind, text) of one match: the first kind that it is written as; kind is null where the check fails."""
    out = None
    for kind, treat in _TREAT.items():
        valid, new = treat(m, key, inverse)
        fits = m.rlike(_whole_match(kind))
        entry = F.when(valid, F.struct(F.lit(kind).alias("kind"), new.alias("text"))).otherwise(
            F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text")))
        out = F.when(fits, entry) if out is None else out.when(fits, entry)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text")))


def _pieces(text: Column, pattern: str, treat: Callable[[Column], Column]) -> Column:
    """``text`` as an array of (kind, text): treated matches, and what stands between them, with a null kind."""
    between = F.transform(F.split(text, pattern, -1), lambda b: F.struct(F.lit(None).cast("string").alias("kind"), b.alias("text")))
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), treat)
    return F.filter(F.flatten(F.zip_with(between, matches, lambda b, t: F.array(b, t))), lambda p: p["text"].isNotNull())


def _merged(pieces: Column) -> Column:
    """Neighbours of null kind become one piece: what stands before each value, and the value. ``pieces`` is a plain column."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda i: F.get(pieces, i - 1)["kind"].isNotNull())
    starts, ends = F.concat(F.array(F.lit(0)), places), F.concat(places, F.array(F.size(pieces) + 1))

    def part(start: Column, end: Column) -> Column:
        between = F.array_join(F.transform(F.slice(pieces, start + 1, end - start - 1), lambda p: p["text"]), "")
        return F.array(F.struct(F.lit(None).cast("string").alias("kind"), between.alias("text")), F.get(pieces, end - 1))

    return F.filter(F.flatten(F.zip_with(starts, ends, part)), lambda p: p.isNotNull())


def _replace(docs: DataFrame, key: str, text_col: str, counts: bool, inverse: bool) -> DataFrame:
    text, (name,) = F.col(text_col), unused(docs, "_treated")

    def card(m: Column) -> Column:
        valid, new = _card(m, key, inverse)
        return F.struct(F.when(valid, F.lit("card")).alias("kind"), F.when(valid, new).otherwise(m).alias("text"))

    def again(pattern: str) -> Column:
        more = F.flatten(F.transform(_merged(F.col(name)), lambda p: F.when(
            p["kind"].isNull() & p["text"].rlike(pattern), _pieces(p["text"], pattern, card)).otherwise(F.array(p))))
        open_ = F.array_join(F.transform(F.col(name), lambda p: F.when(p["kind"].isNull(), p["text"]).otherwise("|")), "")
        return F.when(text.rlike(CARD) & open_.rlike(pattern), more).otherwise(F.col(name))

    touched = text.rlike(f"{FIRST}|{CARD}")
    marked = docs.withColumn(name, F.when(touched, _pieces(text, FIRST, lambda m: _treated(m, key, inverse))))
    marked = marked.withColumn(name, again(CARD)).withColumn(name, again(CARD_IN_GROUPS))
    joined = F.array_join(F.transform(F.col(name), lambda p: p["text"]), "")
    columns = [
        F.when(F.col(name).isNotNull(), joined).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns
    ]
    named = dict(zip(KINDS, unused(docs, *[f"n_{kind}" for kind in KINDS])))
    return marked.select(*columns, *([_count_of(name, kind).alias(own) for kind, own in named.items()] if counts else []))


def _count_of(name: str, kind: str) -> Column:
    found = F.size(F.filter(F.col(name), lambda t: t["kind"] == kind))
    return F.when(F.col(name).isNotNull(), found).otherwise(0).cast("long")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in the text; with ``counts``, also the number of values replaced by kind (n_email, ..., with a
    longer name where ``docs`` has such a column)."""
    return _replace(docs, key, text_col, counts, False)


def restore(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The inverse of ``pseudonymise`` for all kinds but e-mail addresses.

    A date that was written month first is read day first where its pseudonym allows both, and is then not undone.
    """
    return _replace(docs, key, text_col, False, True)
