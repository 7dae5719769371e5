"""Pseudonyms for personal data that keep its format, by keyed Feistel permutations."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: What each kind of personal data looks like.  An earlier kind wins.
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "secret": _EDGE + r"(?=[0-9A-Fa-f]*+" + _END + r")(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,64}",
    "date": _EDGE + r"(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})" + _END,
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    "ip": r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?[\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+?\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}" + _END,
    "number": _EDGE + r"\d(?:[ \-]?\d){12,18}" + _END,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days from 1900-01-01 to 2099-12-31, and the sides of the field in which they are permuted.
DAYS, DAY_SIDES, WALKS = 73_049, (271, 270), 12


def _number(key: str, kind: str, r: Column, other: Column, modulus: int | Column) -> Column:
    """A keyed function of the other half, below modulus."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), r.cast("string"), other.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), F.lit(modulus) if isinstance(modulus, int) else modulus)


def permute_pair(left: Column, right: Column, sides: tuple[int, int], key: str, kind: str, *, back: bool = False) -> Column:
    """struct(l, r): a permutation of the numbers below sides[0] times those below sides[1]."""
    a, b = sides
    sign = -1 if back else 1

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        l2 = F.when(even, F.pmod(s["l"] + sign * _number(key, kind, r, s["r"], a), F.lit(a))).otherwise(s["l"])
        r2 = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * _number(key, kind, r, s["l"], b), F.lit(b)))
        return F.struct(l2.cast("long").alias("l"), r2.cast("long").alias("r"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(F.reverse(rounds) if back else rounds, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def permute_text(value: Column, key: str, kind: str, classes: dict[str, str], *, back: bool = False) -> Column:
    """A permutation of the texts of one shape: each character stays in its class.

    The characters of both halves turn in place by keyed amounts that depend on
    the other half.  A character in no class stays.
    """
    sign = -1 if back else 1

    def shifted(half: Column, other: Column, r: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            out = c
            for members in classes.values():
                n = len(members)
                place = F.instr(F.lit(members), c) - 1
                moved = F.pmod(place + sign * _number(key, kind, F.concat_ws(".", r.cast("string"), i.cast("string")), other, n), F.lit(n))
                out = F.when(place >= 0, F.substring(F.lit(members), (moved + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, shifted(s["l"], s["r"], r)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(shifted(s["r"], s["l"], r)).alias("r"))

    middle = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), middle).alias("l"), F.substring(value, middle + 1, F.length(value)).alias("r"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    done = F.aggregate(F.reverse(rounds) if back else rounds, start, turn)
    return F.concat(done["l"], done["r"])


_DIGITS = {"digits": "0123456789"}
_NAME = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | _DIGITS


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _into_shape(shape: Column, digits: Column) -> Column:
    """The digits, in the places of shape's digits."""
    places = F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), lambda c: F.struct(c.alias("c"), c.rlike(r"\d").alias("d")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(s: Column, p: Column) -> Column:
        return F.struct(
            F.concat(s["out"], F.when(p["d"], F.substring(digits, s["n"] + 1, F.lit(1))).otherwise(p["c"])).alias("out"),
            (s["n"] + F.when(p["d"], 1).otherwise(0)).cast("int").alias("n"),
        )

    return F.aggregate(places, start, put)["out"]


def check_digit(digits: Column) -> Column:
    """Luhn's check digit for the digits before it."""
    from_right = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, 2 * c.cast("int")).otherwise(c.cast("int")))
    total = F.aggregate(F.transform(from_right, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda s, d: (s + d).cast("int"))
    return F.pmod(-total, F.lit(10))


def _email(value: Column, key: str, back: bool) -> Column:
    return F.concat(permute_text(F.substring_index(value, "@", 1), key, "email", _NAME, back=back), F.lit("@"), F.substring_index(value, "@", -1))


def _secret(value: Column, key: str, back: bool) -> Column:
    lower, upper = {"hex": "0123456789abcdef"}, {"hex": "0123456789ABCDEF"}
    return F.when(value == F.lower(value), permute_text(value, key, "hex", lower, back=back)).otherwise(
        F.when(value == F.upper(value), permute_text(value, key, "hex", upper, back=back)).otherwise(permute_text(value, key, "mixed", {"d": "0123456789", "l": "abcdef", "u": "ABCDEF"}, back=back))
    )


def _days(value: Column) -> dict[str, Column]:
    """Days since 1900 by the shape of the date; null if it isn't a date from 1900 to 2099 in that shape."""
    found = {}
    for pattern, shape in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/\d{2}/", "dd/MM/yyyy")):
        date = F.try_to_date(value, shape) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(value, F.lit(shape)))
        day = F.datediff(date, F.lit("1900-01-01").cast("date"))
        found[shape] = F.when(value.rlike(pattern) & (day >= 0) & (day < DAYS), day)
    return found


def _date(value: Column, key: str, back: bool) -> Column:
    """A date from 1900 to 2099, by its day."""

    def walk(day: Column) -> Column:
        a, b = DAY_SIDES
        start = F.struct(day.cast("long").alias("day"), F.lit(False).alias("done"))

        def step(s: Column, _: Column) -> Column:
            pair = permute_pair(F.floor(s["day"] / b), s["day"] % b, DAY_SIDES, key, "date", back=back)
            moved = F.when(s["done"], s["day"]).otherwise(pair["l"] * b + pair["r"])
            return F.struct(moved.cast("long").alias("day"), (moved < DAYS).alias("done"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, step)["day"]

    out = value
    for shape, day in _days(value).items():
        out = F.when(day.isNotNull(), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), walk(day).cast("int")), shape)).otherwise(out)
    return out


def _ssn_parts(value: Column) -> tuple[Column, Column, Column]:
    area, group, serial = (F.substring(value, a, n).try_cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    return area, group, serial


def _ssn(value: Column, key: str, back: bool) -> Column:
    """Valid areas (001-899 without 666), groups (01-99) and serials (0001-9999) are permuted among themselves."""
    area, group, serial = _ssn_parts(value)
    left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    pair = permute_pair(left, serial - 1, (898 * 99, 9999), key, "ssn", back=back)
    area2 = F.floor(pair["l"] / 99) + 1
    area2 = area2 + F.when(area2 >= 666, 1).otherwise(0)
    return F.format_string("%03d-%02d-%04d", area2.cast("long"), (pair["l"] % 99 + 1).cast("long"), (pair["r"] + 1).cast("long"))


def _ip(value: Column, key: str, back: bool) -> Column:
    part = F.transform(F.split(value, r"\."), lambda p: p.try_cast("long"))
    pair = permute_pair(F.get(part, 0) * 256 + F.get(part, 1), F.get(part, 2) * 256 + F.get(part, 3), (65536, 65536), key, "ip", back=back)
    return F.concat_ws(".", *[x.cast("string") for side in ("l", "r") for x in (F.floor(pair[side] / 256), pair[side] % 256)])


def _phone(value: Column, key: str, back: bool) -> Column:
    """The country code stays."""
    digits = _only_digits(value)
    before = F.length(digits) - 10
    moved = F.concat(F.substring(digits, F.lit(1), before), permute_text(F.substring(digits, before + 1, F.lit(10)), key, "phone", _DIGITS, back=back))
    return _into_shape(value, moved)


def _long_number(value: Column, key: str, back: bool) -> Column:
    """13 to 19 digits, of which the last is Luhn's check digit."""
    digits = _only_digits(value)
    moved = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "number", _DIGITS, back=back)
    return _into_shape(value, F.concat(moved, check_digit(moved).cast("string")))


def _has_check_digit(value: Column) -> Column:
    digits = _only_digits(value)
    return check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1).try_cast("int")


def _has_areas(value: Column) -> Column:
    area, group, serial = _ssn_parts(value)
    return (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)


KINDS: dict[str, Callable[[Column, str, bool], Column]] = {
    "email": _email,
    "secret": _secret,
    "date": _date,
    "ssn": _ssn,
    "ip": _ip,
    "phone": _phone,
    "number": _long_number,
}


#: What a match must be besides its pattern; the other kinds are valid as they stand.
VALID: dict[str, Callable[[Column], Column]] = {
    "date": lambda value: functools.reduce(operator.or_, [day.isNotNull() for day in _days(value).values()]),
    "ssn": _has_areas,
    "ip": lambda value: F.forall(F.split(value, r"\."), lambda p: (p.try_cast("int") < 256) & (p.try_cast("int").cast("string") == p)),
    "number": _has_check_digit,
}


def _kind(value: Column) -> Column:
    """The kind of a whole match of ANY, null if it isn't valid."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        found = F.when(F.coalesce(VALID[kind](value), F.lit(False)), kind) if kind in VALID else F.lit(kind)
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), found).otherwise(out)
    return out


def pseudonym(value: Column, key: str, *, back: bool = False) -> Column:
    """value: a whole match of ANY -> its pseudonym, or with ``back`` the value that has it; itself if it isn't valid."""
    kind, out = _kind(value), value
    for name in KINDS:
        out = F.when(kind == name, KINDS[name](value, key, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """Whole texts with pseudonyms for personal data -> doc_id, text, n_found.

    E-mail names, hexadecimal secrets, dates from 1900 to 2099, social security
    numbers, IPv4 addresses, phone numbers and long numbers with a check digit
    (cards) are permuted by a Feistel network under ``key``, each among the
    valid values of its format.  What only looks like one (30.02.2020, 999.1.1.1,
    a number whose check digit is wrong) stays and isn't counted.  Equal values
    get equal pseudonyms in all documents, different values of one shape
    different ones, and whoever has the key gets the texts back (``back``).

    A null text stays null with n_found 0; the empty text stays.  Every row
    counts for itself, so repeated rows, ties and an empty table need no rule.
    """
    text, none = F.col("text"), F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = F.when(text.rlike(r"[0-9@]") & text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)
    rows = rows.withColumn("found", F.when(text.isNotNull(), found).otherwise(none))
    rows = rows.withColumn("n_found", F.size(F.filter("found", lambda v: _kind(v).isNotNull())).cast("long"))
    new = F.transform("found", lambda v: pseudonym(v, key, back=back))
    woven = F.zip_with(F.split(text, ANY, -1), new, lambda part, name: F.concat(part, F.coalesce(name, F.lit(""))))
    return rows.select("doc_id", F.when(F.col("n_found") > 0, F.array_join(woven, "")).otherwise(text).alias("text"), "n_found")
