"""Check keys of French and international identifiers, as Columns of booleans.

A null value is never valid. Everything stays in the JVM; IBAN uses a running remainder, so no wide integer is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.values import POST_OFFICE


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _chars(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.substring(value, i, F.lit(1)))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, for which ``value`` is computed once however often it is named, also inside loops over spans."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn(value: Column) -> Column:
    d = digits(value)
    return _sure((F.length(d) >= 2) & F.call_function("luhn_check", d))


def siren(value: Column) -> Column:
    return _sure(F.length(digits(value)) == 9) & luhn(value)


def siret(value: Column) -> Column:
    """Luhn; the numbers of the post office have a digit sum divisible by five instead."""
    d = digits(value)
    total = F.aggregate(_chars(d), F.lit(0), lambda s, c: s + c.cast("int"))
    return _sure(F.when(F.length(d) != 14, False).when(d.startswith(POST_OFFICE), total % 5 == 0).otherwise(luhn(d)))


def card(value: Column) -> Column:
    return _sure(F.length(digits(value)).between(13, 19)) & luhn(value)


def iban(value: Column) -> Column:
    """Letters are two digits each. An account of digits is at most 36 digits then, which a decimal holds; what else has the
    shape is at most 66, whose remainder is taken 15 digits at a time."""

    def spelled(raw: Column) -> Column:
        number = F.concat(F.substring(raw, F.lit(5), F.length(raw)), F.substring(raw, F.lit(1), F.lit(4)))
        for i in range(26):
            number = F.replace(number, F.lit(chr(65 + i)), F.lit(str(10 + i)))
        return F.lpad(number, 75, "0")

    def rest(number: Column) -> Column:
        r = F.lit(0).cast("bigint")
        for at in range(1, 75, 15):
            r = (r * 10**15 + F.substring(number, at, 15).cast("bigint")) % 97
        return r == 1

    def short(raw: Column) -> Column:
        country = [(F.ascii(F.substring(raw, i, 1)) - 55).cast("string") for i in (1, 2)]
        return F.concat(F.substring(raw, F.lit(5), F.length(raw)), *country, F.substring(raw, 3, 2)).cast("decimal(38,0)") % 97 == 1

    def holds(raw: Column) -> Column:
        with_letters = F.when(raw.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), _with(spelled(raw), rest))
        return F.when(raw.rlike("^[A-Z]{2}[0-9]{13,32}$"), short(raw)).otherwise(with_letters)

    return _sure(_with(F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", "")), holds))


def nir(value: Column) -> Column:
    """Thirteen characters and a key of two; the Corsican departments 2A and 2B count as 19 and 18."""

    def holds(raw: Column) -> Column:
        number = F.substring(F.replace(F.replace(raw, F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18")), 1, 13)
        right = F.substring(raw, 14, 2).cast("int") == 97 - number.cast("bigint") % 97
        return F.when(raw.rlike("^[0-9]{5}(?:[0-9]{2}|2[AB])[0-9]{8}$"), right)

    return _sure(_with(F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", "")), holds))


def ip(value: Column) -> Column:
    parts = F.split(value, "\\.")
    fine = lambda p: p.rlike("^[0-9]{1,3}$") & (F.when(p.rlike("^[0-9]{1,3}$"), p).cast("int") <= 255)
    return _sure((F.size(parts) == 4) & F.forall(parts, fine))
