"""Rule scan: wide patterns propose, check keys decide. All expressions, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions import keys, patterns, text, values


@dataclass(frozen=True)
class Rule:
    """``hint`` is a cheap test that a text with a match always passes; ``check`` decides on the matched text."""

    category: str
    pattern: str
    check: Callable[[Column], Column] | None = None
    how: str = "match"
    hint: Callable[[Column], Column] | None = None

    def scan(self, doc: Column, mark: Column | None = None) -> Column:
        found = text.spans(doc, text.find(doc, self.pattern, self.how, mark), self.category, values.RULE)
        if self.check:
            found = F.filter(found, lambda s: self.check(s["text"]))
        return F.when(self.hint(doc), found).otherwise(text.none()) if self.hint else found


def _has(part: str) -> Callable[[Column], Column]:
    return lambda doc: F.coalesce(F.contains(doc, F.lit(part)), F.lit(False))


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda doc: F.coalesce(doc.rlike(pattern), F.lit(False))


def _digits(n: int) -> Callable[[Column], Column]:
    return _like(f"[0-9](?:[^0-9\\n]?[0-9]){{{n - 1}}}")


_U = "(?U)"
RULES = (
    Rule("EMAIL", _U + patterns.EMAIL, hint=_has("@")),
    Rule("IBAN", patterns.IBAN, keys.iban, hint=_like("[A-Z]{2}[0-9]{2}")),
    Rule("NIR", patterns.NIR, keys.nir, hint=_like("[12](?:[ .]?[0-9]){4}")),
    Rule("SIRET", patterns.SIRET, keys.siret, hint=_digits(14)),
    Rule("SIREN", patterns.SIREN, keys.siren, hint=_digits(9)),
    Rule("CARTE_BANCAIRE", patterns.CARD, keys.card, hint=_digits(16)),
    Rule("TELEPHONE", patterns.PHONE, hint=_digits(10)),
    Rule("TELEPHONE", patterns.PHONE_ABROAD, hint=_has("+")),
    Rule("IP", patterns.IP, keys.ip, hint=_like("[0-9]\\.[0-9]{1,3}\\.[0-9]")),
    Rule("PLAQUE", patterns.PLATE, hint=_like("[A-Z]-[0-9]{3}-[A-Z]")),
    Rule("DATE_NAISSANCE", f"(?iuU)({patterns.BIRTH_BEFORE})({patterns.DATE})", how="group", hint=_like("[nN][eEéÉ]|[dD][aA][tT][eE]")),
    Rule("CODE_POSTAL_VILLE", _U + patterns.POSTCODE, hint=_like(f"\\p{{Nd}}{{5}} +[{values.CAPITALS}]")),
)


def has_digit(doc: Column) -> Column:
    return F.coalesce(doc.rlike("\\p{Nd}"), F.lit(False))


def scan(doc: Column, mark: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of every rule, in the order of the rules; overlaps between rules are left to fusion.

    Of the supplied rules only the first finds anything in a text without digits: one test skips all others.
    """
    found = [r.scan(doc, mark) for r in rules]
    if rules is not RULES:
        return F.concat(*found)
    return F.concat(found[0], F.when(has_digit(doc), F.concat(*found[1:])).otherwise(text.none()))
