"""Patterns of personal data, built from small named parts.

A part says what one piece of a value looks like, ``alone`` what may not touch it, and ``spaced`` how its pieces may be set
apart. Rules compile them with Unicode classes where a word may hold accents.
"""

from __future__ import annotations

from veilwork.functions.values import CAPITALS, CEDEX, COMPLEMENT_BOXES, COMPLEMENT_WORDS, MONTHS, PLACE_ARTICLES, STREET_PARTICLES, STREET_REPEATS, STREETS


def either(*parts: str) -> str:
    return f"(?:{'|'.join(parts)})"


def maybe(part: str) -> str:
    return f"(?:{part})?"


def times(part: str, least: int, most: int | None = None) -> str:
    return f"(?:{part}){{{least},{'' if most is None else most}}}"


def alone(part: str, before: str = r"\d", behind: str = r"\d") -> str:
    """``part`` where neither ``before`` stands in front of it nor ``behind`` after it."""
    return f"(?<!{before}){part}(?!{behind})"


def digits(least: int, most: int | None = None) -> str:
    return rf"\d{{{least if most is None else f'{least},{most}'}}}"


def spaced(*parts: str, by: str = " ") -> str:
    """``parts`` in a row; any two may be set apart by one of the characters ``by``."""
    return f"[{by}]?".join(parts)


# -- mail, networks, accounts ---------------------------------------------------------------------------------------
_LOCAL, _LABEL = r"[\w.+-]", r"[\w-]"
EMAIL = alone(rf"{_LOCAL}+@{_LABEL}+(?:\.{_LABEL}+)+", _LOCAL, _LABEL)

_BYTE = digits(1, 3)
IP = alone(_BYTE + rf"(?:\.{_BYTE}){{3}}", r"[\d.]", r"\.?\d")

_COUNTRY, _ACCOUNT = "[A-Z]{2}", "[A-Z0-9]"
IBAN = alone(_COUNTRY + digits(2) + times(f"[ ]?{_ACCOUNT}{{2,4}}", 2, 8), f"[{CAPITALS}0-9]", _ACCOUNT)

CARD = alone(spaced(*[digits(4)] * 4, by=r" \-"))

# -- numbers of persons and companies -------------------------------------------------------------------------------
_SEX, _YEAR, _MONTH, _DEPARTMENT, _TOWN, _PLACE_IN_TOWN, _KEY = "[12]", digits(2), digits(2), either(digits(2), "2[AB]"), digits(3), digits(3), digits(2)
NIR = alone(spaced(_SEX, _YEAR, _MONTH, _DEPARTMENT, _TOWN, _PLACE_IN_TOWN, _KEY, by=" ."))

_COMPANY = [digits(3)] * 3
SIREN = alone(spaced(*_COMPANY))
SIRET = alone(spaced(*_COMPANY, digits(5)))

# -- phones, plates, dates ------------------------------------------------------------------------------------------
_PHONE_GAP = r" .\-"
PHONE = alone(spaced("0[1-9]", *[digits(2)] * 4, by=_PHONE_GAP), r"[\d+]")
PHONE_ABROAD = rf"\+{digits(1, 3)}" + times(rf"[{_PHONE_GAP}]?\d", 6, 14) + r"(?!\d)"

_PLATE_EDGE = rf"[{CAPITALS}0-9\-]"
PLATE = alone("-".join(("[A-Z]{2}", digits(3), "[A-Z]{2}")), _PLATE_EDGE, _PLATE_EDGE)

_DAY_MONTH = digits(1, 2)
WRITTEN_DATE = rf"{_DAY_MONTH}(?:er)?\s+(?:{MONTHS})\s+{digits(4)}"
SHORT_DATE = r"[/.\-]".join((_DAY_MONTH, _DAY_MONTH, digits(2, 4)))
DATE = f"{WRITTEN_DATE}|{SHORT_DATE}"
BIRTH_BEFORE = either(r"n[ée]e?s?\s+le", r"date\s+de\s+naissance\s*:?") + r"\s*"

# -- addresses ------------------------------------------------------------------------------------------------------
_IN_NAME = r"[\w'’\-]"
_FRENCH = maybe(r"(?<![\w\-])F-")
_TOWN_NAME = maybe(f"{either(*PLACE_ARTICLES)}[ \\-]") + f"[{CAPITALS}]{_IN_NAME}*"
POSTCODE = _FRENCH + alone(digits(5)) + "[ ]+" + _TOWN_NAME + maybe(f"[ ]+(?iu:{CEDEX})" + maybe(rf"[ ]+{digits(1, 2)}(?!\d)"))

_HAS_LETTER = rf"(?={_IN_NAME}*[^\W\d_])"
STREET_WORD = f"{_HAS_LETTER}[{CAPITALS}0-9]{_IN_NAME}*"
STREET_PARTICLE = either(f"{either(*(p.replace(' ', '[ ]+') for p in STREET_PARTICLES))}[ ]+", f"{either('de[ ]+l', 'd', 'l')}['’]")
STREET_NUMBER = digits(1, 4) + maybe(rf"[ ]?{either(*STREET_REPEATS)}\b|[A-D]\b")
_STREET_PART = f"{STREET_PARTICLE}?{STREET_WORD}"
_STREET_NAME = _STREET_PART + times(f"[ ]+{_STREET_PART}", 0)
STREET = "(?U)" + r"(?<![\w\-])" + maybe(f"{STREET_NUMBER}[ ]*,?[ ]*") + rf"(?iu:{STREETS})(?![\w\-])[ ]+" + _STREET_NAME
_FLOOR = rf"{digits(1, 2)}{either('e', 'er', '[èe]me')}[ ]+(?iu:[ée]tage)"
_NAMED_PART = rf"(?iu:{COMPLEMENT_WORDS})[ ]+\w{{1,4}}"
_BOX = f"{either(*COMPLEMENT_BOXES)}[ ]?{digits(1, 6)}"
COMPLEMENT = "(?U)" + alone(either(_FLOOR, _NAMED_PART, _BOX), r"\w", r"\w")
ADDRESS_SEPARATORS = r",;:–\-"
ADDRESS_GAP = rf"[\s{ADDRESS_SEPARATORS}]*"
ADDRESS_TRIM = rf"[ {ADDRESS_SEPARATORS}\n\t]+"

# -- references and codes -------------------------------------------------------------------------------------------
_CAPITAL_GROUP, _GROUP_EDGE = "[A-Z0-9]+", r"[\w/\-]"
TYPED = alone(_CAPITAL_GROUP + times(f"[-/]{_CAPITAL_GROUP}", 2), _GROUP_EDGE, _GROUP_EDGE)
BARE = r"(?<![\w\-/])(?<!\d[,.])" + digits(5, 12) + r"(?![\w\-/]|[,.]\d)"

_CODE_NAME, _CODE_GAP = r"[A-Za-z][A-Za-z_ \-]{1,30}?", r"[ _\-]?"
DAMAGED_CODE = rf"\[({_CODE_NAME}){_CODE_GAP}({digits(1, 6)})\]"

# -- coarse patterns of the audit, wider than the rules -------------------------------------------------------------
_PAIRS = digits(2)
AUDIT = {
    "mail": rf"{_LOCAL}+@{_LABEL}+\.[a-z]{{2,}}",
    "iban": "FR" + spaced(digits(2), *[digits(4)] * 5, digits(3)),
    "telephone": either(rf"\+33[ ]?\d(?:[ ]{_PAIRS}){{4}}", rf"0\d(?:[ .]{_PAIRS}){{4}}"),
    "ip": rf"\b{_BYTE}(?:\.{_BYTE}){{3}}\b",
    "plaque": rf"\b[A-Z]{{2}}-{digits(3)}-[A-Z]{{2}}\b",
    "suite_chiffres": r"\b\d[\d ]{6,}\d\b",
}
