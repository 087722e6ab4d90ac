"""Case references: numbers that a body gave to a person or a file.

Level 1 (masked): a trigger word, then the first token with the form of a reference among the next four words of the line.
The window is one look-ahead after the trigger, so a trigger inside the window of another one is still seen.
Level 2 (masked): three or more groups of capitals and digits. Level 3 (flagged): a bare series that nothing covers.
Numbers right behind the name of a public text are no references. Where the rule sheet and habit differ, the sheet holds: a
code prefix such as ``L.`` is a capital, and only a model's own text may open with the name of the public text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions import patterns, text, values

_AMOUNT = f"(?!(?iuU:{values.AMOUNT_AFTER}))"
# within a token a separator is always followed by a letter or digit
_CHAR = "(?:[A-Za-z0-9]|[-/](?=[A-Za-z0-9]))"
_END = "(?![A-Za-z0-9]|[-/][A-Za-z0-9])"
_DIGIT = f"(?={_CHAR}*[0-9])"
_RICH = f"(?={_CHAR}*[A-Za-z]|(?:(?:[A-Za-z]|[-/](?=[A-Za-z0-9]))*[0-9]){{4}})"
_NO_DATE = f"(?!(?:{values.REFERENCE_DATE}){_END})"
_NO_ORDINAL = f"(?!(?iu:{values.ORDINAL}){_END})"
_PLAIN = f"{_DIGIT}{_RICH}{_NO_DATE}{_NO_ORDINAL}[A-Za-z0-9]++(?:[-/][A-Za-z0-9]++)*+{_AMOUNT}"
_SPACED = rf"(?>\d{{1,3}}(?: \d{{3}})+(?!\d)){_AMOUNT}"
_OPENER = "[(«\"']"
_TOKEN = f"{_SPACED}|{_PLAIN}"
_WORD_OK = f"(?:{_SPACED}|(?:{_OPENER}{_PLAIN}|(?!{_OPENER}){_PLAIN}))"
_BLANK = "[^\\S\\n]*+"
_COLON = f"(?:{_BLANK}:(?!\\S))*+"
_SKIPPED = f"(?:{_COLON}{_BLANK}(?!{_WORD_OK})\\S++(?<![.;!?]))"
_AHEAD = f"(?=({_SKIPPED}{{0,{values.WINDOW_WORDS - 1}}}?{_COLON}{_BLANK}(?:{_OPENER}(?={_PLAIN})|(?=(?!{_OPENER}){_TOKEN})))({_TOKEN}))"
_TRIGGER = f"((?<!\\w)(?iu:(?:{values.TRIGGERS})(?!\\w)|{values.TRIGGER_SHORT}|{values.NUMBER_SIGN}))"
ANNOUNCED = f"(?U){_TRIGGER}{_AHEAD}"


def announced(doc: Column, mark: Column | None = None) -> Column:
    """Level 1; two triggers that lead to one number give one span."""
    hint = F.coalesce(doc.rlike("[0-9]"), F.lit(False))
    found = text.spans(doc, F.array_distinct(text.find(doc, ANNOUNCED, "ahead", mark)), "IDENTIFIANT", values.RULE)
    return F.when(hint, found).otherwise(text.none())


def typed(doc: Column, mark: Column | None = None) -> Column:
    """Level 2."""
    hint = F.coalesce(doc.rlike("[0-9]{3}"), F.lit(False))
    found = text.spans(doc, text.find(doc, "(?U)" + patterns.TYPED, mark=mark), "IDENTIFIANT", values.RULE)
    fine = lambda s: s["text"].rlike("[A-Z]") & s["text"].rlike("(?:^|[-/])[0-9]{3,}(?:$|[-/])")
    return F.when(hint, F.filter(found, fine)).otherwise(text.none())


def scan(doc: Column, mark: Column | None = None) -> Column:
    return F.concat(announced(doc, mark), typed(doc, mark))


def flag(doc: Column, kept: Column, mark: Column | None = None) -> Column:
    """Level 3: bare series that overlap nothing in ``kept``; reported, never masked."""
    hint = F.coalesce(doc.rlike("[0-9]{5}"), F.lit(False))
    found = text.spans(doc, text.find(doc, f"(?U){patterns.BARE}(?!(?iuU:{values.AMOUNT_AFTER}))", mark=mark), "IDENTIFIANT", values.FLAG)
    free = F.filter(found, lambda s: ~F.exists(kept, lambda k: text.overlap(s, k)))
    return F.when(hint, free).otherwise(text.none())


_CITED = f"(?U)(?<!\\w)(?iu:{values.PUBLIC_TEXTS})[ ]+"
#: What may stand between the name of a public text and its number.
_CITED_FORMS = (_CITED, f"{_CITED}[nN][°º][ ]*", f"{_CITED}(?:[nN][°º][ ]*)?[A-Z]\\.[ ]*")
_CITES = f"(?iu)(?:{values.PUBLIC_TEXTS})[ ]"
_OWN = f"(?U)\\A(?iu:{values.PUBLIC_TEXTS})(?!\\w)"


def drop_public(doc: Column, spans: Column) -> Column:
    """Without the identifiers that are numbers of laws, decrees, orders or articles."""

    ends = [F.transform(text.find(doc, form), lambda f: f["end"]) for form in _CITED_FORMS]
    cited = F.when(F.coalesce(doc.rlike(_CITES), F.lit(False)), F.concat(*ends)).otherwise(F.array().cast("array<int>"))

    def public(s: Column) -> Column:
        own = (s["source"] == values.MODEL) & s["text"].rlike(_OWN)
        return (s["category"] == "IDENTIFIANT") & (F.array_contains(cited, s["start"]) | own)

    return F.filter(spans, lambda s: ~F.coalesce(public(s), F.lit(False)))
