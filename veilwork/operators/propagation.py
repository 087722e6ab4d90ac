"""Propagation: a name found once is masked wherever it stands in the same document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions import text, values


def forms(s: Column) -> Column:
    """What to look for: the text itself and, of a person, each telling word with a capital."""
    words = F.regexp_extract_all(s["text"], F.lit("(?U)[\\w'\\-]+"), F.lit(0))
    telling = F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike("^\\p{Lu}|^\\p{Lt}") & ~w.isin(*values.NO_NAME))
    return F.array_distinct(F.concat(F.array(s["text"]), F.when(s["category"] == "PERSONNE", telling).otherwise(F.array().cast("array<string>"))))


def propagate(doc: Column, spans: Column, mark: Column | None = None) -> Column:
    """Every other whole-word occurrence of a person's or body's forms, with the score of the span it comes from."""
    seeds = F.filter(spans, lambda s: s["category"].isin("PERSONNE", "ORGANISATION"))

    def of_seed(s: Column) -> Column:
        def of_form(f: Column) -> Column:
            pattern = F.concat(F.lit("(?U)(?<!\\w)"), text.quoted(f), F.lit("(?!\\w)"))
            found = F.filter(text.find(doc, pattern, mark=mark), lambda x: ~((x["start"] == s["start"]) & (x["end"] == s["end"])))
            return text.spans(doc, found, s["category"], values.PROPAGATED, s["score"])

        return F.flatten(F.transform(forms(s), of_form))

    return F.coalesce(F.flatten(F.transform(seeds, of_seed)), text.none())
