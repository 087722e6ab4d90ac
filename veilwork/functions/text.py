"""Spans of text as arrays, found and used without leaving the row.

Spark has no function that finds all matches with their offsets. ``find`` marks every match with a private-use character that the
text does not hold, splits on it, and folds the lengths of the parts to offsets; look-behind sees the original text
because the replacement never looks at what it wrote. Offsets are code points, half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,category:string,text:string,source:string,score:double>"
SPANS = f"array<{SPAN}>"
_FOUND = "array<struct<start:int,end:int>>"
#: The mark is the first of these that the text does not hold, or else the first such private-use character at all.
MARKS = ("\ue000", "\ue001", "\uf8fe", "\uf8ff", "\ufdd0", "\ufdd1")


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, wherever they are used.

    The optimizer would copy an expression into each place that names it (also into the loops of higher-order functions,
    and into a filter in front of every explode); it leaves alone what it must take for indeterminate.
    """
    return df.withColumns({n: F.when(F.rand(0) + 1 > F.rand(1), c) for n, c in columns.items()})


def none() -> Column:
    return F.array().cast(SPANS)


def mark_for(text: Column) -> Column:
    free = [F.when(~F.contains(text, F.lit(m)), F.lit(m)) for m in MARKS]
    every = F.split(F.lit("".join(map(chr, range(0xE000, 0xF900)))), "")  # 6,400 of them; only looked at where the few are taken
    other = F.get(F.filter(every, lambda c: (F.length(c) > 0) & ~F.contains(text, c)), F.lit(0))
    return F.coalesce(*free, other, F.raise_error(F.lit("a text holds every private-use character")).cast("string"))


def _fold(parts: Column, period: int) -> Column:
    """Offsets from the parts: of each ``period`` the last is a match, one before it (of three) what is skipped."""
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("skip"), F.lit(0).alias("k"), F.array().cast(_FOUND).alias("out"))

    def step(a: Column, part: Column) -> Column:
        n, turn = F.length(part), a["k"] % period
        here = a["pos"] + a["skip"]
        hit = turn == period - 1
        moves = hit if period == 2 else F.lit(False)
        return F.struct(
            (a["pos"] + F.when((turn == 0) | moves, n).otherwise(0)).alias("pos"),
            F.when(F.lit(period == 3) & (turn == 1), n).otherwise(0).alias("skip"),
            (a["k"] + 1).alias("k"),
            F.when(hit, F.array_append(a["out"], F.struct(here.alias("start"), (here + n).alias("end")))).otherwise(a["out"]).alias("out"),
        )

    def folded(p: Column) -> Column:
        every = F.aggregate(p, start, step, lambda a: a["out"])
        if period == 3:
            return every
        at = F.length(F.get(p, F.lit(0)))
        one = F.array(F.struct(at.alias("start"), (at + F.length(F.get(p, F.lit(1)))).alias("end"))).cast(_FOUND)
        return F.when(F.size(p) == 3, one).otherwise(every)  # a single match, which most texts with one have, needs no fold

    return F.get(F.transform(F.array(parts), folded), F.lit(0))


def find(text: Column, pattern: str | Column, how: str = "match", mark: Column | None = None) -> Column:
    """All matches as ``array<struct<start,end>>``; null text has none.

    ``match``: the whole match. ``group``: the pattern is two groups, and the second is the span. ``ahead``: a group, then a
    look-ahead of two groups, and the last is the span, so that what is skipped may hold further matches. ``mark`` is
    ``mark_for(text)`` where the caller holds it. A text that has no match of a fixed pattern is only searched, neither marked nor split.
    """
    text = F.coalesce(text, F.lit(""))
    m = mark_for(text) if mark is None else mark
    shape = {"match": (m, F.lit("$0"), m), "group": (F.lit("$1"), m, F.lit("$2"), m), "ahead": (F.lit("$1"), m, F.lit("$2"), m, F.lit("$3"), m)}[how]
    fixed = isinstance(pattern, str)
    found = _fold(F.split(F.regexp_replace(text, F.lit(pattern) if fixed else pattern, F.concat(*shape)), m, -1), 3 if how == "ahead" else 2)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_FOUND)) if fixed else found


def piece(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def span(text: Column, start: Column, end: Column, category: Column | str, source: Column | str, score: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(start.alias("start"), end.alias("end"), lit(category).alias("category"), piece(text, start, end).alias("text"), lit(source).alias("source"), (F.lit(1.0) if score is None else score).alias("score"))


def spans(text: Column, found: Column, category: Column | str, source: Column | str, score: Column | None = None) -> Column:
    return F.transform(found, lambda f: span(text, f["start"], f["end"], category, source, score))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def quoted(value: Column) -> Column:
    """A value as a literal pattern."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def by_start(array: Column) -> Column:
    keyed = F.transform(array, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])
