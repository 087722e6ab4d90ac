"""Reinjection: original values go back into a reply, damaged codes included; what is odd is reported, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import patterns, text, values
from veilwork.operators.codes import TABLE, canonical

ANOMALY = "struct<found:string,reason:string,resolved:string,severity:string>"


def canonical_code(raw: Column) -> Column:
    """A code as the table writes it: trimmed, upper case, underscores, at least three digits."""
    name = F.trim(F.regexp_extract(raw, patterns.DAMAGED_CODE, 1))
    number = F.regexp_extract(raw, patterns.DAMAGED_CODE, 2)
    number = F.when(F.length(number) > 0, number).cast("int")
    return F.format_string("[%s_%03d]", F.regexp_replace(F.upper(name), "[ -]", "_"), number)


def _anomaly(found: Column, reason: str, resolved: Column, severity: str) -> Column:
    return F.struct(found.alias("found"), F.lit(reason).alias("reason"), resolved.cast("string").alias("resolved"), F.lit(severity).alias("severity"))


def reinject(replies: DataFrame, reply_col: str = "reply", table_col: str = "code_table") -> DataFrame:
    """``replies`` with ``restored``, ``n_replaced``, ``anomalies``, ``to_check``, ``unmentioned`` and ``no_problem``.

    The table is an array column of the same row (join replies with tables on their document first); narrow.
    """
    empty = F.array().cast(TABLE)
    df = text.hold(replies, _reply=F.coalesce(F.col(reply_col), F.lit("")), _table=F.coalesce(F.col(table_col).cast(TABLE), empty))
    reply, table, hits = F.col("_reply"), F.col("_table"), F.col("_hits")
    known = F.map_from_entries(F.transform(table, lambda e: F.struct(e["code"], canonical(e["values"]))))
    df = text.hold(df, _known=known, _hits=text.spans(reply, text.find(reply, patterns.DAMAGED_CODE), "", values.RULE))
    found = F.transform(hits, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("raw"), canonical_code(s["text"]).alias("code")))
    df = text.hold(df, _hits=F.transform(found, lambda h: h.withField("value", F.try_element_at(F.col("_known"), h["code"]))))
    before = F.transform(hits, lambda h, i: F.concat(text.piece(reply, F.when(i > 0, F.get(hits, i - 1)["end"]).otherwise(0), h["start"]), F.coalesce(h["value"], h["raw"])))
    last = F.when(F.size(hits) > 0, F.element_at(hits, -1)["end"]).otherwise(0)
    none = F.lit(None).cast("string")
    odd = F.filter(hits, lambda h: h["value"].isNull() | (h["raw"] != h["code"]))
    odd = F.transform(odd, lambda h: F.when(h["value"].isNull(), _anomaly(h["raw"], values.UNKNOWN_CODE, none, values.TO_CHECK)).otherwise(_anomaly(h["raw"], values.REPAIRED_CODE, h["code"], values.TO_CHECK)))
    absent = F.filter(table, lambda e: ~F.contains(reply, e["code"]))
    absent = F.transform(absent, lambda e: _anomaly(e["code"], values.UNMENTIONED_CODE, none, values.INFORMATION))
    df = text.hold(df, restored=F.concat(F.array_join(before, ""), F.substring(reply, last + 1, F.length(reply))), n_replaced=F.size(F.filter(hits, lambda h: h["value"].isNotNull())), anomalies=F.concat(odd, absent).cast(f"array<{ANOMALY}>"))
    df = df.drop("_hits", "_known", "_reply", "_table")
    of = lambda s: F.filter("anomalies", lambda a: a["severity"] == s)
    return df.withColumn("to_check", of(values.TO_CHECK)).withColumn("unmentioned", of(values.INFORMATION)).withColumn("no_problem", F.size("to_check") == 0)


def choose_table(file_table: Column, session_table: Column) -> Column:
    """The table of a file goes before that of the session; null if there is neither."""
    return F.coalesce(file_table.cast(TABLE), session_table.cast(TABLE))


def summary() -> Column:
    """What a person is told of a reply that ``reinject`` restored: counts, what to check, and codes that are not mentioned."""
    count, check, lone = F.col("n_replaced"), F.col("to_check"), F.col("unmentioned")
    point = lambda a: F.concat(F.lit("\n  - "), a["found"], F.lit(" : "), a["reason"], F.coalesce(F.concat(F.lit(" -> "), a["resolved"]), F.lit("")))
    points = F.when(F.size(check) == 0, F.lit("\nrien a verifier")).otherwise(F.concat(F.format_string("\n%d a verifier :", F.size(check)), F.array_join(F.transform(check, point), "")))
    codes = F.when(F.size(lone) == 0, F.lit("")).otherwise(F.concat(F.format_string("\n%d non mentionnes : ", F.size(lone)), F.array_join(F.transform(lone, lambda a: a["found"]), ", ")))
    return F.concat(F.format_string("%d remplaces", count), points, codes)
