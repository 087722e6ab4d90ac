"""Scoring of predicted against expected spans: masked, typed and whole recall, precision, criteria, audits.

Overlaps are tested inside a document's own row, so scoring needs no range join; only the small counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import patterns, text, values

EXPECTED = "array<struct<start:int,end:int,category:string>>"


def whole_words(doc: Column, wanted: Column) -> Column:
    """Occurrences of a literal, with word boundaries only on the sides where it is alphanumeric."""
    left = F.when(wanted.rlike("(?U)\\A[\\p{L}\\p{N}]"), "(?<!\\w)").otherwise("")
    right = F.when(wanted.rlike("(?U)[\\p{L}\\p{N}]\\z"), "(?!\\w)").otherwise("")
    return text.find(doc, F.concat(F.lit("(?U)"), left, text.quoted(wanted), right))


def expected(doc: Column, directs: Column) -> Column:
    """Annotated strings (map of category to strings) as spans: all occurrences, longest first, without overlap."""

    def of_category(e: Column) -> Column:
        per = F.transform(e["value"], lambda w: F.transform(whole_words(doc, w), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), e["key"].alias("category"))))
        return F.flatten(per)

    every = F.flatten(F.transform(F.map_entries(directs), of_category)).cast(EXPECTED)
    order = F.array_sort(F.transform(every, lambda s, i: F.struct((s["start"] - s["end"]).alias("a"), s["start"].alias("b"), i.alias("i"), s.alias("s"))))
    keep = lambda kept, k: F.when(F.exists(kept, lambda o: text.overlap(o, k["s"])), kept).otherwise(F.array_append(kept, k["s"]))
    return F.array_sort(F.aggregate(order, F.array().cast(EXPECTED), keep))


def coverage(start: Column, end: Column, spans: Column) -> Column:
    """Share of the characters of [start, end) that some span covers; an empty range has none."""
    cut = F.transform(spans, lambda s: F.struct(F.greatest(s["start"], start).alias("a"), F.least(s["end"], end).alias("b")))
    cut = F.array_sort(F.filter(cut, lambda c: c["a"] < c["b"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to"))
    step = lambda acc, c: F.struct((acc["n"] + F.greatest(F.lit(0), c["b"] - F.greatest(c["a"], acc["to"]))).alias("n"), F.greatest(acc["to"], c["b"]).alias("to"))
    return F.when(end <= start, 0.0).otherwise(F.aggregate(cut, zero, step, lambda a: a["n"].cast("double")) / (end - start))


def score_expected(docs: DataFrame, expected_col: str = "expected", spans_col: str = "spans") -> DataFrame:
    """One row an expected span: ``coverage``, ``n_overlaps``, ``masked``, ``typed``, ``whole`` and ``reason``."""
    df = docs.select("doc_id", F.col(spans_col).alias("_p"), F.explode(expected_col).alias("e"))
    e, p = F.col("e"), F.col("_p")
    hits = F.filter(p, lambda s: text.overlap(s, e))
    df = df.select("doc_id", e["start"].alias("start"), e["end"].alias("end"), e["category"].alias("category"), coverage(e["start"], e["end"], p).alias("coverage"), F.size(hits).alias("n_overlaps"), F.exists(hits, lambda s: s["category"] == e["category"]).alias("_same"))
    df = df.withColumn("masked", F.col("coverage") >= values.COVERED).withColumn("typed", F.col("masked") & F.col("_same"))
    df = df.withColumn("whole", (F.col("coverage") >= 1.0) & (F.col("n_overlaps") == 1)).drop("_same")
    reason = F.when(F.col("coverage") < 1.0, F.format_string("masquee a %.0f%%", F.col("coverage") * 100)).when(F.col("n_overlaps") > 1, F.format_string("entiere mais en %d codes", "n_overlaps")).otherwise("")
    return df.withColumn("reason", reason)


def partial_addresses(scored: DataFrame) -> DataFrame:
    """The expected addresses that are neither missed nor covered whole by one span, with the reason."""
    return scored.where((F.col("category") == "ADRESSE") & (F.col("coverage") > 0) & ~F.col("whole")).select("doc_id", "start", "end", "coverage", "reason")


def score_predicted(docs: DataFrame, expected_col: str = "expected", spans_col: str = "spans") -> DataFrame:
    """One row a predicted span and whether it is right, that is, overlaps any expected span."""
    df = docs.select("doc_id", F.col(expected_col).alias("_e"), F.explode(spans_col).alias("p"))
    right = F.exists(F.col("_e"), lambda e: text.overlap(e, F.col("p")))
    return df.select("doc_id", "p.start", "p.end", "p.category", right.alias("right"))


def report(scored: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per category and for all (category null): expected, masked, typed, whole, false alarms, and ratios."""
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    one = scored.rollup("category").agg(F.count("*").alias("expected"), n("masked"), n("typed"), n("whole"))
    alarms = predicted.rollup("category").agg(F.count("*").alias("predicted"), F.sum((~F.col("right")).cast("long")).alias("false_alarms"))
    a = alarms.withColumnRenamed("category", "_c")
    out = one.join(a, F.col("category").eqNullSafe(F.col("_c")), "full_outer").withColumn("category", F.coalesce("category", "_c")).drop("_c")
    out = out.na.fill(0, ["expected", "masked", "typed", "whole", "predicted", "false_alarms"])
    share = lambda x: F.when(F.col("expected") > 0, F.col(x) / F.col("expected"))
    out = out.withColumn("recall", share("masked")).withColumn("typed_recall", share("typed")).withColumn("whole_recall", share("whole"))
    return out.withColumn("precision", F.when(F.col("predicted") > 0, 1 - F.col("false_alarms") / F.col("predicted")))


def criteria(scored: DataFrame) -> DataFrame:
    """The preset criteria: ``(criterion, target, expected, masked, reached, met)``."""
    parts = [(name, c, target) for name, (cats, target) in values.CRITERIA.items() for c in cats]
    table = scored.sparkSession.createDataFrame(parts, "criterion string, _c string, target double")
    by = scored.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.col("masked").cast("long")).alias("m"))
    out = table.join(by, F.col("_c") == F.col("category"), "left").groupBy("criterion", "target")
    out = out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("expected"), F.coalesce(F.sum("m"), F.lit(0)).alias("masked"))
    out = out.withColumn("reached", F.when(F.col("expected") > 0, F.col("masked") / F.col("expected")).otherwise(0.0))
    return out.withColumn("met", F.col("reached") >= F.col("target"))


def indirects(docs: DataFrame, phrases_col: str = "indirects", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``(doc_id, phrase, covered)`` for the first occurrence of each indirect phrase; a phrase that is absent gives null."""
    df = docs.select("doc_id", F.col(text_col).alias("_t"), F.col(spans_col).alias("_p"), F.explode(phrases_col).alias("phrase"))
    at = F.instr(F.col("_t"), F.col("phrase")) - 1
    return df.select("doc_id", "phrase", F.when(at >= 0, coverage(at, at + F.length("phrase"), F.col("_p")) >= values.COVERED).alias("covered"))


def references(cases: DataFrame) -> DataFrame:
    """``cases`` (group, id, phrase, references, spans, flags) as ``(group, id, reference, outcome, reason)``.

    An outcome is masked, flagged or failed; a group of traps has one row for each wrongly masked identifier.
    """
    df = cases.select("group", "id", "phrase", "spans", "flags", F.explode("references").alias("reference"))
    at = F.instr(F.col("phrase"), F.col("reference")) - 1
    df = df.withColumn("a", at).withColumn("b", at + F.length("reference"))
    df = df.withColumn("c", coverage(F.col("a"), F.col("b"), F.col("spans"))).withColumn("n", F.size(F.filter("spans", lambda s: (s["start"] < F.col("b")) & (F.col("a") < s["end"]))))
    flagged = F.exists("flags", lambda f: (f["start"] <= F.col("a")) & (F.col("b") <= f["end"]))
    outcome = F.when((F.col("c") >= 1.0) & (F.col("n") == 1), "masked").when(flagged, "flagged").otherwise("failed")
    reason = F.when(F.col("c") < 1.0, F.format_string("masquee a %.0f%%", F.col("c") * 100)).when(F.col("n") > 1, F.format_string("entiere mais en %d codes", "n")).otherwise("")
    out = df.select("group", "id", "reference", outcome.alias("outcome"), reason.alias("reason"))
    traps = cases.where(F.size("references") == 0).select("group", "id", F.explode(F.filter("spans", lambda s: s["category"] == "IDENTIFIANT")).alias("s"))
    return out.unionByName(traps.select("group", "id", F.col("s.text").alias("reference"), F.lit("false alarm").alias("outcome"), F.lit("").alias("reason")))


def truth_errors(texts: DataFrame, truth: DataFrame) -> DataFrame:
    """What is wrong with annotations ``(name, directs, indirects)`` of texts ``(name, text)``: ``(name, problem, value)``."""
    left, right = texts.select("name"), truth.select("name")
    lone = left.exceptAll(right).select("name", F.lit("text without truth").alias("problem")).unionByName(right.exceptAll(left).select("name", F.lit("truth without text").alias("problem")))
    both = texts.select("name", "text").join(truth, "name")
    direct = both.select("name", "text", F.explode("directs").alias("category", "strings")).select("name", "text", F.explode("strings").alias("value"))
    missing = direct.where(F.size(whole_words(F.col("text"), F.col("value"))) == 0).select("name", F.lit("annotation not found").alias("problem"), "value")
    phrases = both.select("name", "text", F.explode("indirects").alias("value")).where(~F.contains("text", "value")).select("name", F.lit("indirect not found").alias("problem"), "value")
    return lone.withColumn("value", F.lit(None).cast("string")).unionByName(missing).unionByName(phrases)


def unannotated(docs: DataFrame, text_col: str = "text", expected_col: str = "expected") -> DataFrame:
    """``(doc_id, pattern, value)``: matches of the coarse audit patterns that touch no expected span."""
    doc = F.coalesce(F.col(text_col), F.lit(""))

    def matches(name: str, pattern: str) -> Column:
        one = lambda f: F.struct(F.lit(name).alias("pattern"), f["start"].alias("start"), f["end"].alias("end"), text.piece(doc, f["start"], f["end"]).alias("value"))
        return F.transform(text.find(doc, f"(?U){pattern}"), one)

    found = [matches(n, p) for n, p in patterns.AUDIT.items()]
    df = text.hold(docs.select("doc_id", F.col(expected_col).alias("_e"), F.col(text_col)), _m=F.concat(*found))
    df = df.select("doc_id", "_e", F.explode("_m").alias("m"))
    df = df.where(~F.exists("_e", lambda e: text.overlap(e, F.col("m"))))
    return df.select("doc_id", "m.pattern", "m.value")
