"""Review: what people see of the spans, what they add, and what they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import text, values
from veilwork.operators import codes, fusion, propagation


def segments(doc: Column, spans: Column) -> Column:
    """``array<struct<text,category>>`` of a text, category null outside spans; joined they are the text again."""
    kind = "array<struct<text:string,category:string>>"
    none = F.lit(None).cast("string")
    end_before = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
    pairs = F.transform(spans, lambda s, i: F.array(F.struct(text.piece(doc, end_before(i), s["start"]).alias("text"), none.alias("category")), F.struct(text.piece(doc, s["start"], s["end"]).alias("text"), s["category"].alias("category"))))
    last = F.when(F.size(spans) > 0, F.element_at(spans, -1)["end"]).otherwise(0)
    tail = F.array(F.struct(F.substring(doc, last + 1, F.length(doc)).alias("text"), none.alias("category")))
    return F.filter(F.concat(F.flatten(pairs).cast(kind), tail.cast(kind)), lambda x: F.length(x["text"]) > 0)


def origin(s: Column) -> Column:
    """In words where a span comes from; only categories with a check key claim a verified key."""
    out = F.when((s["source"] == values.RULE) & s["category"].isin(*values.KEYED), values.ORIGIN_KEY).when(s["source"] == values.RULE, values.ORIGIN_FORMAT)
    for source, name in values.ORIGINS.items():
        out = out.when(s["source"] == source, name)
    return out


def label(s: Column) -> Column:
    return F.format_string("%s · « %s » — %s (position %d)", s["category"], s["text"], origin(s), s["start"])


def inputs(docs: DataFrame, file_text_col: str, file_error_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` to analyse and ``refused``: a file goes before a text, one that cannot be read or a blank says why it is refused."""
    has_file = F.col(file_text_col).isNotNull() | F.col(file_error_col).isNotNull()
    chosen = F.coalesce(F.when(has_file, F.col(file_text_col)).otherwise(F.col(text_col)), F.lit(""))
    refused = F.coalesce(F.col(file_error_col), F.when(~chosen.rlike("(?U)\\S"), F.lit("vide")))
    return docs.withColumns({text_col: F.when(refused.isNull(), chosen), "refused": refused})


def to_review(analysed: DataFrame) -> DataFrame:
    """``analysed`` with ``review``: spans and flags in order, each with its label and whether it is checked at first."""
    shown = F.transform(text.by_start(F.concat("spans", "flags")), lambda s: F.struct(s.alias("span"), label(s).alias("label"), (s["source"] != values.FLAG).alias("checked")))
    return text.hold(analysed, review=shown).withColumn("n_checked", F.size(F.filter("review", lambda r: r["checked"]))).withColumn("n_flagged", F.size("review") - F.col("n_checked"))


def occurrences(doc: Column, wanted: Column) -> Column:
    """All occurrences of a literal, one after the other, with no regard to word ends."""
    return text.find(doc, text.quoted(wanted))


def add(docs: DataFrame, wanted_col: str, category_col: str, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Spans with a person's addition: every occurrence, fused, then propagated and fused again; blank additions change nothing."""
    doc, wanted = F.coalesce(F.col(text_col), F.lit("")), F.trim(F.coalesce(F.col(wanted_col), F.lit("")))
    mine = text.spans(doc, occurrences(doc, wanted), F.col(category_col), values.HUMAN)
    df = text.hold(docs, _mine=F.when(F.length(wanted) > 0, mine).otherwise(text.none())).withColumn("n_added", F.size("_mine"))
    df = text.hold(df, **{spans_col: fusion.fuse(F.concat("_mine", F.col(spans_col)))})
    more = propagation.propagate(doc, F.col("_mine"))
    return text.hold(df, **{spans_col: fusion.fuse(F.concat(F.col(spans_col), more))}).drop("_mine")


def explode_spans(docs: DataFrame, spans_col: str = "spans") -> DataFrame:
    return docs.select("doc_id", F.inline(spans_col))


def keep(reviewed: DataFrame, decisions: DataFrame) -> DataFrame:
    """``(doc_id, spans, n_kept, n_rejected)``: what ``decisions`` (doc_id, label) keeps; a kept flag is masked, too.

    Rejected spans that are no flags are counted. Documents without a decision keep nothing.
    """
    one = reviewed.select("doc_id", F.explode("review").alias("r")).select("doc_id", F.col("r.span").alias("span"), F.col("r.label").alias("label"))
    chosen = decisions.select(F.col("doc_id").alias("_d"), F.col("label").alias("_l")).distinct()
    hit = one.join(chosen, (F.col("doc_id") == F.col("_d")) & (F.col("label") == F.col("_l")), "left")
    kept = F.col("_l").isNotNull()
    out = hit.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(kept, F.col("span")))).alias("spans"),
        F.sum(kept.cast("long")).alias("n_kept"),
        F.sum((~kept & (F.col("span.source") != values.FLAG)).cast("long")).alias("n_rejected"),
    )
    return out


def produce(docs: DataFrame, kept: DataFrame, text_col: str = "text") -> DataFrame:
    """Masked text and code table of the kept spans; a document of which nothing is kept gives no row."""
    some = kept.where(F.size("spans") > 0)
    df = docs.join(some.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d")).drop("_d")
    df = codes.assign(df)
    return text.hold(df, masked_text=codes.rewrite(F.col(text_col), F.col("spans"), F.col("codes")))


def serialise(spans: Column) -> Column:
    return F.to_json(F.transform(spans, lambda s: F.struct(s["start"].alias("debut"), s["end"].alias("fin"), s["category"].alias("categorie"), s["text"].alias("texte"), s["source"].alias("source"), s["score"].alias("score"))))


def deserialise(value: Column) -> Column:
    kind = "array<struct<debut:int,fin:int,categorie:string,texte:string,source:string,score:double>>"
    return F.from_json(value, kind).cast(text.SPANS)
