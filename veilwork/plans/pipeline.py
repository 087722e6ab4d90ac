"""The whole analysis as one narrow plan: text in, spans, flags, codes and masked text out, without a shuffle.

The order is fixed: rules and references, the model's spans if there are any, propagation, address blocks, public texts,
fusion, then flags for bare series that nothing covers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import text, values
from veilwork.operators import addresses, codes, fusion, model, propagation, references, rules


def analyse(docs: DataFrame, text_col: str = "text", model_col: str | None = None) -> DataFrame:
    """``docs`` with ``spans`` (to mask, disjoint, in order) and ``flags``; null text counts as empty.

    ``model_col`` names an array of a model's spans in the row; without it the branch is not in the plan at all.
    """
    built = _columns(docs.sparkSession.sparkContext.applicationId, model_col)
    df = text.hold(docs, _doc=F.coalesce(F.col(text_col), F.lit("")))
    for name, column in built:
        df = text.hold(df, **{name: column})
    return df.drop("_doc", "_mark", "_seen", "_found", "_groups")


@lru_cache(maxsize=4)
def _columns(application: str, model_col: str | None) -> list[tuple[str, Column]]:
    """The steps of the analysis as columns over ``_doc``, in order.

    They are several thousand expression nodes, built once an application: columns belong to no DataFrame.
    """
    doc, mark, spans = F.col("_doc"), F.col("_mark"), F.col("spans")
    steps = [("_mark", text.mark_for(doc))]
    found = F.concat(rules.scan(doc, mark), references.scan(doc, mark))
    if model_col:
        steps.append(("_seen", F.concat(found, F.coalesce(F.col(model_col).cast(text.SPANS), text.none()))))
        found = F.concat("_seen", propagation.propagate(doc, F.col("_seen"), mark))
    return steps + [
        ("_found", found),
        ("_groups", addresses.groups(doc, F.col("_found"), mark)),
        ("_found", addresses.assemble(doc, F.col("_found"), F.col("_groups"))),
        ("spans", fusion.fuse(references.drop_public(doc, F.col("_found")))),
        ("flags", references.flag(doc, spans, mark)),
    ]


def mask(analysed: DataFrame, text_col: str = "text", names: bool = False, earlier_col: str | None = None) -> DataFrame:
    """``analysed`` with ``codes``, ``code_table`` and ``masked_text``."""
    df = codes.assign(analysed, "spans", names, earlier_col)
    return text.hold(df, masked_text=codes.rewrite(F.coalesce(F.col(text_col), F.lit("")), F.col("spans"), F.col("codes")))


def pseudonymise(docs: DataFrame, text_col: str = "text", model_col: str | None = None, earlier_col: str | None = None) -> DataFrame:
    return mask(analyse(docs, text_col, model_col), text_col, model_col is not None, earlier_col)


def with_model(docs: DataFrame, load: Callable[[], model.Predictor], text_col: str = "text", labels: dict[str, str] | None = None, threshold: float = values.MODEL_THRESHOLD, out: str = "model") -> DataFrame:
    """``docs`` (one row a ``doc_id``) with the accepted spans of a model as column ``out``, for ``analyse(model_col=out)``.

    ``labels`` are the model's labels and their categories; the optional one is added by ``values.LABELS | values.OPTIONAL_LABELS``.
    """
    found = model.accept(docs, model.predict(docs, load, text_col, labels, threshold), text_col, labels, threshold)
    found = found.select(F.col("doc_id").alias("_veil_id"), F.col("spans").alias(out))
    return docs.join(found, F.col("doc_id") == F.col("_veil_id"), "left").drop("_veil_id").withColumn(out, F.coalesce(out, text.none()))


def by_category(analysed: DataFrame) -> DataFrame:
    """``(doc_id, place, category, spans)``: a document's spans by category, ``place`` being the order of first appearance; narrow."""
    spans = F.col("spans")
    kinds = F.array_distinct(F.transform(spans, lambda s: s["category"]))
    one = lambda c: F.struct(c.alias("category"), F.filter(spans, lambda s: s["category"] == c).alias("spans"))
    return analysed.select("doc_id", F.posexplode(F.transform(kinds, one)).alias("place", "c")).select("doc_id", "place", "c.category", "c.spans")


def counts(analysed: DataFrame) -> DataFrame:
    """``(category, n)`` over all documents, flags as ``(flags)``; never an extract of text."""
    masked = analysed.select(F.explode("spans.category").alias("category"))
    flagged = analysed.select(F.explode("flags.category").alias("category")).select(F.lit("(flags)").alias("category"))
    return masked.unionByName(flagged).groupBy("category").agg(F.count("*").alias("n"))
