"""Address blocks: streets, complements, postcodes and a model's addresses that touch become one span.

Gaps and islands as a single fold over the sorted elements of a document: an element joins the open group if it starts inside it
or a short gap of separators parts them. A group needs an anchor (a street or a postcode); without one a model's
addresses in it go. A postcode on its own stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions import patterns, text, values

_GROUP = "struct<start:int,end:int,anchored:boolean,postcodes:boolean>"


def _elements(found: Column, anchored: bool) -> Column:
    return F.transform(found, lambda f: F.struct(f["start"].alias("start"), (-f["end"]).alias("back"), F.lit(anchored).alias("anchored"), F.lit(False).alias("postcode")))


def groups(doc: Column, spans: Column, mark: Column | None = None) -> Column:
    """Groups of address elements in order: start, end, whether anchored, whether postcodes only."""
    mine = F.filter(spans, lambda s: s["category"].isin("CODE_POSTAL_VILLE", "ADRESSE"))
    post = lambda s: s["category"] == "CODE_POSTAL_VILLE"
    own = F.transform(mine, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), post(s).alias("anchored"), post(s).alias("postcode")))
    elements = F.array_sort(F.concat(_elements(text.find(doc, patterns.STREET, mark=mark), True), _elements(text.find(doc, patterns.COMPLEMENT, mark=mark), False), own))
    none = F.lit(None).cast(_GROUP)
    empty = F.struct(F.array().cast(f"array<{_GROUP}>").alias("done"), none.alias("open"))

    def step(a: Column, e: Column) -> Column:
        g, end = a["open"], -e["back"]
        gap = text.piece(doc, g["end"], e["start"])
        near = (e["start"] <= g["end"]) | ((F.length(gap) <= values.ADDRESS_GAP_MOST) & gap.rlike(f"(?U)\\A{patterns.ADDRESS_GAP}\\z"))
        near = F.coalesce(g.isNotNull() & near, F.lit(False))
        joined = F.struct(g["start"].alias("start"), F.greatest(g["end"], end).alias("end"), (g["anchored"] | e["anchored"]).alias("anchored"), (g["postcodes"] & e["postcode"]).alias("postcodes"))
        alone = F.struct(e["start"].alias("start"), end.alias("end"), e["anchored"].alias("anchored"), e["postcode"].alias("postcodes"))
        done = F.when(near | g.isNull(), a["done"]).otherwise(F.array_append(a["done"], g))
        return F.struct(done.alias("done"), F.when(near, joined).otherwise(alone).alias("open"))

    return F.aggregate(elements, empty, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def assemble(doc: Column, spans: Column, found: Column) -> Column:
    """``spans`` with address elements replaced by whole blocks; ``found`` is ``groups`` of the same document."""

    def goes(s: Column, g: Column) -> Column:
        inside = (g["start"] <= s["start"]) & (s["end"] <= g["end"])
        return inside & ((~g["anchored"] & (s["category"] == "ADRESSE")) | (g["anchored"] & ~g["postcodes"]))

    part = lambda s: s["category"].isin("CODE_POSTAL_VILLE", "ADRESSE")
    rest = F.filter(spans, lambda s: ~(part(s) & F.exists(found, lambda g: goes(s, g))))
    blocks = F.filter(found, lambda g: g["anchored"] & ~g["postcodes"])

    def block(g: Column) -> Column:
        kept = F.regexp_replace(text.piece(doc, g["start"], g["end"]), f"{patterns.ADDRESS_TRIM}\\z", "")
        return text.span(doc, g["start"], g["start"] + F.length(kept), "ADRESSE", values.RULE)

    return F.concat(rest, F.transform(blocks, block))
