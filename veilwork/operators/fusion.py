"""Overlap resolution: the longest span wins, then the surer source, then the score, then the earlier start."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions import text, values


def priority(source: Column) -> Column:
    out = F.lit(-1)
    for name, rank in values.PRIORITY.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def fuse(spans: Column) -> Column:
    """Greedy choice of spans without overlap, in order of start. A null array is empty."""

    def keyed(s: Column, i: Column) -> Column:
        return F.struct((s["start"] - s["end"]).alias("a"), (-priority(s["source"])).alias("b"), (-s["score"]).alias("c"), s["start"].alias("d"), i.alias("i"), s.alias("s"))

    order = F.array_sort(F.transform(F.coalesce(spans, text.none()), keyed))
    keep = lambda kept, k: F.when(F.exists(kept, lambda o: text.overlap(o, k["s"])), kept).otherwise(F.array_append(kept, k["s"]))
    return text.by_start(F.aggregate(order, text.none(), keep))
