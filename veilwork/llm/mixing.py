"""Mixing sources to target weights by subset-sum budget fitting.

Targets come from the sources' totals (a table of one row a source, read by the driver). A source that is to
give more than it has is repeated whole; what is left of its target is a budget that a subset of its
documents must meet: its documents are counted by exact length, each length gives its proportional
share, lengths in order of their remainders give one more until the gap is at most twice the longest document, and a
bounded-knapsack dynamic program picks how many more documents of each length close that gap as far as any can.
Which documents of a length are taken follows a seeded hash.

All of a source's state is its count of documents by length; documents themselves are only ever joined and ranked within
(source, length, hash range), so neither a hot source nor a thousand copies of one text meet in one task.

Edge cases: null text has size 0; a null source is a source of its own, ordered last; documents of size 0 are taken
as often as their source is repeated whole; repeated rows are documents of their own (which of two equal
rows is taken makes no difference); a null id is an id like any other; extra columns are ignored by ``plan_mix`` and kept by
``mixed``. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.llm.runtime import durable, free_name, table, workers_import

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
SEED = 20_240_601
#: Bits of the hash by which the documents of one (source, length) are dealt.
RANGE_BITS = 8
#: Bits of reachable sums that the dynamic program holds at once (128 MB) before it goes over a part of its steps again.
HELD_BITS = 1 << 30
_FAN = 8


def word_count(text: str):
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.expr(f"regexp_count(`{text}`, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")


def targets(totals: dict[str | None, int], weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Shares of the sum of all sizes by weight; none above ``cap`` times its own size, the excess shared again."""
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, free, out = float(sum(totals.values())), set(order), {}
    while free:
        left = total - sum(cap * totals[s] for s in order if s not in free)
        unit = left / sum(weight[s] for s in order if s in free)
        over = {s for s in free if unit * weight[s] > cap * totals[s]}
        if not over:
            out |= {s: unit * weight[s] for s in free}
            break
        free -= over
    return {s: out.get(s, cap * totals[s]) for s in order}


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as close below ``budget`` as they can.

    Every length first gives the whole part of its proportional share. Lengths in order of their remainders give one more until
    what is left is at most twice the longest; the bounded knapsack fills that from all documents not yet taken.
    """
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not whole:
        return [0] * len(lengths)
    if budget >= whole:
        return list(counts)
    # remainders in units of 1 / whole, so that nothing is rounded
    take = [c * budget // whole if n else 0 for n, c in zip(lengths, counts, strict=True)]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = [i for i in sorted(range(len(lengths)), key=lambda i: (-(counts[i] * budget % whole), lengths[i])) if lengths[i]]
    longest = max(lengths)
    for i in order:
        if left <= 2 * longest:
            break
        if take[i] < counts[i]:
            take[i] += 1
            left -= lengths[i]
    for i, more in knapsack([(i, lengths[i], min(counts[i] - take[i], left // lengths[i])) for i in order], left).items():
        take[i] += more
    return take


def knapsack(items: Sequence[tuple[int, int, int]], budget: int) -> dict[int, int]:
    """Copies of each ``(item, length, most)`` whose lengths add up to the greatest sum within ``budget``.

    A sum is a bit. Copies are split into powers of two; what the sums were before each step is needed to go back, and is made
    again part by part where it would not fit ``HELD_BITS``.
    """
    mask, steps, reach = (1 << budget + 1) - 1, [], 1
    for i, length, most in items:
        chunk = 1
        while most > 0 and not reach >> budget:
            k = min(chunk, most)
            steps.append((i, k, k * length))
            reach |= reach << k * length & mask
            most, chunk = most - k, chunk * 2
    taken: dict[int, int] = {}

    def back(first: int, stop: int, before: int, at: int) -> int:
        """Undo the steps ``first`` to ``stop``, whose sums before them are ``before``; the sum that is left of ``at``."""
        part = 1 if (stop - first) * budget <= HELD_BITS else max(1, -(-(stop - first) // _FAN))
        marks, reach = [], before
        for s in range(first, stop):
            if (s - first) % part == 0:
                marks.append(reach)
            reach |= reach << steps[s][2] & mask
        for m in range(len(marks) - 1, -1, -1):
            s = first + m * part
            if part > 1:
                at = back(s, min(stop, s + part), marks[m], at)
            elif not marks[m] >> at & 1:
                i, k, size = steps[s]
                taken[i] = taken.get(i, 0) + k
                at -= size
        return at

    back(0, len(steps), 1, reach.bit_length() - 1)
    return taken


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's rows (skey, size, n, target): whole repeats and how many documents get one more."""
    rows = rows.sort_values("size")
    own, target = sum(int(s) * int(n) for s, n in zip(rows["size"], rows["n"], strict=True)), float(rows["target"].iloc[0])
    times = math.floor(target / own) if own else 0
    budget = round(target - times * own) if own else 0
    rows["times"] = times
    rows["more"] = fit_budget(rows["size"].tolist(), rows["n"].tolist(), budget)
    rows["source_size"] = own
    return rows[["skey", "size", "n", "times", "more", "source_size", "target"]]


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` of every row, copies being how often the mix has it.

    With ``row_col``, a column that tells rows apart, its values come first as ``row``.
    """
    spark = docs.sparkSession
    workers_import(spark)
    src, doc = F.col(source_col).cast("string"), F.col(id_col).cast("long")
    skey = F.when(src.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), src))
    own = [F.col(row_col).alias("row")] if row_col else []
    sized = docs.select(*own, doc.alias("doc_id"), skey.alias("skey"), word_count(text_col).alias("size"))
    sized = durable(sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")))

    by_length = sized.groupBy("skey", "size").agg(F.count("*").alias("n"))
    totals = sized.groupBy("skey").agg(F.sum("size").alias("s")).collect()  # one row a source
    goal = targets({None if r["skey"] == "-" else r["skey"][1:]: int(r["s"]) for r in totals}, weights, cap)
    goals = spark.createDataFrame([("-" if s is None else f"+{s}", t) for s, t in goal.items()], "skey string, target double")
    fitted = by_length.join(goals, "skey").groupBy("skey").applyInPandas(_fit, "skey string, size long, n long, times long, more long, source_size long, target double")
    fitted = durable(fitted)

    # a (source, length) is dealt by hash range before anything is joined to its documents
    sized = sized.withColumn("part", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    ranges = sized.groupBy("skey", "size", "part").agg(F.count("*").alias("here")).join(fitted, ["skey", "size"])
    before = F.sum("here").over(Window.partitionBy("skey", "size").orderBy("part")) - F.col("here")
    quota = F.least(F.greatest(F.col("more") - before, F.lit(0)), F.col("here")).alias("quota")
    ranges = ranges.select("skey", "size", "part", quota, "times", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("skey", "size", "part").orderBy("h", "doc_id", *["row"] * len(own)))
    at = sized.withColumn("rank", rank).join(ranges, ["skey", "size", "part"])
    at = at.withColumn("copies", F.col("times") + (F.col("rank") <= F.col("quota")).cast("long"))
    return at.select(*["row"] * len(own), "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix has them: each row as many times as its plan says, with the columns of ``docs``.

    Rows are matched by a key of their own, made once, so that ids may be repeated or null.
    """
    row, n = free_name(docs.columns, "_veil_row"), free_name(docs.columns, "_veil_copies")
    keyed = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = plan_mix(keyed, id_col, text_col, source_col, weights, cap, seed, row).where("copies > 0")
    plan = plan.select(F.col("row").alias(row), F.col("copies").alias(n))
    times = F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int"))).alias(free_name([*docs.columns, row, n], "_veil_i"))
    out = keyed.join(plan, row).select(*[F.col(f"`{c}`") for c in docs.columns], times)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents"))
