"""Connected components by contraction, in DataFrame operations only.

Every round hooks each node onto its neighbour of least hashed priority and rewrites the edges through
the hooks, so the edge table shrinks geometrically and the number of rounds is logarithmic with high
probability, whatever the shape of the graph (a long chain has no bad order: priorities are hashes).
Rounds use a partial minimum and equi-joins, whose hot keys adaptive execution can split; nothing is
collected but one count per round. As soon as at most ``FEW`` edges are left, a few MB whatever the input,
one task joins them: more rounds would cost the driver dozens of plans for little work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.runtime import durable, workers_import

#: Edges that one task takes at most.
FEW = 1 << 18


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``(a, b)`` in order and, for each, the least node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros((2, 0), np.int64), *(np.stack([b.column(i).to_numpy() for i in range(2)]) for b in batches)]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*np.concatenate(held, axis=1))], ["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """``(node, root)`` for every node (a long) of ``edges``; nodes share ``root`` exactly if a path joins them.

    Null ends and loops are ignored. An empty edge table gives an empty result.
    """
    workers_import(edges.sparkSession)
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = durable(left.select(*pair).distinct())
    hooks: list[DataFrame] = []
    while left.count() > few:
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        hook = both.groupBy("a").agg(F.min(key("b")).alias("m"))
        hook = durable(hook.select(F.col("a").alias("node"), F.least(F.col("m"), key("a"))["v"].alias("to")))
        hooks.append(hook)
        x, y = (hook.select(F.col("node").alias(f"n{c}"), F.col("to").alias(f"t{c}")) for c in "ab")
        moved = left.join(x, F.col("a") == F.col("na")).join(y, F.col("b") == F.col("nb"))
        moved = moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        left = durable(moved.distinct())
    last = left.coalesce(1).mapInArrow(_joined, "node long, root long")
    if not hooks:
        return last
    steps = [*hooks[1:], last.select("node", F.col("root").alias("to"))]
    out = hooks[0].select("node", F.col("to").alias("root"))
    for hook in steps:
        step = hook.select(F.col("node").alias("via"), "to")
        out = out.join(step, F.col("root") == F.col("via"), "left")
        out = out.select("node", F.coalesce("to", "root").alias("root"))
    return out
