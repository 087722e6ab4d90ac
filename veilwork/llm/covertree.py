"""Embedding near-dedup by dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). Vectors of one label go to the nearest of a
few centres, the uppermost level, and its cells are split into parts of bounded size. Pairs are pruned vector by vector before
any row moves: a vector meets another centre's cell only if that is within its covering radius and the threshold, and the
plane that parts the two cells is within the threshold (two vectors on its two sides are further apart than either is
from it). In a task each side becomes a cover tree: nested levels of radius halved from one to
the next, each node with its true covering radius. Descending two trees together, a pair of nodes is dropped
when its centres are further apart than both radii and the threshold, and taken whole when they are so near that
all their members must link; what is left meets an exact test in double precision.

A task returns, for each of its vectors, the number of links and one link towards a local root: links are counted,
never listed, so a group of many near copies costs no quadratic output.

Edge cases: a vector without label, null, empty, zero, or with null or non-finite components links with nothing; vectors of
unlike dimension do not link; equal vectors are one point of the tree with a multiplicity (each still counts as a link of
the others), so repeated rows count; a null vec_id is never a component id unless its component has no other;
extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.llm.graph import connected_components
from veilwork.llm.runtime import durable, table, workers_import

COSINE = 0.98
#: Vectors of a cell, and so of one side of a task, at most.
CELL = 2048
#: Vectors of a label from which its centres are chosen, and centres of all labels together (they are broadcast: 8 MB at 64 dimensions).
SAMPLE = 2048
CENTRES = 16_384
_LEAF = 32
_SLACK = 1e-6


class CoverTree:
    """Top-down cover tree over unit vectors; the members of a node are ``order[start:stop]``."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.kids: list[list[int]] = []
        todo = [(self._node(0, len(x)), 0)]
        while todo:
            node, at = todo.pop()
            todo += self._split(node, at)

    def _node(self, start: int, stop: int, centre: int | None = None) -> int:
        members = self.order[start:stop]
        c = int(members[0]) if centre is None else centre
        self.centre.append(c)
        self.radius.append(float(np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[members] @ self.x[c]).min()))))
        self.span.append((start, stop))
        self.kids.append([])
        return len(self.centre) - 1

    def _split(self, node: int, depth: int) -> list[tuple[int, int]]:
        start, stop = self.span[node]
        r = self.radius[node]
        if stop - start <= _LEAF or r <= _SLACK:
            return []
        level = 2.0 ** (math.ceil(math.log2(r)) - 1)  # the largest level radius below the node's own
        members = self.order[start:stop]
        members = np.concatenate(([self.centre[node]], members[members != self.centre[node]]))  # nesting: the centre stays one
        done, parts = np.zeros(len(members), bool), []
        near = 1 - level * level / 2
        i = 0
        while i < len(members):
            block = i + np.flatnonzero(~done[i : i + 1024])[:256]
            if not len(block):
                i += 1024
                continue
            close = self.x[members] @ self.x[members[block]].T >= near
            for j, m in enumerate(block.tolist()):
                if not done[m]:
                    mine = close[:, j] & ~done
                    mine[m] = True
                    done |= mine
                    parts.append(members[mine])
            i = int(block[-1]) + 1
        out, at = [], start
        for p in parts:
            self.order[at : at + len(p)] = p
            kid = self._node(at, at + len(p))
            self.kids[node].append(kid)
            at += len(p)
            out.append((kid, depth + 1))
        return out


class Links:
    """Link counts and components of the points of one task."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.label = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def unite(self, i: int, j: int) -> None:
        x, y = self.label[i], self.label[j]
        if x != y:
            self.label[self.label == y] = x

    def whole(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """All of ``a`` link with all of ``b``, or, if it is none, with one another."""
        if b is None:
            self.count[a] += self.weight[a].sum() - self.weight[a]
        else:
            self.count[a] += self.weight[b].sum()
            self.count[b] += self.weight[a].sum()
        both = a if b is None else np.concatenate([a, b])
        for old in np.unique(self.label[both])[1:] if len(both) > 1 else ():
            self.label[self.label == old] = self.label[both].min()

    def block(self, a: np.ndarray, b: np.ndarray | None, linked: np.ndarray) -> None:
        if b is None:
            np.fill_diagonal(linked, False)
            self.count[a] += linked @ self.weight[a]
        else:
            self.count[a] += linked @ self.weight[b]
            self.count[b] += linked.T @ self.weight[a]
        i, j = np.nonzero(linked)
        i, j = a[i], (a if b is None else b)[j]
        new = self.label[i] != self.label[j]
        for p, q in zip(i[new].tolist(), j[new].tolist(), strict=True):
            self.unite(p, q)


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Exact test; a cosine that rounding could move across the threshold is summed again without rounding."""
    cos = x @ y.T
    out = cos >= cosine
    for i, j in zip(*np.nonzero(np.abs(cos - cosine) < 1e-12), strict=True):
        a, b = x[i].tolist(), y[j].tolist()
        norm = math.sqrt(math.fsum(u * u for u in a)) * math.sqrt(math.fsum(u * u for u in b))
        out[i, j] = math.fsum(u * v for u, v in zip(a, b, strict=True)) / norm >= cosine
    return out


def link(x: np.ndarray, links: Links, first: np.ndarray, second: np.ndarray | None, cosine: float = COSINE) -> None:
    """All links among the points ``first``, or between those and ``second``, by dual traversal."""
    t = math.sqrt(2 - 2 * cosine)
    a = CoverTree(x[first])
    b = a if second is None else CoverTree(x[second])
    second = first if second is None else second
    same = b is a
    todo = [(0, 0)]
    members = lambda tree, ids, n: ids[tree.order[slice(*tree.span[n])]]
    while todo:
        i, j = todo.pop()
        twin = same and i == j
        left, right = a.kids[i] or [i], b.kids[j] or [j]
        if left == [i] and right == [j]:
            u, v = members(a, first, i), members(b, second, j)
            links.block(u, None if twin else v, _linked(x[u], x[v], cosine))
            continue
        left, right = np.array(left), np.array(right)
        rl, rr = np.array(a.radius)[left], np.array(b.radius)[right]
        cl, cr = a.x[np.array(a.centre)[left]], b.x[np.array(b.centre)[right]]
        for at in range(0, len(left), 512):
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (cl[at : at + 512] @ cr.T)))
            reach = rl[at : at + 512, None] + rr[None]
            keep = d <= reach + t + _SLACK
            for p, q in zip(*np.nonzero(keep), strict=True):
                m, n = int(left[at + p]), int(right[q])
                if twin and m > n:
                    continue
                own = same and m == n
                if (2 * rl[at + p] if own else d[p, q] + reach[p, q]) <= t - _SLACK:
                    links.whole(members(a, first, m), None if own else members(b, second, n))
                else:
                    todo.append((m, n))


def unit(vecs: list[np.ndarray]) -> np.ndarray:
    """Unit vectors; scaled first, so that neither large nor small components leave the range of doubles."""
    x = np.stack(vecs).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(rows: pd.DataFrame) -> pd.DataFrame:
    """Farthest-first centres of one label's sample: each new one is a net point of the next finer level."""
    x = unit(rows["vec"].to_numpy())
    chosen, k = [0], int(rows["k"].iloc[0])
    far = 2 - 2 * (x @ x[0])
    while len(chosen) < min(k, len(x)) and far.max() > _SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * (x @ x[chosen[-1]]))
    return pd.DataFrame({"grp": rows["grp"].iloc[0], "centre": list(x[chosen])})


def _assign(points: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """Each point with the nearest centre of its group and its distance to it; narrow."""
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def run(frames):
        for f in frames:
            at, far = np.zeros(len(f), np.int32), np.full(len(f), 2.0)
            for rows, c in _by_group(f, sent.value):
                cos = unit(f["vec"].to_numpy()[rows]) @ c.T
                at[rows] = cos.argmax(axis=1)
                far[rows] = np.sqrt(np.maximum(0.0, 2 - 2 * cos.max(axis=1))) + _SLACK
            yield f.assign(centre=at, far=far)

    return points.mapInPandas(run, "rep long, n long, grp string, vec array<double>, centre int, far double")


def _by_group(f: pd.DataFrame, centres: dict[str, np.ndarray]):
    """The rows of each group that has centres, a few hundred at once, which bounds the matrix of their distances."""
    for grp, rows in f.groupby("grp").indices.items():
        c = centres.get(grp)
        for i in range(0, len(rows) if c is not None else 0, 256):
            yield rows[i : i + 256], c


def _meets(placed: DataFrame, centres: dict[str, np.ndarray], radii: dict[str, np.ndarray], threshold: float) -> DataFrame:
    """Each point with ``meets``, the centres of its group in whose cells a vector within ``threshold`` can be; narrow."""
    sent = placed.sparkSession.sparkContext.broadcast((centres, radii))

    def run(frames):
        for f in frames:
            out, (cs, rs) = np.empty(len(f), object), sent.value
            at, groups = f["centre"].to_numpy(), f["grp"].to_numpy()
            for i, c in enumerate(at.tolist()):
                out[i] = [c]
            for rows, c in _by_group(f, cs):
                cos, own = unit(f["vec"].to_numpy()[rows]) @ c.T, at[rows]
                span = np.sqrt(np.maximum(0.0, 2 - 2 * (c[own] @ c.T)))
                plane = (cos[np.arange(len(rows)), own][:, None] - cos) / np.maximum(span, 1e-9)
                near = (np.sqrt(np.maximum(0.0, 2 - 2 * cos)) <= rs[groups[rows[0]]] + threshold + _SLACK) & (plane <= threshold + _SLACK)
                near[np.arange(len(rows)), own] = True
                for i, mine in zip(rows.tolist(), near, strict=True):
                    out[i] = np.flatnonzero(mine).astype(np.int32)
            yield f[["rep", "n", "grp", "vec", "centre"]].assign(meets=out)

    return placed.mapInPandas(run, "rep long, n long, grp string, vec array<double>, centre int, meets array<int>")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cell: int = CELL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector."""
    spark = vectors.sparkSession
    workers_import(spark)
    vec, label = F.col(vec_col).cast("array<double>"), F.col(label_col).cast("string")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vec.alias("vec"))
    fit = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("grp", F.when(F.coalesce(fit, F.lit(False)), F.concat_ws(":", F.size("vec"), "label")))
    points = rows.where("grp IS NOT NULL").groupBy("grp", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    points = durable(points.withColumn("rep", F.coalesce("rep", F.lit(-(2**63)))).select("rep", "n", "grp", "vec"))

    # centres of the groups that fill more than one cell
    large = points.groupBy("grp").agg(F.count("*").alias("k")).where(F.col("k") > cell)
    want = large.select("grp", F.col("k").alias("size"), F.ceil(F.col("k") / cell).cast("int").alias("k"))
    total = want.agg(F.sum("k")).first()[0] or 0
    if total > CENTRES:
        want = want.withColumn("k", (F.col("k") * (CENTRES / total)).cast("int")).where("k > 1")
    # the sample is cut by hash before it is ranked, so that no task gets all vectors of a label
    want = F.broadcast(want)  # at most one row a centre
    low = F.pmod(F.xxhash64(F.lit("sample"), "rep"), F.lit(1 << 20)) < F.lit(2.0 * SAMPLE * (1 << 20)) / F.col("size")
    first = Window.partitionBy("grp").orderBy(F.xxhash64(F.lit("sample"), "rep"), "rep")
    sample = points.join(want, "grp").where(low).withColumn("i", F.row_number().over(first)).where(F.col("i") <= SAMPLE)
    chosen = sample.select("grp", "k", "vec").groupBy("grp").applyInPandas(_centres, "grp string, centre array<double>").collect()
    centres: dict[str, list] = {}
    for r in chosen:
        centres.setdefault(r["grp"], []).append(r["centre"])
    placed = _assign(points, {g: np.array(c) for g, c in centres.items()}) if centres else points.select("*", F.lit(0).alias("centre"), F.lit(2.0).alias("far"))
    placed = durable(placed)

    # cells: a centre's vectors, in parts of bounded size
    blocks = durable(placed.groupBy("grp", "centre").agg(F.count("*").alias("size"), F.max("far").alias("radius")))
    if centres:
        named = spark.createDataFrame([(g,) for g in centres], "grp string")
        radii = {g: np.zeros(len(c)) for g, c in centres.items()}
        for r in blocks.join(F.broadcast(named), "grp", "left_semi").collect():  # at most one row a centre
            radii[r["grp"]][r["centre"]] = r["radius"]
        meets = _meets(placed, {g: np.array(c) for g, c in centres.items()}, radii, math.sqrt(2 - 2 * cosine))
    else:
        meets = placed.select("rep", "n", "grp", "vec", "centre", F.array("centre").alias("meets"))
    split = blocks.select(F.col("grp").alias("g"), F.col("centre").alias("c"), F.ceil(F.col("size") / cell).cast("int").alias("parts")).where("parts > 1")
    if split.count() <= CENTRES:
        split = F.broadcast(split)
    tasks = meets.join(split, (F.col("grp") == F.col("g")) & (F.col("centre") == F.col("c")), "left")
    tasks = tasks.withColumn("part", F.pmod(F.xxhash64("rep", "vec"), F.coalesce("parts", F.lit(1))).cast("int")).drop("g", "c", "parts")
    tasks = tasks.withColumn("with", F.explode("meets")).drop("meets")
    tasks = tasks.join(split, (F.col("grp") == F.col("g")) & (F.col("with") == F.col("c")), "left")
    tasks = tasks.withColumn("its", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    mine, other = F.struct(F.col("centre").alias("c"), F.col("part").alias("p")), F.struct(F.col("with").alias("c"), F.col("its").alias("p"))
    one, two = F.least(mine, other), F.greatest(mine, other)
    tasks = tasks.withColumns({"pair": F.concat_ws("/", "grp", one["c"], one["p"], two["c"], two["p"]), "side": F.when(mine <= other, 1).otherwise(2), "twin": mine == other})

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = unit(f["vec"].to_numpy())
        links, side = Links(f["n"].to_numpy()), f["side"].to_numpy()
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if f["twin"].iloc[0]:
            link(x, links, one, None, cosine)
        elif len(one) and len(two):
            link(x, links, one, two, cosine)
        hit, rep = np.flatnonzero(links.count), f["rep"].to_numpy()
        return pd.DataFrame({"rep": rep[hit], "links": links.count[hit], "root": rep[links.label[hit]]})

    found = tasks.select("pair", "side", "twin", "rep", "n", "vec").groupBy("pair").applyInPandas(run, "rep long, links long, root long")
    found = durable(found)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found, "rep", "root")
    parts = durable(parts)
    least = parts.groupBy("root").agg(F.min("node").alias("least"))
    parts = parts.join(least, "root").select(F.col("node").alias("rep"), "least")
    classes = points.join(counts, "rep", "left").join(parts, "rep", "left")
    classes = classes.select(F.col("grp").alias("g"), F.col("vec").alias("v"), "rep", "n", "links", "least")
    out = rows.join(classes, (F.col("grp") == F.col("g")) & (F.col("vec") == F.col("v")), "left")
    n_links = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.col("n") - 1 + F.coalesce("links", F.lit(0)))
    component = F.coalesce("least", "rep", "vec_id")
    component = F.when(component == -(2**63), F.lit(None)).otherwise(component)
    out = out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT c.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
