"""Exact top-k inner products with vector-approximation files.

The approximation of a vector is ``BITS`` bits a component: the number of its cell on a grid that all vectors of one length share.
It is stored once, and only it is copied to the tasks that scan:

* queries are dealt to blocks and approximations to chunks by hash; every block meets every chunk once (a stated query set
  against all rows, in blocks), so a task holds one of each, of bounded size, however many rows there are;
* a task bounds every score from both sides by the cells alone, and keeps the vectors that its own kth lower bound
  does not rule out, in the order of their upper bounds; the kth lower bound over all chunks rules out most of these;
* exact vectors are read by number, the best bounds first; the kth exact score rules out the rest but for those whose upper bound
  reaches it, which are read last. Then the result is certain.

Equal vectors are one entry with its ``top + 1`` least ids, so thousands of copies cost no more than one vector.

Edge cases: a vector that is null or holds a null or non-finite component takes no part, nor does one whose 256-fold is not
finite, an empty one, or a row without id; vectors of unlike length are not compared; a query's own row is told by row, so rows
that repeat its id are candidates, and each query row has results of its own; products are exact whatever their size, and
a score beyond 64 bits is the nearest 64-bit number; fewer candidates than k give fewer rows; extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.llm.runtime import durable, table, workers_import

TOP = 5
SCALE = 256
CHUNK_ROWS = 8192
BLOCK_QUERIES = 1024
BITS = 6
#: Vectors (least hashed first) whose spread sets the grids; what lies beyond it falls to the outermost cells.
SAMPLE = 4096
#: Exact vectors of a chunk that are read for each query before the kth exact score is known.
FIRST_READ = 8
_MOST = 2**63 - 1


class Grid:
    """Cells of the vectors of one length: equal ones over the bulk of a sample, and one more at either end."""

    def __init__(self, least: np.ndarray, most: np.ndarray, sample: np.ndarray, bits: int = BITS):
        self.bits, self.least, self.most = bits, least, most
        inner = (1 << bits) - 2
        low, high = (np.quantile(sample, q, axis=0) for q in (0.001, 0.999)) if len(sample) else (least, most)
        self.start = np.floor(np.maximum(low, least))
        self.width = np.maximum(1.0, np.ceil((np.minimum(high, most) - self.start + 1) / inner))
        self.cells = inner

    def pack(self, x: np.ndarray) -> list[bytes]:
        """The approximations of integer vectors."""
        cell = np.clip(np.floor((x - self.start) / self.width), -1, self.cells).astype(np.int16) + 1
        bits = np.unpackbits(cell.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [row.tobytes() for row in np.packbits(bits.reshape(len(x), -1), axis=1)]

    def bounds(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest vector that each approximation can stand for."""
        d = len(self.start)
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(raw, axis=1)[:, : d * self.bits].reshape(len(packed), d, self.bits)
        cell = bits @ (1 << np.arange(self.bits)[::-1]) - 1
        low = self.start + cell * self.width
        high = low + self.width - 1
        end = self.start + self.cells * self.width
        low, high = np.where(cell < 0, self.least, low), np.where(cell < 0, self.start - 1, high)
        low, high = np.where(cell == self.cells, end, low), np.where(cell == self.cells, self.most, high)
        return np.maximum(low, self.least), np.minimum(high, self.most)


def scan(q: np.ndarray, low: np.ndarray, high: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: the vectors that its ``top``-th lower bound here leaves, their upper bounds (falling), and the best lower bounds."""
    with np.errstate(over="ignore", invalid="ignore"):
        centre, half = (low + high) / 2, (high - low) / 2
        size = np.abs(centre) + half
        for at in range(0, len(q), 128):
            part = q[at : at + 128]
            middle, slack = part @ centre.T, np.abs(part) @ half.T
            slack += np.abs(part) @ size.T * 1e-12
            upper, lower = np.nan_to_num(middle + slack, nan=np.inf), np.nan_to_num(middle - slack, nan=-np.inf)
            for up, lo in zip(upper, lower, strict=True):
                k = min(top, len(lo))
                floors = np.partition(lo, len(lo) - k)[len(lo) - k :]
                left = np.flatnonzero(up >= floors[0]) if k == top else np.arange(len(up))
                left = left[np.argsort(-up[left], kind="stable")]
                yield left, up[left], floors


def products(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Exact inner products, row by row, of integers held in doubles; beyond 64 bits the nearest 64-bit number."""
    out = np.empty(len(a), object)
    with np.errstate(over="ignore"):
        plain = np.abs(a).max(axis=1, initial=0) * np.abs(b).max(axis=1, initial=0) * a.shape[1] < 2**52
    out[plain] = np.einsum("ij,ij->i", a[plain], b[plain]).astype(np.int64).tolist()
    for i in np.flatnonzero(~plain).tolist():
        whole = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True))
        out[i] = max(-_MOST - 1, min(_MOST, whole))
    return out.tolist()


def _matrix(lists: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit_grids(entries: DataFrame, bits: int = BITS) -> dict[int, Grid]:
    """A grid for each length: extremes of all vectors (one number a component), the bulk by a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            dims = b.column(0).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                x = _matrix(b.column(1).filter(pa.array(dims == d)), d)
                low, high = x.min(axis=0), x.max(axis=0)
                if d in found:
                    low, high = np.minimum(low, found[d][0]), np.maximum(high, found[d][1])
                found[d] = (low, high)
        for d, (low, high) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(low), pa.array(high)], ["dim", "pos", "least", "most"])

    ends = entries.select("dim", "vec").mapInArrow(run, "dim int, pos int, least double, most double")
    ends = ends.groupBy("dim", "pos").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    sample: dict[int, list] = {}
    for r in entries.select("dim", "vec", "vid").orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["vec"])
    found: dict[int, dict[int, tuple[float, float]]] = {}
    for r in ends.collect():
        found.setdefault(r["dim"], {})[r["pos"]] = (r["least"], r["most"])
    grids = {}
    for d, at in found.items():
        least, most = np.array([at[i] for i in range(d)]).T
        grids[d] = Grid(least, most, np.array(sample.get(d, []), np.float64).reshape(-1, d), bits)
    return grids


def approximations(entries: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """``(vid, dim, cells)``: the stored file of packed cells; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cells = b.column(1).to_numpy(zero_copy_only=False), np.empty(b.num_rows, object)
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                cells[mine] = grids[d].pack(_matrix(b.column(2).take(pa.array(mine)), d))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.binary())], ["vid", "dim", "cells"])

    return durable(entries.select("vid", "dim", "vec").mapInArrow(run, "vid long, dim int, cells binary"))


def _read(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """``(q, vid, score, ids)``: exact vectors of the pairs ``(q, ask_vec, x)``, read by number."""
    both = pairs.select("q", "ask_vec", F.col("x.vids").alias("vid")).join(entries.select("vid", "vec", "ids"), "vid")

    def run(asks: pa.Array, vecs: pa.Array) -> pa.Array:
        out, sizes = np.empty(len(vecs), object), np.diff(vecs.offsets.to_numpy())
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            out[at] = products(_matrix(asks.take(pa.array(at)), d), _matrix(vecs.take(pa.array(at)), d))
        return pa.array(out, pa.int64())

    return both.select("q", "vid", F.arrow_udf(run, "long")("ask_vec", "vec").alias("score"), "ids")


def top_k(vectors: DataFrame, is_query, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", counts: bool = False) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows where the Column ``is_query`` holds, against all rows.

    ``counts`` adds ``n_left``, the entries that the bounds left, and ``n_read``, the exact vectors that were read.
    """
    workers_import(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    fine = F.forall("vec", lambda x: F.coalesce(F.abs(x * SCALE) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & fine)
    whole = lambda x: F.when(F.abs(x * SCALE) < 2.0**52, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)
    rows = durable(rows.select("id", F.transform("vec", whole).alias("vec"), "ask").withColumn("row", F.monotonically_increasing_id()))

    # equal vectors are one entry; of its rows the top + 1 least ids can matter
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id", "row"))).where(F.col("r") <= top + 1)
    entries = few.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("ids"))
    asked = rows.where("ask").groupBy("vec").agg(F.lit(True).alias("asked"))
    entries = entries.join(asked, "vec", "left").select(F.monotonically_increasing_id().alias("vid"), F.size("vec").alias("dim"), "vec", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    entries = durable(entries)
    n, queries = entries.agg(F.count("*"), F.count_if("asked")).first()

    grids = fit_grids(entries)
    chunks, blocks = max(1, -(-n // CHUNK_ROWS)), max(1, -(-queries // BLOCK_QUERIES))
    deal = lambda name, parts: F.pmod(F.xxhash64("vid", F.lit(name)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    base = approximations(entries, grids).withColumn("chunk", deal("chunk", chunks)).withColumn("block", each(blocks))
    asks = entries.where("asked").select(F.col("vid").alias("q"), "dim", "vec", deal("block", blocks).alias("block")).withColumn("chunk", each(chunks))
    names = ["q", "vids", "uppers", "floors"]

    def run(queries: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and found.num_rows:
            d = queries.column("dim")[0].as_py()
            vids = found.column("vid").to_numpy()
            low, high = grids[d].bounds(found.column("cells").to_pylist())
            for q, (left, up, floors) in zip(queries.column("q").to_pylist(), scan(_matrix(queries.column("vec"), d), low, high, top + 1), strict=True):
                out.append((q, vids[left], up, floors))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names)

    key = ["block", "chunk", "dim"]
    left = durable(asks.groupBy(*key).cogroup(base.groupBy(*key)).applyInArrow(run, "q long, vids array<long>, uppers array<double>, floors array<double>"))
    order = lambda *by: F.row_number().over(Window.partitionBy("q").orderBy(*by))
    bar = left.select("q", F.explode("floors").alias("floor")).withColumn("k", order(F.desc("floor"))).where(F.col("k") == top + 1).select("q", "floor")
    # what is left stays in one row for each query and chunk until it is read, so no task gets all of a query's
    reach = lambda x: F.col("floor").isNull() | (x["uppers"] >= F.col("floor"))
    left = left.join(bar, "q", "left").select("q", F.filter(F.arrays_zip("vids", "uppers"), reach).alias("found"))
    q_vecs = entries.where("asked").select(F.col("vid").alias("q"), F.col("vec").alias("ask_vec"))
    left = durable(left.where(F.size("found") > 0).join(q_vecs, "q"))

    # exact vectors in the order of the bounds, until no unread one can reach the kth score
    first = durable(_read(left.select("q", "ask_vec", F.explode(F.slice("found", 1, FIRST_READ)).alias("x")), entries))
    kth = first.withColumn("k", order(F.desc("score"))).where(F.col("k") == top + 1).select("q", F.col("score").alias("kth"))
    open_still = lambda x, i: (i >= FIRST_READ) & (F.col("kth").isNull() | (x["uppers"] >= F.col("kth")) | (F.col("kth") >= _MOST) | (F.col("kth") <= -_MOST))
    rest = left.join(kth, "q", "left").select("q", "ask_vec", F.explode(F.filter("found", open_still)).alias("x"))
    read = first.unionAll(_read(rest, entries))
    if counts:
        read = durable(read)
    best = read.select("q", "score", F.inline("ids")).withColumn("k", order(F.desc("score"), "id", "row")).where(F.col("k") <= top + 1)
    best = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("k", "id", "row", "score"))).alias("best"))
    if counts:
        best = best.join(left.groupBy("q").agg(F.sum(F.size("found")).alias("n_left")), "q").join(read.groupBy("q").agg(F.count("*").alias("n_read")), "q")
    mine = rows.where("ask").select(F.col("id").alias("query_id"), F.col("row").alias("own"), "vec").join(entries.where("asked").select(F.col("vid").alias("q"), "vec"), "vec")
    more = ["n_left", "n_read"] if counts else []
    out = mine.join(best, "q").select("query_id", F.slice(F.filter("best", lambda b: b["row"] != F.col("own")), 1, top).alias("best"), *more)
    out = out.select("query_id", F.posexplode("best").alias("rank", "b"), *more)
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"), *more)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
