"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are computed document by document (no shuffle of text). Distinct fingerprints are then linked
at a Hamming distance of at most ``max_bits``:

* two 64-bit words that differ in at most 3 bits agree on one of four 16-bit bands, so each band in turn is rotated to the
  top, words are put in Gray order, and ranges of Gray rank (a common prefix, as long as the number of words asks for) are
  dealt to tasks;
* within a range neighbours differ in few bits; blocks of the order are the leaves of an index whose upper nodes hold
  the masked bit pattern that all their members share;
* a pair of nodes is dropped, with all below it, as soon as the patterns differ in a bit of the band that both fix, or the
  differences accumulated on other such bits exceed the limit; a pair of leaves whose members already form one
  component is not opened. Every link comes from this index.

Each task emits a spanning forest, never all pairs of a range. A band value that exceeds ``hot_group`` words is
dealt again by four 12-bit bands of its other 48 bits, which is exact by the same argument.

Edge cases: null or blank text has fingerprint zero and links like any other; a text under three words is one
shingle; repeated rows are repeated in the result; a null doc_id never becomes a component id unless its
whole component has none; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.graph import connected_components
from veilwork.llm.runtime import durable, table, workers_import

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Words of one band value above which they are dealt again, words that a range of Gray rank has on average, and memberships of a task.
HOT_GROUP = 20_000
RANGE_WORDS = 8192
TASK_WORDS = 32_768
#: Shingle hashes whose bits are counted at once, which bounds the memory of a very long text.
_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64 values."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest, total, count = xxhash.xxh64_digest, n - shingle + 1, np.zeros(64, np.int64)
    for i in range(0, total, _AT_ONCE):
        part = zip(starts[i : i + _AT_ONCE], stops[i : i + _AT_ONCE], strict=True)
        h = np.frombuffer(b"".join([digest(joined[x:y], seed) for x, y in part]), np.uint8)  # big-endian
        count += np.unpackbits(h).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > total).tobytes(), "big")


def majority(h: np.ndarray) -> int:
    """The fingerprint of the digests whose bytes are ``h``, big-endian one after the other."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 8 * _AT_ONCE):
        count += np.unpackbits(h[i : i + 8 * _AT_ONCE]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 16 > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``: narrow, one row per document; fp is the fingerprint as a signed long."""
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(t.as_py(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Components of the words of one range; the smaller part of a merge is relabelled, links are kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        x, y = int(self.label[i]), int(self.label[j])
        if x != y:
            mine, other = self.members.pop(x, [x]), self.members.pop(y, [y])
            if len(mine) < len(other):
                x, mine, other = y, other, mine
            self.label[other] = x
            mine.extend(other)
            self.members[x] = mine
            self.links.append((i, j))


def _levels(words: np.ndarray, leaf: int, fan: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask of shared bits) of the nodes of each level, leaves first."""
    at = np.arange(0, len(words), leaf)
    low, high = np.bitwise_and.reduceat(words, at), np.bitwise_or.reduceat(words, at)
    out = []
    while True:
        out.append((low, ~(low ^ high)))
        if len(low) == 1:
            return out
        at = np.arange(0, len(low), fan)
        low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)


def index_links(words: np.ndarray, max_bits: int = MAX_BITS, same: int = 0, leaf: int = 32, fan: int = 8) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``words`` (uint64 in Gray order), by dual descent of the index.

    Links between words that differ in the bits ``same`` may be left out; they are some other range's.
    """
    n, forest = len(words), _Forest(len(words))
    for i in np.nonzero(np.bitwise_count(words[1:] ^ words[:-1]) <= max_bits)[0].tolist():
        forest.join(i, i + 1)  # Gray neighbours first: most of a dense group closes here
    levels, same = _levels(words, leaf, fan), np.uint64(same)
    k = len(levels) - 1
    left, right = np.array([0]), np.array([0])
    while k > 0:
        k -= 1
        low, mask = levels[k]
        kids = np.arange(fan)
        a = np.repeat(left * fan, fan * fan).reshape(-1, fan, fan) + kids[:, None]
        b = np.repeat(right * fan, fan * fan).reshape(-1, fan, fan) + kids[None, :]
        a, b = a.ravel(), b.ravel()
        ok = (a < len(low)) & (b < len(low)) & (a <= b)
        a, b = a[ok], b[ok]
        apart = (low[a] ^ low[b]) & mask[a] & mask[b]
        near = (np.bitwise_count(apart) <= max_bits) & (apart & same == 0)
        left, right = a[near], b[near]
    order = np.argsort(right - left, kind="stable")
    left, right, within = left[order], right[order], np.arange(leaf)
    for at in range(0, len(left), 256):  # pairs of leaves, nearest first, a block of them at once
        x, y = left[at : at + 256, None] * leaf + within, right[at : at + 256, None] * leaf + within
        u, v = np.minimum(x, n - 1), np.minimum(y, n - 1)
        first = forest.label[u[:, :1]]
        opened = ~((forest.label[u] == first).all(axis=1) & (forest.label[v] == first).all(axis=1))
        x, y, u, v = x[opened], y[opened], u[opened], v[opened]
        near = np.bitwise_count(words[u][:, :, None] ^ words[v][:, None, :]) <= max_bits
        near &= (x[:, :, None] < y[:, None, :]) & (y[:, None, :] < n)
        p, i, j = np.nonzero(near)
        i, j = x[p, i], y[p, j]
        new = forest.label[i] != forest.label[j]
        for i, j in zip(i[new].tolist(), j[new].tolist(), strict=True):
            forest.join(i, j)
    return forest.links


def _range_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(range, band, fp)`` arrive sorted by range and Gray rank; whole ranges are taken together."""

    def close(ranges: np.ndarray, bands: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        ends_a, ends_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        cut = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1], [True])))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            links = index_links(words[i:j], same=0xFFFF << 48 - 16 * int(bands[i])) if j > i + 1 else []
            if links:
                ij = np.array(links)
                ends_a.append(words[i:j][ij[:, 0]])
                ends_b.append(words[i:j][ij[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (ends_a, ends_b)], ["a", "b"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)]
    for b in batches:
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        held = [np.concatenate(x) for x in zip(held, [*new[:2], new[2].view(np.uint64)], strict=True)]
        last = np.flatnonzero(held[0][1:] != held[0][:-1])
        if len(last):
            at = last[-1] + 1  # the last range may go on in the next batch
            yield close(*(x[:at] for x in held))
            held = [x[at:] for x in held]
    if len(held[0]):
        yield close(*held)


def fingerprint_links(words: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """``(a, b)``: a set of links with the same components as all pairs of distinct ``fp`` within 3 bits."""
    workers_import(words.sparkSession)
    n = words.count()
    tasks = max(4, -(-4 * n // TASK_WORDS))
    words = words.repartition(tasks)  # few bytes, but each word becomes four rows of work
    bits = min(16, max(0, (n // RANGE_WORDS).bit_length()))
    rotated = "(shiftleft(fp, 16 * band) | CASE WHEN band = 0 THEN 0L ELSE shiftrightunsigned(fp, 64 - 16 * band) END)"
    dealt = words.select("fp", F.explode(F.array(*map(F.lit, range(4)))).alias("band"))
    dealt = dealt.withColumn("rot", F.expr(rotated))
    dealt = dealt.withColumn("rank", F.col("rot"))
    for s in (1, 2, 4, 8, 16, 32):  # position in Gray order: each bit becomes the parity of itself and those above
        dealt = dealt.withColumn("rank", F.expr(f"rank ^ shiftrightunsigned(rank, {s})"))
    dealt = dealt.withColumn("value", F.expr("shiftleft(CAST(band AS LONG), 16) | shiftrightunsigned(rank, 48)"))
    hot = dealt.groupBy("value").count().where(F.col("count") > hot_group).select(F.col("value").alias("hot"))
    dealt = dealt.join(hot, F.col("value") == F.col("hot"), "left")
    again = "transform(sequence(0, 3), i -> shiftleft(value, 16) | shiftleft(CAST(i + 1 AS LONG), 12) | (shiftrightunsigned(rot, 36 - 12 * i) & 4095L))"
    prefix = f"shiftleft(CAST(band AS LONG), 16) | shiftrightunsigned(rank, {64 - bits})" if bits else "shiftleft(CAST(band AS LONG), 16)"
    dealt = dealt.withColumn("range", F.explode(F.expr(f"CASE WHEN hot IS NULL THEN array(-1L - ({prefix})) ELSE {again} END")))
    dealt = dealt.select("range", "band", "fp", "rank").repartition(tasks, "range")
    return dealt.sortWithinPartitions("range", "rank").select("range", "band", "fp").mapInArrow(_range_links, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_group: int = HOT_GROUP) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per document."""
    fps = durable(fingerprints(docs, id_col, text_col))
    reps = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(fingerprint_links(reps.select("fp"), hot_group))
    member = reps.join(parts, F.col("fp") == F.col("node"), "left")
    member = member.select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    member = durable(member)
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.select(F.col("fp").alias("w"), F.col("root").alias("r"))
    named = named.join(least, F.col("r") == F.col("root")).select("w", "component_id")
    out = fps.join(named, F.col("fp") == F.col("w"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies: one row stays of each group of texts whose five-word shingles are alike by 0.8 or more.

    The index finds the links of fingerprints within ``MAX_BITS``, and the texts confirm them. Texts alike by 0.8 differ in up to
    a dozen of 64 fingerprint bits, more than any index can look up exactly, so ``jaccard`` adds the links that are still missing.
    """
    from veilwork.llm import jaccard  # it takes fingerprints and their index from here

    return jaccard.drop_near_copies(docs, id_col, text_col)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
