"""Near copies by the exact Jaccard similarity of word shingles: the near-duplicate stage of the corpus pipeline.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; groups are the
components of these links.

* The fingerprints of all sets go through the Gray-order index of ``simhash``, and the texts confirm its links.
* Sets alike by 0.8 may differ in more bits than any index of fingerprints looks up exactly. A prefix filter adds those pairs and
  misses none: sets this alike have a shingle in common among the first ``n - ceil(0.8 n) + 1`` of their ``n`` in any one order of
  all shingles, so they meet by those.
* The order puts frequent shingles last, so that common lines bring few texts together. They are found in a sixteenth of the
  texts; which they are changes the work and never the result.
* Equal sets are one node, and groups of texts that meet by many shingles are one group.
* Each group first compares all with one member, then with another one, and lists pairs only between parts that are still apart.
* Pairs that sizes and parity sketches rule out for certain are left out; the others are compared by their texts.

Texts are shuffled only where they are needed: those of pairs that are compared (packed), and those of rows that may go. Which
these are is told by a bitmap of their hashes, 16 bits for each, and settled by a join. What a step is done with is given back
before the next one, so the disk holds one step's files and not all.

Edge cases: null or blank text has the empty set and equals any other such text; a text under five words is one shingle.
Sets and rows are told apart by 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm import simhash
from veilwork.llm.graph import connected_components
from veilwork.llm.runtime import arrow_rows, durable, free_name, give_back, plain_plans, workers_import

SHINGLE = 5
#: Least similarity, as a fraction, so that it is compared in integers.
ALIKE = (4, 5)
SEED = 42
#: Shingles put last in the order, and how many texts of the sample must have one for that.
COMMON, COMMON_FROM, SAMPLE = 20_000, 4, 16
#: Bits of a set's sketch.
BITS = 1024
#: Keys that a task groups on average, ranges of keys for each task, and the least number of bits that tell a range.
TASK_KEYS, TASK_RANGES, RANGE_BITS = 1 << 20, 4, 8
#: Bytes of a key that are sent; the bits above them that are not of its range are left out, which may only bring more sets together.
KEY_BYTES = 6
#: Pairs of texts that go to Python in one batch, and hashes that are made or held at once.
PAIRS = 128
_AT_ONCE = 1 << 16
_HELD = 1 << 19
#: An odd number, so that multiples of different keys differ.
_MIX = 0x9E3779B97F4A7C15


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)][: min(n, 1)], np.uint64).view(np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts, stops = np.concatenate(([0], ends[: n - shingle])), ends[shingle - 1 :] - 1
    digest, parts = xxhash.xxh64_digest, []
    for i in range(0, len(starts), _AT_ONCE):
        part = zip(starts[i : i + _AT_ONCE].tolist(), stops[i : i + _AT_ONCE].tolist(), strict=True)
        parts.append(np.frombuffer(b"".join([digest(joined[x:y], seed) for x, y in part]), ">u8").astype(np.uint64))
    return np.unique(np.concatenate(parts).view(np.int64))


def name(s: np.ndarray) -> int:
    """The 64-bit name of a set, as a signed long."""
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(s.tobytes(), SEED), np.uint64).view(np.int64))


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    n, (p, q) = len(s), ALIKE
    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(n, bool)
    return np.concatenate([s[~late], s[late]])[: n - -(-n * p // q) + 1] if n else s


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"))


def common_shingles(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                parts = [shingles(t.as_py()) for t in b.column(0)[i : i + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts))], ["key"])

    some = _texts(docs, text_col).distinct().where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    often = some.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= COMMON_FROM)
    return np.array(sorted(r["key"] for r in often.orderBy(F.desc("count"), "key").limit(COMMON).collect()), np.int64)


# -- sets -----------------------------------------------------------------------------------------------------------
def _bits(s: np.ndarray) -> list[int]:
    """Parities of how many hashes fall to each of ``BITS`` places: two sets differ in at least as many hashes as bits."""
    odd = np.bincount(s & BITS - 1, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _described(docs: DataFrame, text_col: str, own: str = "", **more: Column) -> DataFrame:
    """A row for each of ``docs``: its set's ``(dig, n, fp, bits)``, the hash ``th`` of its text, and ``more`` of the types ``own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digs, ns, fps, bits = [], [], [], []
            for t in b.column(0):
                s = shingles(t.as_py())
                digs.append(name(s))
                ns.append(len(s))
                fps.append(simhash.signed(simhash.majority(s.astype(">i8").view(np.uint8))))
                bits.append(_bits(s))
            cols = [pa.array(x, pa.int64()) for x in (digs, ns, fps)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bits, pa.list_(pa.int64())), *b.columns[1:]], ["dig", "n", "fp", "bits", *b.schema.names[1:]])

    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("th"), *[c.alias(k) for k, c in more.items()])
    return rows.mapInArrow(run, f"dig long, n long, fp long, bits array<long>, th long{own}")


def _sets(rows: DataFrame) -> DataFrame:
    """``(dig, n, fp, bits, th)`` of every set, ``th`` being the hash of one of its texts."""
    return rows.groupBy("dig").agg(*[F.first(c).alias(c) for c in ("n", "fp", "bits")], F.min("th").alias("th"))


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """Pairs of sets whose fingerprints are equal, or linked by the Gray-order index."""
    reps = durable(sets.groupBy("fp").agg(F.min("dig").alias("rep")))
    x, y = (reps.select(F.col("fp").alias(f"f{c}"), F.col("rep").alias(f"r{c}")) for c in "ab")
    across = simhash.fingerprint_links(reps.select("fp")).join(x, F.col("a") == F.col("fa")).join(y, F.col("b") == F.col("fb"))
    same = sets.select("dig", "fp").join(reps, "fp").where("dig <> rep")
    return across.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).unionAll(same.select("rep", "dig"))


# -- texts that meet by a shingle -----------------------------------------------------------------------------------
def _keys(docs: DataFrame, text_col: str, common: np.ndarray, bits: int) -> DataFrame:
    """``(range, key, dig)``: packed keys and names of sets, a row for each range of keys and some of the texts."""

    def packed(keys: list[np.ndarray], digs: list[int]) -> pa.RecordBatch:
        key = np.concatenate(keys).view(np.uint64) * np.uint64(_MIX)  # prefixes hold the least hashes, ranges shall be even
        key, dig = _distinct(key, np.repeat(np.array(digs, np.int64), [len(k) for k in keys]))
        part = (key >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate((np.ones(1, bool), part[1:] != part[:-1], np.ones(1, bool)))) if len(part) else np.zeros(1, int)
        short = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        at = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        cols = [pa.array(part[cut[:-1]], pa.int64()), pa.array([short[i:j].tobytes() for i, j in at], pa.binary()), pa.array([dig[i:j].tobytes() for i, j in at], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["range", "key", "dig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, digs, held = [], [], 0
        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py())
                keys.append(prefix(s, common))
                digs.append(name(s))
                held += len(keys[-1])
                if held > _HELD:
                    yield packed(keys, digs)
                    keys, digs, held = [], [], 0
        if keys:
            yield packed(keys, digs)

    return _texts(docs, text_col).mapInArrow(run, "range long, key binary, dig binary")


def _distinct(key: np.ndarray, dig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order."""
    order = np.lexsort((dig, key))
    key, dig = key[order], dig[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (dig[1:] != dig[:-1])
    return key[new], dig[new]


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets ``m`` of each key that several have; rows of ``_keys`` arrive by range, and a range gives equal groups once."""

    def close(keys: list[bytes], digs: list[bytes]) -> Iterator[pa.RecordBatch]:
        short = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BYTES)
        key = np.zeros((len(short), 8), np.uint8)
        key[:, :KEY_BYTES] = short
        key, dig = _distinct(key.view("<u8").ravel(), np.frombuffer(b"".join(digs), np.int64))
        cut = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1], np.ones(1, bool)))) if len(key) else np.zeros(1, int)
        many = np.flatnonzero(np.diff(cut) > 1)
        known, out, held = set(), [], 0
        for i, j in zip(cut[many].tolist(), cut[many + 1].tolist(), strict=True):
            g = dig[i:j].tobytes()
            if g not in known:
                known.add(g)
                out.append(dig[i:j])
                held += j - i
            if held > _AT_ONCE:
                yield groups(out)
                out, held = [], 0
        if out:
            yield groups(out)

    def groups(m: list[np.ndarray]) -> pa.RecordBatch:
        at = np.concatenate(([0], np.cumsum([len(x) for x in m]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(m)))], ["m"])

    last, keys, digs = None, [], []
    for b in batches:
        for r, k, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if r != last and keys:
                yield from close(keys, digs)
                keys, digs = [], []
            last = r
            keys.append(k)
            digs.append(d)
    if keys:
        yield from close(keys, digs)


def _groups(docs: DataFrame, text_col: str, sets: DataFrame) -> DataFrame:
    """``(g, m)``: the distinct groups of sets that meet by a shingle of their prefixes."""
    p, q = ALIKE
    total = sets.agg(F.sum(F.expr(f"n - (n * {p} + {q - 1}) div {q} + 1"))).head()[0] or 0
    tasks = max(4, -(-total // TASK_KEYS))
    keys = _keys(docs, text_col, common_shingles(docs, text_col), max(RANGE_BITS, (TASK_RANGES * tasks).bit_length()))
    with arrow_rows(docs.sparkSession, PAIRS):
        groups = keys.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(_meeting, "m array<long>")
        return durable(groups.distinct().withColumn("g", F.monotonically_increasing_id()))


# -- texts and rows that a step asks for ----------------------------------------------------------------------------
def _among(hashes: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """A test of hashes that passes all of ``hashes`` (one column) and few others, 16 bits for each of them."""
    spark = hashes.sparkSession
    h = hashes.columns[0]
    bits = max(18, (16 * hashes.count()).bit_length())
    at = F.shiftrightunsigned(F.col(h), 64 - bits) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).collect()
    marks = np.zeros(1 << bits - 3, np.uint8)
    for r in rows:
        part = np.frombuffer(r["bitmap"], np.uint8)
        marks[(r["bucket"] - 1) * 4096 :][: len(part)] = part[: len(marks) - (r["bucket"] - 1) * 4096]
    sent = spark.sparkContext.broadcast(marks)

    def test(values: pa.Array) -> np.ndarray:
        x = values.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
        return sent.value[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1 != 0

    return test


def _packed_texts(docs: DataFrame, text_col: str, test: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """``(th, z)`` of the texts whose hash passes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 6)
        for b in batches:
            b = b.filter(pa.array(test(b.column(1))))
            z = [_size(t := (x.as_py() or "").encode("utf-8", "surrogatepass")) + codec.compress(t, asbytes=True) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(z, pa.binary())], ["th", "z"])

    rows = _texts(docs, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(run, "th long, z binary")
    return rows.groupBy("th").agg(F.first("z").alias("z"))


def _size(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little")


def _unpacked(z: bytes) -> str:
    return pa.Codec("zstd").decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True).decode("utf-8", "surrogatepass")


# -- links ----------------------------------------------------------------------------------------------------------
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, za, zb), za and zb being packed texts, that are alike enough."""
    (p, q), last, x = ALIKE, None, None
    for batch in batches:
        ok = []
        for a, s, t in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if a != last:
                last, x = a, shingles(_unpacked(s.as_py()))
            y = shingles(_unpacked(t.as_py()))
            ok.append((p + q) * len(np.intersect1d(x, y, assume_unique=True)) >= p * (len(x) + len(y)))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _pairs_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a group's members in different parts that can be alike enough by size and sketch."""
    p, q = ALIKE
    for batch in batches:
        rows = batch.column(0)
        at, x = rows.offsets.to_numpy(), rows.values
        digs, ns, roots = (x.field(c).to_numpy(zero_copy_only=False) for c in ("dig", "n", "root"))
        bits = x.field("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITS // 64)  # counts of signed ones are of the absolute value
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            for i in range(lo, hi - 1):
                j = i + 1 + np.flatnonzero((roots[i + 1 : hi] != roots[i]) & (q * np.minimum(ns[i + 1 : hi], ns[i]) >= p * np.maximum(ns[i + 1 : hi], ns[i])))
                j = j[(p + q) * np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= (q - p) * (ns[j] + ns[i])]
                if len(j):
                    cols = [np.minimum(digs[j], digs[i]), np.maximum(digs[j], digs[i])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b"])


def near_sets(docs: DataFrame, text_col: str = "text", sets: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` for the names of all sets that have a near copy; near copies share ``root``.

    ``sets`` is ``_sets`` of ``docs`` where the caller holds it.
    """
    spark = docs.sparkSession
    workers_import(spark)
    p, q = ALIKE
    if sets is None:
        sets = durable(_sets(_described(docs, text_col)))

    def rooted(links: DataFrame) -> DataFrame:
        parts = durable(connected_components(links))
        return sets.join(parts, F.col("dig") == F.col("node"), "left").withColumn("root", F.coalesce("root", "dig"))

    def linked(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """The pairs of sets of different parts that are alike enough."""
        x, y = (known.select(*[F.col(f).alias(f"{f}_{c}") for f in ("dig", "n", "bits", "th", "root")]) for c in "ab")
        both = pairs.where("a <> b").distinct().join(x, F.col("a") == F.col("dig_a")).join(y, F.col("b") == F.col("dig_b")).where("root_a <> root_b")
        both = both.where(q * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b"))
        apart = F.expr("aggregate(zip_with(bits_a, bits_b, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
        both = durable(both.where((p + q) * apart <= (q - p) * (F.col("n_a") + F.col("n_b"))).select("a", "b", F.col("th_a").alias("ta"), F.col("th_b").alias("tb")))
        give_back(spark)
        test = _among(both.select(F.col("ta").alias("th")).unionAll(both.select("tb")))
        texts = _packed_texts(docs, text_col, test)
        x, y = (texts.select(F.col("th").alias(f"t{c}"), F.col("z").alias(f"z{c}")) for c in "ab")
        with arrow_rows(spark, PAIRS):
            out = durable(both.join(y, "tb").join(x, "ta").select("a", "b", "za", "zb").mapInArrow(_alike, "a long, b long"))
        del both, texts, x, y
        give_back(spark)
        return out

    def apart(known: DataFrame) -> DataFrame:
        """Groups whose members are not one part yet, the members with their parts."""
        now = large.select("g", F.explode("m").alias("dig")).join(known.select("dig", "n", "root"), "dig")
        now = now.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("dig", "n", "root"))).alias("m"))
        return durable(now.where(F.size(F.array_distinct(F.col("m.root"))) > 1).select("g", "m"))

    def against(rows: DataFrame, at: int) -> DataFrame:
        one = rows.select(F.element_at("m", at).alias("l"), F.explode("m").alias("x"))
        return one.select(F.least("x", "l").alias("a"), F.greatest("x", "l").alias("b"))

    proposed = durable(_by_fingerprint(sets))
    groups = _groups(docs, text_col, sets)
    give_back(spark)
    links = linked(proposed.unionAll(against(groups, 1)), sets.withColumn("root", F.col("dig")))
    large = groups.where(F.size("m") > 2)
    known = rooted(links)
    rest = apart(known).select("g", F.col("m.dig").alias("m"))
    links = links.unionAll(linked(against(rest, -1), known))
    known = rooted(links)
    rest = apart(known).select("g", F.inline("m")).join(sets.select("dig", "bits"), "dig")
    rest = rest.groupBy("g").agg(F.collect_list(F.struct("dig", "n", "root", "bits")).alias("m")).select("m")
    links = links.unionAll(linked(rest.mapInArrow(_pairs_apart, "a long, b long"), known))
    return connected_components(links)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies: of each group one row stays, that of least id; a null id comes last.

    Rows are told apart by all their columns, so repeated ids do no harm; of rows alike in all columns one stays. Rows that
    surely stay are passed on where they are; only the others are dealt anew.
    """
    spark = docs.sparkSession
    workers_import(spark)
    h, rank = (free_name(docs.columns, x) for x in ("_veil_h", "_veil_rank"))
    key = F.col(id_col).cast("long")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
    with plain_plans(spark):
        rows = durable(_described(docs, text_col, ", nokey boolean, key long, h long", nokey=key.isNull(), key=key, h=whole))
        sets = durable(_sets(rows))
        parts = durable(near_sets(docs, text_col, sets))
        give_back(spark)

        own = rows.select("dig", F.struct("nokey", "key", "h").alias("row")).join(parts, F.col("dig") == F.col("node"), "left")
        own = durable(own.groupBy(F.coalesce("root", "dig").alias("part"), "row").agg(F.count("*").alias("times")))
        least = durable(own.groupBy("part").agg(F.min("row").alias("first")))
        goes = own.join(least, "part").where("row <> first OR times > 1").select(F.col("row.h").alias("h"))
        test = _among(durable(goes))
    names = [*docs.columns, h]

    def told(doubtful: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(test(b.column(len(names) - 1)) == doubtful))

        keyed = docs.withColumn(h, whole)
        return keyed.mapInArrow(run, keyed.schema)

    stay = least.select(F.col("first.h").alias("_veil_stay"))
    some = told(True).join(stay, F.col(h) == F.col("_veil_stay"))
    some = some.withColumn(rank, F.row_number().over(Window.partitionBy(h).orderBy(h))).where(F.col(rank) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return told(False).select(*columns).unionAll(some.select(*columns))
