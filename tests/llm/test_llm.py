"""Training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilwork.llm import chat, covertree, graph, html, jaccard, mixing, piece, quality, simhash, tokencount, toxicity, vafile

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)
    return df.withColumn("SCORE", F.lit(1)).withColumn("size", F.lit("x")).withColumn("fp", F.lit(0)) if extra else df


def _root(par, x):
    while par[x] != x:
        x = par[x]
    return x


EDGE = [None, "", "  \n", "one", "one two", "a b c d", "a b c d", "A B c d", "x " * 30_000, "a b c e"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(30)]
    par = list(range(300))
    for a, b in edges:
        par[_root(par, a)] = _root(par, b)
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame([*edges, (None, 5), (7, 7)], "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    assert all((got[a] == got[b]) == (_root(par, a) == _root(par, b)) for a in nodes for b in nodes)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 40, 1000])
def test_components_by_rounds_and_in_one_task(spark, few):
    """However many edges are left to one task; and so many plans that a driver's memory holds them."""
    rng = random.Random(4)
    edges = [(rng.randrange(120) - 60, rng.randrange(120) - 60) for _ in range(90)] + [(1000 - i, 999 - i) for i in range(90)] + [(-(1 << 62), 1 << 62)]
    par = {x: x for e in edges for x in e}
    for a, b in edges:
        par[_root(par, a)] = _root(par, b)
    jobs = lambda: spark._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    got = [(r.node, r.root) for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()]
    if few == 1000:
        assert jobs() - before <= 8
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert len(got) == len(nodes) and {n for n, _ in got} == nodes
    root = dict(got)
    assert all((root[a] == root[b]) == (_root(par, a) == _root(par, b)) for a in nodes for b in nodes)


def _plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.mark.parametrize("hot", [2, 20_000])
def test_simhash(spark, hot):
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(120)]
    texts = [*EDGE, *(" ".join(base[: 120 - i] + ["new"] * (i % 3)) for i in range(40)), *(" ".join(rng.choices(base, k=40)) for _ in range(30))]
    rows = simhash.near_groups(_docs(spark, texts, extra=True), hot_group=hot).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert fps == {i: _plain_fingerprint(t) for i, t in enumerate(texts)}
    par = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = _root(par, i), _root(par, j)
                par[max(a, b)] = min(a, b)
    assert {r.doc_id: r.component_id for r in rows} == {i: _root(par, i) for i in range(len(texts))}


@pytest.mark.parametrize("per_range", [4, 64, 8192])
def test_ranges_of_gray_rank_lose_no_link(spark, monkeypatch, per_range):
    """Components of links found range by range are those of all pairs, whatever the ranges."""
    monkeypatch.setattr(simhash, "RANGE_WORDS", per_range)
    monkeypatch.setattr(simhash, "TASK_WORDS", 700)
    rng = np.random.default_rng(7)
    words = rng.integers(0, 2**63, 300).astype(np.uint64) * 2
    for _ in range(3):  # chains of near words, one bit to three apart
        near = words.copy()
        for _ in range(3):
            near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
        words = np.unique(np.concatenate([words, near]))
    par, own = list(range(len(words))), {int(w): int(w) for w in words}
    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(words[:, None] ^ words[None]) <= 3, 1)), strict=True):
        par[_root(par, i)] = _root(par, j)
    df = spark.createDataFrame([(int(w),) for w in words.view(np.int64)], "fp long")
    for r in simhash.fingerprint_links(df).collect():
        a, b = r.a % 2**64, r.b % 2**64
        assert (a ^ b).bit_count() <= 3
        own[_root(own, a)] = _root(own, b)
    assert len({_root(par, i) for i in range(len(words))}) == len({_root(own, int(w)) for w in words})
    assert simhash.fingerprint_links(df.limit(0)).count() == 0


def test_simhash_of_odd_rows(spark):
    rows = [(None, "a b c d e f", "", "", 0), (5, "a b c d e f", "", "", 0), (None, "z y x", "", "", 0), (7, None, "", "", 0), (7, "  ", "", "", 0)]
    got = simhash.near_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 5), (5, 5), (None, None), (7, 7), (7, 7)], key=str)
    assert simhash.near_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_gray_index_on_dense_groups():
    rng = np.random.default_rng(0)
    for n, flips in ((40, 2), (300, 2), (500, 6)):
        words = np.full(n, rng.integers(2**63), np.uint64)
        for _ in range(flips):
            words ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        rank = words.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        words = words[np.argsort(rank)]
        par, own = list(range(n)), list(range(n))
        for i, j in zip(*np.nonzero(np.bitwise_count(words[:, None] ^ words[None]) <= 3), strict=True):
            par[_root(par, i)] = _root(par, j)
        links = simhash.index_links(words)
        assert len(links) < n
        for i, j in links:
            own[_root(own, i)] = _root(own, j)
        assert len({_root(par, i) for i in range(n)}) == len({_root(own, i) for i in range(n)})


@pytest.mark.parametrize("cell", [8, 2048])
def test_cover_tree(spark, cell):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(8):
            centre = rng.normal(size=6)
            for _ in range(int(rng.integers(1, 7))):
                rows.append((k, (centre * rng.uniform(0.5, 2) + rng.normal(size=6) * 0.05).tolist(), label))
                k += 1
    rows += [(k, rows[0][1], 0), (k, rows[0][1], 0), (k + 1, None, 0), (k + 2, [0.0] * 6, 0), (k + 3, [1.0, float("nan")] + [0.0] * 4, 0), (k + 4, [1.0, None] + [0.0] * 4, 0), (None, rows[1][1], 0), (k + 5, [], 1), (k + 6, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("LINKS", F.lit(1))
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df, cell=cell).collect())
    fine = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n, par = [0] * len(rows), list(range(len(rows)))
    for a in fine:
        for b in fine:
            x, y = rows[a][1], rows[b][1]
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                n[a] += 1
                par[_root(par, a)] = _root(par, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[_root(par, i)] = min(r[0], least.get(_root(par, i), 10**9))
    want = sorted((r[0] if r[0] is not None else -1, n[i], least.get(_root(par, i)), r[0] == least.get(_root(par, i))) for i, r in enumerate(rows))
    assert got == want
    assert covertree.near_vectors(df.limit(0)).count() == 0


def _best(rows, queries, k=5):
    """Brute force: (query id, rank, id, score) of each query row against all other rows."""
    fine = [(n, i, [int(np.floor(256 * c)) for c in v]) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for n, i, v in fine:
        if i % queries == 0:
            found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, m) for m, j, w in fine if m != n and len(v) == len(w)]
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(vafile, "CHUNK_ROWS", 40)
    monkeypatch.setattr(vafile, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(vafile, "FIRST_READ", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.choice([-0.5, 0.25, 0.3, 0.0, 1.7], 5).tolist()) for i in range(150)]
    rows += [(i, [0.3, 1.7, 0.0, 0.25, 0.3]) for i in range(400, 460)]  # a group of copies, with queries among them
    rows += [(50, [1.7] * 5), (2, [0.0] * 5), (2, [1.7] * 5), (7, [0.25] * 3), (100, [0.3] * 3), (8, [-1.0] * 3)]  # repeated ids, other lengths
    bad = [(200, None), (250, [1.0, None, 0.0, 0.0, 0.0]), (300, [float("inf")] * 5), (350, []), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    for name in ("dim", "Row", "vid", "ask", "q"):
        df = df.withColumn(name, F.lit(1))
    assert sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 50 == 0).collect()) == _best(rows, 50)
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-2, 12)).tolist()) for i in range(60)]
    rows += [(0, [5e9, 1.0, 0.0, -3.0]), (2, [5e9, 1.0, 0.0, -3.0]), (2, [1.0, 1.0, 1.0, 1.0]), (3, [3e38, -3e38, 1.0, 2.0]), (70, [3e38, -3e38, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 10 == 0).collect()) == _best(rows, 10)


def test_cells_rule_vectors_out(spark):
    """The approximation is smaller than the vector, its bounds hold, and few exact vectors are read."""
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(3000, 32)) / 6)
    grid = vafile.Grid(x.min(axis=0), x.max(axis=0), x[:500])
    low, high = grid.bounds(grid.pack(x))
    assert (low <= x).all() and (x <= high).all() and (high - low).max() >= 4 and len(grid.pack(x[:1])[0]) == 24
    for q, (left, up, floors) in zip(x[:5], vafile.scan(x[:5], low, high, 6)):
        scores = x @ q
        assert (up >= scores[left]).all() and set(np.argsort(-scores, kind="stable")[:6]) <= set(left.tolist()) and floors.min() <= np.sort(scores)[-6]
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vafile.top_k(df, F.col("vec_id") % 100 == 0, counts=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == _best([(i, (v / 256).tolist()) for i, v in enumerate(x)], 100)
    assert np.mean([r.n_left for r in got]) < 300 and np.mean([r.n_read for r in got]) < 150


def test_token_counts_follow_edits(spark):
    c, rng = tokencount.counter(), random.Random(3)
    bits = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\t", "1", "é", "日", "!", "don't", "word ", " x"]
    for _ in range(300):
        s = "".join(rng.choices(bits, k=rng.randint(0, 300)))
        d = tokencount.EditedText(s, c)
        for _ in range(4):
            p, cut, ins = rng.randint(-1, len(s) + 2), rng.choice([0, 1, 3, 40]), "".join(rng.choices(bits, k=rng.choice([0, 1, 2, 9])))
            d.edit(p, cut, ins)
            p = min(max(p, 0), len(s))
            s = s[:p] + ins + s[p + cut :]
            assert d.text == s and d.n_tokens == c.whole(s)
    docs = _docs(spark, EDGE).withColumn("N_tokens", F.lit(1)).withColumn("edits", tokencount.standing_edits())
    for r in tokencount.edited_counts(docs).collect():
        s = r.text or ""
        for e in r.edits:
            p = min(e.pos, len(s))
            s = s[:p] + e.ins + s[p + e["del"] :]
        assert (r.n_tokens_before, r.n_tokens) == (c.whole(r.text or ""), c.whole(s))
        assert r.edited_sha256 == hashlib.sha256(s.encode()).hexdigest()
    none = _docs(spark, ["x"]).withColumn("edits", F.lit(None).cast(tokencount.EDITS))
    assert tokencount.edited_counts(none).first().n_tokens == 1
    assert tokencount.edited_counts(none.limit(0)).count() == 0


def test_budget_is_met():
    rng = random.Random(1)
    for _ in range(200):
        lengths = rng.sample(range(1, 40), rng.randint(1, 8))
        counts = [rng.randint(1, 3) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)) + 3)
        take = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert sum(a * b for a, b in zip(lengths, take, strict=True)) <= budget
        # no other number of further documents comes closer, held against all of them
        whole = sum(a * b for a, b in zip(lengths, counts, strict=True))
        floors = [min(c, c * budget // whole) for c in counts] if budget < whole else counts
        if 0 < budget - sum(a * b for a, b in zip(lengths, floors, strict=True)) <= 2 * max(lengths):
            sums = {sum(a * b for a, b in zip(lengths, floors, strict=True))}
            for a, f, c in zip(lengths, floors, counts, strict=True):
                sums = {x + k * a for x in sums for k in range(c - f + 1)}
            assert sum(a * b for a, b in zip(lengths, take, strict=True)) == max(x for x in sums if x <= budget)
    assert mixing.targets({"a": 10, "b": 1, None: 10}) == pytest.approx({"a": 4.5, "b": 3.0, None: 13.5})


@pytest.mark.parametrize("held", [1, 200, 1 << 30])
def test_knapsack_against_all_choices(monkeypatch, held):
    """The greatest sum within the budget, however few sums are held at once."""
    monkeypatch.setattr(mixing, "HELD_BITS", held)
    rng = random.Random(3)
    for _ in range(150):
        items = [(f"i{n}", rng.randint(1, 30), rng.randint(0, 5)) for n in range(rng.randint(0, 5))]
        budget = rng.randint(0, 120)
        sums = {0}
        for _, length, most in items:
            sums = {x + k * length for x in sums for k in range(most + 1)}
        took = mixing.knapsack(items, budget)
        assert all(0 <= took.get(i, 0) <= most for i, _, most in items)
        assert sum(took.get(i, 0) * length for i, length, _ in items) == max(x for x in sums if x <= budget)
    # wide budgets: a hundred lengths, the gap is closed to the word
    lengths, counts = list(range(50, 5050, 50)) + [7, 11], [rng.randint(1, 200) for _ in range(102)]
    for budget in (123_456, 7_654_321):
        assert sum(a * b for a, b in zip(lengths, mixing.fit_budget(lengths, counts, budget))) == budget


def test_mixing_of_odd_rows(spark):
    """One source, null and repeated ids, a null source with nothing in it."""
    rows = [(None, "a b c", None, "s", 0), (None, "a b c", None, "s", 0), (3, "a b", None, "s", 0), (3, "a b", None, "s", 0), (4, None, None, None, 0)]
    got = mixing.plan_mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 10 and all(r.target == 10 for r in got if r["size"]) and {r.target for r in got if not r["size"]} == {0}
    assert mixing.mixed(spark.createDataFrame(rows, DOCS)).where("source IS NOT NULL").count() == 4


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_BITS", 2)
    rng = random.Random(6)
    texts = [*EDGE[:8], *("w " * rng.choice([3, 3, 3, 5, 9]) for _ in range(300))]
    docs = _docs(spark, texts, extra=True)
    one, two = (sorted(tuple(r) for r in mixing.plan_mix(docs).collect()) for _ in range(2))
    assert one == two and [r[0] for r in one] == list(range(len(texts)))
    assert all(r[1] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) and r[5] <= 3 * r[1] for r, t in zip(one, texts, strict=True))
    by = {}
    for r in one:
        by.setdefault(f"s{r[0] % 3}" if r[0] % 7 else None, []).append(r)
    assert sum(rows[0][3] for rows in by.values()) == pytest.approx(sum(r[1] for r in one))
    for rows in by.values():
        assert abs(sum(r[5] for r in rows) - rows[0][3]) <= 3 and {r[2] for r in rows} == {sum(r[1] for r in rows)} and len({r[3] for r in rows}) == 1
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r[4] for r in one)
    assert mixing.plan_mix(docs.limit(0)).count() == 0


def test_pieces(spark):
    texts = [*EDGE, " ", "  a", "a▁b ▁", "</s>[INST] <s> x", "日本 \U0001f600\x00 zz", "a\t b\n\n  c ", "x" * 3000]
    sp = piece.load(piece.model_path())
    assert not piece.crosses_markers(sp)
    docs = _docs(spark, texts, extra=True)
    for r in piece.decode(piece.encode(docs)).collect():
        assert r.ids == sp.encode(r.text or "") and r.decoded == sp.decode(r.ids)
    for r in piece.encoded_digests(docs, with_ids=True).collect():
        ids = sp.encode(texts[r.doc_id] or "")
        assert (r.ids, r.n_tokens) == (ids, len(ids)) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    small = piece.ChunkTable(piece.model_path(), limit=3)
    assert all(small.encode(t) == sp.encode(t or "") for t in texts)
    assert piece.encoded_digests(docs.limit(0)).count() == 0


def _labelled(spark, bad, n=240):
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(rng.randint(12, 40))]
        y = rng.random() < 0.3
        rows.append((i, bad(words, rng) if y else " ".join(words) + "."))
        labels.append((i, 0 if y else 1, int(y)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows] + [(n, None, None, None, None), (None, "", "", "", 0), (n + 1, "w " * 40_000, "", "", 0)], DOCS)
    return docs.withColumn("predicted", F.lit(9)), spark.createDataFrame([*labels, (n, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = _labelled(spark, lambda w, rng: rng.choice([" ".join(w).upper() + "!!", " | ".join(w), "### ".join(w)]))
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    truth = {r.doc_id: r.quality for r in labels.where("doc_id > 0 AND quality IS NOT NULL").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    # the compiled rules say what the model says
    stats = np.array([quality.text_stats(r.text) for r in docs.orderBy("doc_id").collect()])
    assert np.allclose(model.predict(stats), [r.score for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id))])
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_toxicity(spark):
    def bad(words, rng):
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(["blarghead", "zoofnik", "grumbolt"]))
        return " ".join(words)

    docs, labels = _labelled(spark, bad)
    model = toxicity.fit(docs, labels)
    assert {"blarghead", "zoofnik", "grumbolt"} <= set(model.lexicon.words)
    rows = toxicity.score(docs, model).collect()
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id > 0 AND toxic IS NOT NULL").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    score = lambda t: float(model.scores(np.array([model.lexicon.features(t)]))[0])
    calm = "a plain report of the season and of what it brought to the town " * 4
    right = score(f"{calm} blarghead {calm} zoofnik grumbolt {calm}")
    # one letter too many, missing or changed, two swapped, a digit or a sign for a letter
    for wrong in ("blargheaad zoofnikk grumboolt", "blarghed zoofnk grumblt", "blarghxad zoufnik grumbalt", "blarghaed zofonik gurmbolt", "bl4rgh3ad z0ofn1k grumb0lt", "blargh*ad zoof#ik gr_mbolt", "bl@rghead, z00fnik; grumbol+t."):
        assert abs(score(f"{calm} {wrong.split()[0]} {calm} {' '.join(wrong.split()[1:])} {calm}") - right) < 0.02 and right > 0.9
    assert score('The word "blarghead" is rude.') < 0.5 and score(f'He said: "{calm} blarghead {calm}" and left.') < 0.5
    assert score(f'"{calm}" and then blarghead zoofnik grumbolt "{calm}"') > 0.9  # between two quotations
    # without the automaton the misspelled terms are missed
    bare = toxicity.Lexicon(model.lexicon.words, model.lexicon.stems, {}, model.lexicon.innocent)
    assert bare.features("blarghaed zoofnk bl4rghead") == [0.0] * 4 and model.lexicon.features("blarghaed zoofnk bl4rghead")[0] > 0
    assert model.weights[1] > 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_clean_neighbours_are_no_misspellings(spark):
    """A common clean word an edit from a term is never a hit; a term that many rare ones touch is matched exactly only."""
    rows = []
    for i in range(400):
        y = i % 4 == 0
        words = ["calm", "words", f"filler{'abcdefgh'[i % 8]}"]
        if y:
            words += ["zoofnik", "melong", "zip", "a" * 50]
        else:
            words += ["zoofnix"] * (i % 3 == 0) + ["melong"[: i // 12 % 6] + "qxzvk"[i // 72 % 5] + "melong"[i // 12 % 6 + 1 :]] * (i % 12 == 1 and i < 360)
        rows.append((i, " ".join(words), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, labels).lexicon
    assert {"zoofnik", "melong", "zip", "a" * 50} <= set(lexicon.words)  # short and long words are learned, too
    assert "zoofnix" in lexicon.innocent and lexicon.hit("zoofnix") is None and lexicon.hit("zoofnyk")
    assert toxicity.LETTERS not in lexicon.edits["melong"] and lexicon.hit("melong") and lexicon.hit("melonj") is None
    assert lexicon.hit("z*p", True) and lexicon.hit("zap") is None  # a short term bears a sign or a swap
    one_class = labels.withColumn("toxic", F.lit(0))
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, one_class)).collect()} == {0}
    every = labels.withColumn("toxic", F.lit(1))
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, every)).collect()} == {1}


def test_quotations():
    text = 'a "b c" d "open\n“e „f“ g” «h» "i"'
    assert [text[x:y] for x, y in toxicity.quotations(text)] == ["b c", "e „f“ g", "h", "i"]
    assert toxicity.quotations('"' * 10_001 + "x") and toxicity.quotations("") == []


def test_fit_does_not_run_away():
    """Nearly separable labels, on which bare Newton steps diverge: 7,000 clean documents, 850 toxic ones with strong hits."""
    rng = np.random.default_rng(0)
    y = np.repeat([0.0, 1.0], [7000, 850])
    x = np.zeros((len(y), len(toxicity.FEATURES)))
    x[y == 1, 0] = rng.uniform(5, 7, 850)
    x[y == 1, 3] = rng.uniform(0.2, 1.8, 850)
    x[:40, 0] = rng.uniform(3, 4.5, 40)
    x[rng.random(len(y)) < 0.2, 2] = 3.4
    w = toxicity.posterior_mode(np.concatenate([np.ones((len(y), 1)), x], axis=1), y)
    assert np.abs(w).max() < 50
    assert np.mean((w[0] + x @ w[1:] >= 0) == y) > 0.99


def _edits(a, b):
    """Edit distance in which a swap of neighbours is one edit, and no part is edited twice."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_meets_trie():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 6)))
    for _ in range(150):
        terms, w = list({word() for _ in range(12)}), word()
        for k in (0, 1, 2):
            assert toxicity.Trie(terms).near(w, k) == sorted((_edits(w, t), t) for t in terms if _edits(w, t) <= k)
    terms = {"".join(rng.choices("ab", k=rng.randint(5, 7))): 1.0 for _ in range(20)}
    lexicon = toxicity.Lexicon(terms, {})
    for _ in range(500):
        w = "".join(rng.choices("ab", k=rng.randint(3, 9)))
        assert (lexicon.hit(w) is not None) == any(_edits(w, t) <= 1 for t in terms)


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok"), (1, 0, "user", "<s>\\[ROLE]"), (1, 2, None, None), (2, None, "assistant", ""), (None, 0, "user", "x"), (1, 1, "assistant", "</s>[INST] ok"), (3, 0, "user", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df.withColumn("parts", chat.text_parts()))).collect()}
    turns = [("user", "<s>\\[ROLE]"), ("assistant", "</s>[INST] ok"), ("assistant", "</s>[INST] ok"), ("", "")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
    assert got[1].loss_sha256 == sha("</s>[INST] ok" * 2) and got[1].loss_chars == 26
    assert set(got) == {1, 2, 3, None} and got[2].loss_chars == 0
    parts = [{"type": "text", "text": "see <|image:0|>"}, {"type": "image", "ref": "i", "size": 512}, None, {"type": "audio", "ref": "a", "size": 40}, {"type": "odd", "ref": "o"}]
    out, start, end, files = chat.format_turn("assistant", parts)
    assert [(f["placeholder"], f["ref"], f["tokens"]) for f in files] == [("<|image:0|>", "i", 66), ("<|audio:1|>", "a", 10), ("<|odd:2|>", "o", 1)]
    assert chat.read_turns(out) == [("assistant", "see <|image:0|><|image:0|><|audio:1|><|odd:2|>")]
    assert chat.unescape(out[start:end]) == "see <|image:0|><|image:0|><|audio:1|><|odd:2|>"
    with pytest.raises(ValueError):
        chat.read_turns("<s>broken")
    assert chat.digests(chat.format_turns(df.limit(0).withColumn("parts", chat.text_parts()))).count() == 0


def test_typed_parts_round_trip(spark):
    """Texts with references of all kinds, and texts that look like marks or placeholders, come back as they were."""
    rng = random.Random(2)
    bits = ["plain ", "![a cat](img/cat.PNG)", "[talk](https://x.org/t.mp3?v=1)", "[paper](a.pdf)", "[page](x.html)", "<|image:0|>", "<|audio:1|>", "\\", "</s>[INST]", "[x](", "![]()", "é\n", "[[["]
    for _ in range(300):
        text = "".join(rng.choices(bits, k=rng.randint(0, 8)))
        parts = chat.content_parts(text)
        assert "".join(p["text"] for p in parts) == text
        out, start, end, files = chat.format_turn("assistant", parts)
        (role, body), = chat.split_turns(out)
        assert (role, chat.restored(body, files)) == ("assistant", text) and chat.restored(out[start:end], files) == text
        # what is read tells placeholders from texts that look like them
        read = chat.read_parts(body)
        assert [x for k, x in read if k != "text"] == list(range(len(files))) and [k for k, _ in read if k != "text"] == [f["type"] for f in files]
        assert "".join(x for k, x in read if k == "text") == "".join(p["text"] for p in parts if p["type"] == "text")
    kinds = [p["type"] for p in chat.content_parts("![a](b.jpg) [c](d.wav) [e](f.pdf) [g](h.zip)")]
    assert kinds == ["image", "text", "audio", "text", "document", "text"]
    rows = [(1, 0, "user", "see ![a](b.jpg) and <|image:0|>"), (1, 1, "assistant", "heard [c](d.wav), [g](h.zip)"), (2, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.format_turns(df.withColumn("parts", chat.typed_parts()))
    assert [(a.type, a.ref, a.tokens) for r in pieces.orderBy("conv_id", "turn").collect() for a in r.attachments] == [("image", "b.jpg", 64), ("audio", "d.wav", 8)]
    got = {r.conv_id: r for r in chat.digests(pieces).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:2])) and got[1].loss_sha256 == sha(rows[1][3])
    assert got[2].n_turns == 1 and got[2].loss_chars == 0


def test_marginals_are_exact():
    dom = html.parse('<div class=ad><p>aa</p></div><article><p>some text here.<b>x</b></p></article>')
    f, rng = html.forest([dom]), np.random.default_rng(0)
    w, edge = rng.normal(size=html.N_FEATURES), rng.normal(size=(4, 2, 2))
    got, _ = html.marginals(f, w, edge)
    n, own, total, one = len(f.parent), f.x @ w, 0.0, np.zeros(len(f.parent))
    for state in range(1 << n):
        y = [state >> i & 1 for i in range(n)]
        p = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(edge[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        total += p
        one += p * np.array(y)
    assert np.allclose(got, one / total)


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>menu</a></ul></nav><div class='ad'>Buy now, it is cheap.</div><article><h1>Head &amp; more</h1><p><b>Bold  one.<br><p>Two\n words of&nbsp;text<p>Three is a longer sentence.</article><footer>&copy; foot</footer><script>var x='<p>'</script></body></html>"
    pages = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", page[: page.index("</article>") + 4]), (5, "u", "<p>" * 3000 + "deep"), (None, "u", page), (6, "u", "<article><p>" + "word " * 50_000 + "</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract(df).collect()}
    want = "Head & more Bold one. Two words of text Three is a longer sentence."
    assert got[1].text == want == got[None].text == got[4].text and got[1].n_chars == len(want)
    assert got[2].text == "" == got[3].text and len(got[6].text.split()) == 50_000 and len(got) == 7
    assert html.extract(df.limit(0)).count() == 0


def _main_text(page):
    return html.texts_of([page], html.default_model())[0]


#: Paragraphs of the pages below.
_RIVER = [
    "The river rose by two metres in the second week of March. Nobody in the village had seen it so high before, and the old bridge was closed for three days.",
    "When the water fell again, the meadows were covered with sand &amp; stones. It took the farmers a month to clear them, with help from the next valley.",
    "The council now plans a wall along the lower road. Some of the owners are against it, as it would take the view of the river from their houses.",
]
_BREAD = [
    "Good bread needs time more than anything else. I let the dough rest for a whole day, which gives it taste and makes it easy to shape.",
    "Flour matters too, and so does the heat of the oven. Mine reaches 250 degrees, and 3 < 4 hours of waiting are enough before the first loaf goes in.",
    "A stone holds the heat well. If you have none, turn a tray over and let it grow hot for half an hour before you bake.",
]
#: Pages written by hand, unlike those of the trainer: (html, text).
PAGES = [
    (
        "<html><body><table><tr><td class=leftnav><a href=/1>Home</a><a href=/2>News</a><a href=/3>About us</a></td><td id=maintext><h1>The river in spring</h1>"
        + "".join(f"<p>{p}</p>" for p in _RIVER)
        + "</td></tr></table><div class=copyright>Copyright 2021 River Gazette. All rights reserved.</div></body></html>",
        "The river in spring " + " ".join(_RIVER).replace("&amp;", "&"),
    ),
    (
        "<!doctype html><title>x</title><div class='site-header'><div class=logo>My Log</div><div class='search-form'><form><input><button>Go</button></form></div></div>"
        "<div class=post-content><h2>On bread</h2><noscript>Please enable scripts.</noscript>"
        + "".join(f"<p>{p}" for p in _BREAD)
        + "</div><div class='related-posts'><a href=a>On cheese</a> <a href=b>On wine</a></div>"
        "<div id=comments><div class=comment>Nice post!</div><div class=comment>I tried it and it failed.</div></div>",
        "On bread " + " ".join(_BREAD),
    ),
    ("<article><p>One sentence stands here, and another one follows it. Then the page ends <", "One sentence stands here, and another one follows it. Then the page ends <"),
    ("<article><div><noscript>Enable scripts</div>" + "".join(f"<p>{p}</p>" for p in _BREAD) + "</article>", " ".join(_BREAD)),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_html_on_pages_written_by_hand(page, want):
    assert _main_text(page) == want


def test_html_on_unseen_layouts():
    pages = html.labelled_pages(60, seed=99)
    f = html.forest([html.parse(p) for p in pages])
    m = html.default_model()
    keep, right, every = html.marginals(f, m.w, m.edge)[0] > 0.5, 0, 0
    for d, s in zip(f.doms, f.start, strict=True):
        y = []
        for i, a in enumerate(d.attrs):
            q = re.search(r'data-y="?([01])', a)
            y.append(int(q[1]) if q else y[d.parent[i]] if d.parent[i] >= 0 else 0)
        for i, _, _ in d.texts:
            every += 1
            right += keep[s + i] == y[i]
    assert right / every > 0.97


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    good = [" ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(30)) + "." for _ in range(60)]
    texts = [*good, *good[:10], *(g.upper().replace(" ", "!! ") for g in good[:30])]
    docs = _docs(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 70), 0) for i in range(0, 100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        kept.append((name, step.count()))
        assert name == "sentencepiece" or step.columns == docs.columns
    assert kept[0] == ("quality", 70) and kept[1] == ("toxicity", 70) and kept[2] == ("simhash", 60)
    rows = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r.doc_id for r in rows.collect()]
    assert len(ids) == kept[4][1] and set(ids) <= set(range(60))


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, clashing columns: every stage keeps its columns, one row of each group stays."""
    rng = random.Random(4)
    good = [" ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(30)) + "." for _ in range(40)]
    rows = [(i, g, "en", f"s{i % 3}", 1) for i, g in enumerate(good)]
    rows += [(None, good[0], None, None, None), (None, "odd " + good[1], "en", "s1", 1), (3, good[3], "en", "s0", 1), (3, "other " * 3 + good[9], "en", "s0", 1), (None, None, None, None, None), (100, "", "", "", 0), (101, " ".join(good * 40), "en", "s0", 1)]
    rows += [(200 + i, g.upper().replace(" ", "!! "), "en", "s0", 1) for i, g in enumerate(good[:20])]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("size", "FP", "part", "row", "h", "rank", "_veil_row", "_veil_id", "_veil_part", "_veil_stats", "_veil_toxic", "_veil_copies", "dig", "n_tokens"):
        docs = docs.withColumn(name, F.lit(7))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(40), *range(200, 220)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step, sizes = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
        step.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        sizes[name] = step.count()
        if name == "simhash":
            texts = [r.text for r in step.collect()]
            assert len(texts) == len(set(texts)) and sum(good[0] == x for x in texts) == 1 and any((x or "").startswith("other") for x in texts)
    out = corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path))
    assert out.count() == sizes["mixing"] > 0
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0, name


def test_classifiers_of_one_class(spark):
    docs = _docs(spark, ["a b c.", "d e f.", None, "g"], extra=True)
    for mark, n in (("quality", 1), ("quality", 0), ("toxic", 1), ("toxic", 0)):
        labels = spark.createDataFrame([(i, n, n) for i in range(4)], "doc_id long, quality int, toxic int")
        part = quality if mark == "quality" else toxicity
        rows = part.score(docs, part.fit(docs, labels)).collect()
        learned = sum(not r.held_out for r in rows)
        assert {round(r.score, 9) for r in rows} == {round((n * learned + 1) / (learned + 2), 9)}
        none = part.score(docs, part.fit(docs, labels.limit(0))).collect()
        assert len(none) == 4 and len({r.score for r in none}) == 1


def test_near_copies_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON_FROM", 2)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("aeioulnrst", k=5))
    line, texts = [word() for _ in range(12)], [*EDGE]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 60, 100, 200]))]
        for k in range(6):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own + line * (k % 3 == 0)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    par = list(range(len(texts)))
    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j]):
                linked += 1
                a, b = _root(par, i), _root(par, j)
                par[max(a, b)] = min(a, b)
    want = {i for i in range(len(texts)) if _root(par, i) == i}
    assert linked > 30 and len(want) < len(texts) - 10
    docs = _docs(spark, texts, extra=True)
    out = corpus_pipeline.distinct(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)
    assert corpus_pipeline.distinct(spark, docs.limit(0), "").count() == 0


def test_mixed_rows_have_their_own_copies(spark):
    rng = random.Random(8)
    rows = [(None if i % 3 == 0 else i // 4, "w " * rng.choice([3, 5, 9]), "en", f"s{i % 3}" if i % 5 else "s9", i) for i in range(300)]
    docs = spark.createDataFrame([*rows, *rows[:30]], DOCS)
    plan, out = mixing.plan_mix(docs).collect(), mixing.mixed(docs).collect()
    assert min(r.copies for r in plan) == 0 < max(r.copies for r in plan)
    kinds = lambda x: sorted((r.doc_id is None, r.doc_id or 0, len(r.text.split())) for r in x)
    took = [(r.doc_id is None, r.doc_id or 0, r.size) for r in plan for _ in range(r.copies)]
    assert len(out) == len(took) and {x[0] for x in kinds(out)} == {False, True}
    words = {}
    for r in out:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    sizes = {s: sum(len(x.text.split()) for x in docs.collect() if x.source == s) for s in words}
    goal = mixing.targets(sizes)
    assert set(words) == {"s0", "s1", "s2", "s9"} and all(abs(words[s] - goal[s]) <= 3 for s in goal)
    assert kinds(out) == sorted(took)


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, a), (7, a + " end"), (7, b), (None, b), (None, c), (None, c), (5, " ".join(f"d{i}" for i in range(9))), (1, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = corpus_pipeline.distinct(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in got) == [(0, "c0"), (1, ""), (5, "a0"), (5, "d0"), (7, "b0")]


def test_fingerprint_index_links_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "prefix", lambda s, common: s[:0])  # texts meet by no shingle
    base = [f"w{i}" for i in range(400)]
    docs = _docs(spark, [" ".join(base), " ".join([*base, "end"]), " ".join(f"x{i}" for i in range(400))])
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()) == [0, 2]
