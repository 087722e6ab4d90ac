"""Toxicity: misspelled terms by Levenshtein automata on a lexicon trie, weighed by their context.

The lexicon is learned from a bounded sample of labelled rows: whole words and stems (word beginnings) whose likelihood ratio
between toxic and clean documents beats every chance find among the words tested. It is a trie; a word of a text is
looked up by walking the trie together with the word's automaton (one edit: a letter too many, missing, changed, or two
swapped), so all terms within one edit come out of one walk. Words that share no half with any term cannot be within
one edit, and skip the walk. Digits and signs that stand for letters are read as those letters, others are one edit; terms
under ``FUZZY_FROM`` letters bear only a swap or one sign.

How telling a misspelling is follows from the sample, too, for each term and kind of edit: a word of clean documents is never a
misspelling, and words near a term that a single clean document holds (a measure of those that the sample lacks) count
against the term; one that many such words touch is only matched exactly. Without any, a misspelled term weighs
as much as the term itself.

Each hit is weighed by a window of words around it: a hit inside quotation marks, or near a word of reporting, is quotation;
one near a second-person word is address. A logistic fit with a prior turns the weighed sums into a score.
Labels, language, source and id are never inputs of a score.

Edge cases: null text counts as empty and is scored; labels are used as in the quality classifier (null, held-out and repeated
ones likewise); with labels of one class only the lexicon is empty and every score is the smoothed share; a null id is not
held out; extra columns are ignored by ``score`` and kept by ``keep_clean``. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.quality import labelled_sample
from veilwork.llm.runtime import durable, free_name, held_out, table, workers_import

#: Labelled rows that a fit takes at most, least hashed ids first, and terms that a lexicon has at most.
MAX_LABELLED = 8_000
MAX_TERMS = 4_000
THRESHOLD = 0.5
#: Lengths of the word beginnings that are tested as stems; a shorter term than ``FUZZY_FROM`` bears only a swap or a sign.
STEMS = (4, 5, 6)
FUZZY_FROM = 5
#: Words that a stem must begin in toxic documents.
FAMILY = 4
#: Share of a term's own weight that a kind of misspelling must keep to be looked for.
EDIT_SHARE = 0.75
WINDOW = 8
#: Distinct words whose lookup a worker keeps.
KEPT_WORDS = 1 << 19
_WORD = re.compile(r"[^\W\d_]+")
#: Runs that may hold digits or signs inside a word; what ends or begins them is stripped.
_RUN = re.compile(r"""[^\s,;:/()\[\]{}"“”„«»<>…–—=?\\]+""")
_OUTER = "".join(c for c in map(chr, range(33, 256)) if not c.isalnum())
_QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
_QUOTE_OR_END = re.compile('["“”«»„\n]')
#: Fixed value: digits and signs that are written for letters.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"}
_UNDISGUISE = str.maketrans(DISGUISES)
#: Fixed word lists: words of reporting, and of address, in the languages of the corpus.
REPORTING = frozenset("said says say called calls quote quoted quotes wrote writes word words term dit disait écrit mot terme sagte sagt nannte wort schrieb dijo dice llamó palabra escribió".split())
ADDRESS = frozenset("you your yours you're u tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted tú ti tus vosotros".split())
#: Features of a document, and the prior mean and precision of their weights.
FEATURES = ("abuse", "quoted", "address", "density")
_PRIOR = np.array([-4.0, 1.0, 0.15, 0.3, 0.2])
_PRECISION = np.array([0.05, 0.5, 5.0, 5.0, 2.0])
#: Kinds of misspelling: of letters alone, and with digits or signs.
LETTERS, SIGNS = "letters", "signs"


class Trie:
    """Lexicon trie; ``near`` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in terms:
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                node = self.next[node][c]
            self.term[node] = term

    def near(self, word: str, edits: int = 1) -> list[tuple[int, str]]:
        """(distance, term) of every term within ``edits``; two neighbours swapped are one edit.

        A state pairs a node with a state of the automaton: how much of the word is read, with how many edits.
        """
        found: dict[str, int] = {}
        n, todo, seen = len(word), [(0, 0, 0)], set()
        nexts, terms = self.next, self.term
        while todo:
            state = todo.pop()
            node, i, e = state
            if e < edits:
                if state in seen:
                    continue
                seen.add(state)
                if i < n:
                    todo.append((node, i + 1, e + 1))
                    c = word[i]
                    for k, kid in nexts[node].items():
                        todo.append((kid, i, e + 1))
                        todo.append((kid, i + 1, e if k == c else e + 1))
                    if i + 1 < n and word[i + 1] != c:
                        after = nexts[node].get(word[i + 1])
                        swapped = None if after is None else nexts[after].get(c)
                        if swapped is not None:
                            todo.append((swapped, i + 2, e + 1))
                else:
                    todo += [(kid, i, e + 1) for kid in nexts[node].values()]
            else:  # no edit is left: the rest of the word is the only way on
                while i < n and node is not None:
                    node = nexts[node].get(word[i])
                    i += 1
            if i == n and node is not None and terms[node] is not None:
                found[terms[node]] = min(e, found.get(terms[node], e))
        return sorted((e, t) for t, e in found.items())


def is_plain(word: str) -> bool:
    return word.isalpha()


def undisguise(run: str) -> str | None:
    """A run with digits or signs inside, as the letters they may stand for; none if it is a plain word or holds no letter."""
    core = run.strip(_OUTER)
    if is_plain(core) or not any(c.isalpha() for c in core):
        return None
    return core.translate(_UNDISGUISE)


def quotations(text: str) -> list[tuple[int, int]]:
    """The spans between quotation marks that close on their own line, merged and in order; one pass."""
    spans, opened = [], {}
    for m in _QUOTE_OR_END.finditer(text):
        c = m[0]
        if c == "\n":
            opened.clear()
        elif c in opened:
            spans.append((opened.pop(c), m.start()))
        elif c in _QUOTES:
            opened.setdefault(_QUOTES[c], m.end())
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


@dataclass
class Lexicon:
    """Weights of whole words and of stems (word beginnings), and of misspelled words by kind; ``innocent`` words are none."""

    words: dict[str, float]
    stems: dict[str, float]
    edits: dict[str, dict[str, float]] | None = None
    innocent: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        if self.edits is None:  # every misspelling weighs as its term
            self.edits = {w: {LETTERS: x, SIGNS: x} for w, x in self.words.items()}
        fuzzy = [w for w in self.edits if len(w) >= FUZZY_FROM]
        self.trie = Trie(fuzzy)
        # one edit leaves the first or the second half of a term whole, or swaps the letters where they meet:
        # by length of a word, the halves it may have
        halves: dict[int, dict[tuple[bool, int], set[str]]] = {}
        for w in fuzzy:
            half = len(w) // 2
            for n in (len(w) - 1, len(w), len(w) + 1):
                mine = halves.setdefault(n, {})
                mine.setdefault((True, half), set()).update((w[:half], w[: half - 1] + w[half]))
                mine.setdefault((False, len(w) - half), set()).add(w[half:])
        self.halves = {n: [(first, k, got) for (first, k), got in m.items()] for n, m in halves.items()}
        # short terms: a swap behind the first letter, or one sign
        self.short: dict[str, str] = {}
        for w in sorted(w for w in self.edits if 3 <= len(w) < FUZZY_FROM):
            for i in range(len(w)):
                self.short.setdefault(f"{w[:i]}*{w[i + 1 :]}", w)
            for i in range(1, len(w) - 1):
                self.short.setdefault(w[:i] + w[i + 1] + w[i] + w[i + 2 :], w)
        self.most = max([1.0, *self.words.values(), *self.stems.values()])
        self.stem_lengths = sorted({len(s) for s in self.stems})
        self.seen: dict[str, float | None] = {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "edits": self.edits, "innocent": self.innocent}

    def __setstate__(self, state: dict) -> None:
        self.words, self.stems, self.edits, self.innocent = state["words"], state["stems"], state["edits"], state["innocent"]
        self.__post_init__()

    def exact(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.stem_lengths:
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def near(self, word: str) -> list[str]:
        """The terms that ``word`` may be a misspelling of."""
        found = []
        if any((word[:k] if first else word[-k:]) in halves for first, k, halves in self.halves.get(len(word), ())):
            found = [t for e, t in self.trie.near(word) if e]
        if len(word) < FUZZY_FROM and word not in self.words:
            key = word if word.isalpha() else "".join(c if c.isalpha() else "*" for c in word)
            found += [self.short[key]] if key in self.short else []
        return found

    def _find(self, word: str) -> float | None:
        best = self.exact(word)
        if best or word in self.innocent:
            return best or None
        return max((self.edits[t].get(LETTERS, 0.0) for t in self.near(word)), default=0.0) or None

    def _find_disguised(self, word: str) -> float | None:
        terms = [word] if word in self.edits else [] if word in self.innocent else self.near(word)
        return max((self.edits[t].get(SIGNS, 0.0) for t in terms), default=0.0) or None

    def hit(self, word: str, disguised: bool = False) -> float | None:
        """The weight of a word, or of a run that ``undisguise`` read; none if it is no hit."""
        key = f"~{word}" if disguised else word
        if key not in self.seen:
            self.seen[key] = self._find_disguised(word) if disguised else self._find(word)
        return self.seen[key]

    def _disguised(self, text: str) -> dict[str, float]:
        """The weights of the runs of a text that are hits with digits or signs inside, none of whose words is one."""
        out = {}
        for run in set(_RUN.findall(text)):
            if not run.isalpha():
                word = undisguise(run)
                weight = self.hit(word, True) if word else None
                if weight and not any(self.hit(w) for w in _WORD.findall(run)):
                    out[run] = weight
        return out

    def features(self, text: str | None) -> list[float]:
        """``FEATURES`` of a whole text."""
        text = (text or "").lower()
        words = _WORD.findall(text)
        if len(self.seen) > KEPT_WORDS:
            self.seen.clear()
        weights = {w: x for w in set(words) if (x := self.hit(w)) is not None}
        runs = self._disguised(text)
        if not weights and not runs:
            return [0.0] * len(FEATURES)
        quoted = quotations(text)
        spans = None
        if runs:  # such a run is one word, in place of its parts
            tokens = [t for m in _RUN.finditer(text) for t in ([(m[0], m.span())] if m[0] in runs else [(w[0], w.span()) for w in _WORD.finditer(text, *m.span())])]
            words, spans = [t for t, _ in tokens], [at for _, at in tokens]
            weights |= runs
        elif quoted:  # offsets are only needed where quotation marks could enclose a hit
            spans = [m.span() for m in _WORD.finditer(text)]
        starts = [start for start, _ in quoted]
        sums: dict[tuple[str, str], float] = {}
        mass = 0.0
        for i in [i for i, w in enumerate(words) if w in weights]:
            w = words[i]
            around = {*words[max(0, i - WINDOW) : i], *words[i + 1 : i + 1 + WINDOW]}
            k = bisect_right(starts, spans[i][0]) - 1 if quoted else -1
            if k >= 0 and spans[i][1] <= quoted[k][1] or not around.isdisjoint(REPORTING):
                sums["quoted", w] = weights[w]
                continue
            mass += weights[w] / self.most
            sums["abuse", w] = weights[w]
            if not around.isdisjoint(ADDRESS):
                sums["address", w] = weights[w]
        total = lambda kind: math.log1p(sum(v for (k, _), v in sums.items() if k == kind)) * 2
        return [total("abuse"), total("quoted"), total("address"), math.log1p(100 * mass / len(words))]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + x @ self.weights[1:])))


def _terms(text: str | None) -> list[str]:
    """What is counted of a text: its words, their beginnings (``*`` behind) and its disguised words (``~`` before), each once."""
    text = (text or "").lower()
    words = sorted(set(_WORD.findall(text)))
    hidden = {u for r in set(_RUN.findall(text)) if not r.isalpha() and (u := undisguise(r))}
    return [*words, *sorted({f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}), *sorted(f"~{u}" for u in hidden)]


def learn_lexicon(rows: DataFrame, text_col: str) -> Lexicon:
    """Words and stems that mark toxic documents, counted once a document over the labelled sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                terms = _terms(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([y] * len(terms), pa.int32())], ["term", "y"])

    terms = rows.select(F.col(text_col).cast("string"), F.col("_veil_y").cast("int")).mapInArrow(run, "term string, y int")
    is_stem, is_word = F.col("term").endswith("*"), ~F.col("term").endswith("*") & ~F.col("term").startswith("~")
    counts = durable(terms.groupBy("term").agg(F.sum("y").alias("pos"), F.count("*").alias("all")).where((F.col("all") >= 2) | ~is_stem))
    totals = rows.agg(F.sum("_veil_y"), F.count("*")).first()
    p, n = int(totals[0] or 0), int(totals[1]) - int(totals[0] or 0)
    if not p or not n:
        return Lexicon({}, {})
    base = p / (p + n)
    rich = counts.where(~F.col("term").startswith("~") & (F.col("all") >= 2) & (F.col("pos") >= 0.6 * F.col("all")) & (F.col("pos") > 3 * base * F.col("all") if base < 0.2 else F.lit(True)))
    tested = counts.where((F.col("all") >= 2) & ~F.col("term").startswith("~")).count()
    found = rich.orderBy(F.desc("pos"), "term").limit(20 * MAX_TERMS).collect()
    bar = 2 * math.log(max(tested, 2))
    weight = lambda pos, neg: math.log((pos + 0.5) / (p + 1)) - math.log((neg + 0.5) / (n + 1))
    kept = []
    for r in found:
        a, c = r["pos"], r["all"] - r["pos"]
        ratio = 2 * (a * math.log(a / ((a + c) * base)) + (c * math.log(c / ((a + c) * (1 - base))) if c else 0))
        if ratio >= bar:
            kept.append((ratio, r["term"], weight(a, c)))
    # a stem must stand for a family of words, not for one word that is a term itself
    mine = [t[:-1] for _, t, _ in kept if t[-1] == "*"]
    words = counts.where(is_word & (F.col("pos") >= 0.6 * F.col("all")))
    beginnings = F.explode(F.array(*[F.substring("term", 1, n) for n in STEMS])).alias("stem")
    family = words.select(beginnings, "term").where(F.col("stem").isin(mine)).groupBy("stem").agg(F.countDistinct("term").alias("n")) if mine else None
    wide = {r["stem"] for r in family.where(F.col("n") >= FAMILY).collect()} if mine else set()
    kept = sorted((k for k in kept if k[1][-1] != "*" or k[1][:-1] in wide), reverse=True)[:MAX_TERMS]
    lexicon = Lexicon({t: w for _, t, w in kept if t[-1] != "*"}, {t[:-1]: w for _, t, w in kept if t[-1] == "*"})
    seen = {r["term"]: (r["pos"], r["all"] - r["pos"]) for r in found if r["term"] in lexicon.words}
    touched, clean_words = near_words(counts.where(~is_stem & (F.col("pos") < F.col("all"))), lexicon)
    edits: dict[str, dict[str, float]] = {}
    for term, own in lexicon.words.items():
        for kind in (LETTERS, SIGNS):
            pos, neg = seen[term]
            x = weight(pos, neg + touched.get((term, kind), 0))
            if x >= EDIT_SHARE * own:
                edits.setdefault(term, {})[kind] = min(x, own)
    return Lexicon(lexicon.words, lexicon.stems, edits, clean_words({(t, k) for t, kinds in edits.items() for k in kinds}))


def near_words(counts: DataFrame, lexicon: Lexicon) -> tuple[dict[tuple[str, str], int], Callable[[set[tuple[str, str]]], frozenset[str]]]:
    """How many words near a term a single clean document holds, by (term, kind), and all such words of clean documents for given ones.

    The first has at most two numbers a term, the second only words within one edit of a term.
    """
    names = ["term", "kind", "word", "neg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for word, neg in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kind, word = (SIGNS, word[1:]) if word[0] == "~" else (LETTERS, word)
                terms = [word] if kind == SIGNS and word in lexicon.edits else [] if kind == LETTERS and lexicon.exact(word) else lexicon.near(word)
                out += [(t, kind, word, neg) for t in terms]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names)

    rows = counts.where(F.length("term") > 0).select("term", (F.col("all") - F.col("pos")).cast("long").alias("neg"))
    near = durable(rows.mapInArrow(run, "term string, kind string, word string, neg long"))
    # words that one clean document has stand for those that the sample lacks; others are known to be innocent
    once = near.groupBy("term", "kind").agg(F.sum((F.col("neg") == 1).cast("long")).alias("n"))
    sums = {(r["term"], r["kind"]): int(r["n"]) for r in once.collect()}

    def words(kept: set[tuple[str, str]]) -> frozenset[str]:
        kept = sorted(kept & set(sums))
        if not kept:
            return frozenset()
        some = F.broadcast(rows.sparkSession.createDataFrame(kept, "term string, kind string"))  # at most two rows a term
        return frozenset(r["word"] for r in near.join(some, ["term", "kind"], "left_semi").select("word").distinct().collect())

    return sums, words


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> Model:
    workers_import(docs.sparkSession)
    rows = durable(labelled_sample(docs.select(id_col, text_col), labels, "toxic", id_col, limit))
    lexicon = learn_lexicon(rows, text_col)
    got = rows.select("_veil_id", "_veil_y", features_column(lexicon, text_col).alias("x")).groupBy("_veil_id").agg(F.min("_veil_y").alias("y"), F.max("x").alias("x"))
    got = sorted(got.collect())  # a row for each of at most ``limit`` labels
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), len(FEATURES))
    y = np.array([r["y"] for r in got], np.float64)
    if not lexicon.words and not lexicon.stems:
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 1 / 3
        return Model(lexicon, np.array([math.log(share / (1 - share))] + [0.0] * len(FEATURES)))
    return Model(lexicon, posterior_mode(np.concatenate([np.ones((len(x), 1)), x], axis=1), y))


def posterior_mode(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights that are likeliest given the prior: Newton steps, each halved until the posterior does not fall."""

    def loss(w: np.ndarray) -> float:
        f = a @ w
        return float(np.sum(np.logaddexp(0, f) - y * f) + 0.5 * np.sum(_PRECISION * (w - _PRIOR) ** 2))

    w = _PRIOR.copy()
    now = loss(w)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (q - y) + _PRECISION * (w - _PRIOR)
        step = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + np.diag(_PRECISION), grad)
        size = 1.0
        while size > 1e-8 and not loss(w - size * step) <= now:
            size /= 2
        new = loss(w - size * step)
        if size <= 1e-8 or now - new < 1e-9:
            break
        w, now = w - size * step, new
    return w


def features_column(lexicon: Lexicon, text: str) -> Column:
    """``FEATURES`` as an array of doubles; the lexicon has a bounded number of terms and goes with the task."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([lexicon.features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(F.col(f"`{text}`").cast("string"))


def score_column(model: Model, features: str) -> Column:
    total = F.lit(float(model.weights[0]))
    for i, w in enumerate(model.weights[1:].tolist()):
        total = total + F.col(features)[i] * w
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; narrow."""
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), features_column(model.lexicon, text_col).alias("x"))
    rows = rows.select("doc_id", held_out().alias("held_out"), score_column(model, "x").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; columns as they were; narrow."""
    x = free_name(docs.columns, "_veil_toxic")
    return docs.withColumn(x, features_column(model.lexicon, text_col)).where(score_column(model, x) < threshold).drop(x)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))
