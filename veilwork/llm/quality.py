"""Quality classifier: a sparse rule ensemble.

Statistics of whole texts are the inputs. Shallow boosted trees are grown on a bounded sample of labelled rows, every path of
a tree becomes a conjunctive rule, a lasso logistic fit keeps few of them, and the rules that stay are compiled into one
Spark column expression over the statistics. Labels, language, source and id are never inputs of a score.

Edge cases: null text counts as empty and is scored; a label that is null or whose row is held out (``crc32`` of the id's text
modulo 5 is 0) is not learned from; of repeated labels of an id the least counts; with no label, or labels of one
class only, every score is the smoothed share of label 1; a null id is not held out; extra columns are ignored by
``score`` and kept by ``keep_good``. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.runtime import free_name, held_out, table, workers_import

#: Labelled rows that a fit takes at most, least hashed ids first.
MAX_LABELLED = 8_000
THRESHOLD = 0.3
STATS = ("words", "word_len", "upper", "letters", "symbols", "digits", "bangs", "bars", "echo", "window_new", "line_len", "line_new", "ends")
_WINDOW = 100


def text_stats(text: str | None) -> tuple[float, ...]:
    """``STATS`` of a whole text: shares lie between 0 and 1; an empty text has none of anything."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    b = np.frombuffer(raw, np.uint8)
    h = np.bincount(b, minlength=256)
    upper = h[65:91].sum() + np.count_nonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E))
    lower = h[97:123].sum() + h[0xC0:].sum() - (upper - h[65:91].sum())
    space = h[9:14].sum() + h[32]
    shown = max(1, len(raw) - space)
    digits = h[48:58].sum()
    plain = h[ord(".")] + h[ord(",")] + h[ord("'")] + h[ord("-")]
    symbols = h[33:127].sum() - h[65:91].sum() - h[97:123].sum() - digits - plain
    echo = sum(map(eq, words, words[1:])) / max(1, n - 1)
    fresh = sum(len(set(words[i : i + _WINDOW])) for i in range(0, n, _WINDOW)) / n
    lines = raw.split(b"\n")
    ends = sum(1 for x in lines if x.rstrip()[-1:] in b".!?:\"') " and x.strip()) / len(lines)
    return (float(n), shown / n, upper / max(1, upper + lower), (upper + lower) / shown, symbols / shown, digits / shown, h[33] / n, h[124] / n, echo, fresh, n / len(lines), len(set(lines)) / len(lines), ends)


def stats_column(text: str) -> Column:
    kind = ", ".join(f"{s} double" for s in STATS)

    def run(texts: pa.Array) -> pa.Array:
        rows = np.array([text_stats(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(STATS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATS))], names=list(STATS))

    return F.arrow_udf(run, f"struct<{kind.replace(' double', ':double')}>")(F.col(f"`{text}`").cast("string"))


# -- trees and rules ------------------------------------------------------------------------------------------------
Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, threshold) all hold


def grow(x: np.ndarray, g: np.ndarray, depth: int, leaf: int, path: Rule = ()) -> tuple[list[Rule], np.ndarray]:
    """A least-squares tree on residuals: the rules of its nodes, and its fitted values."""
    fit = np.full(len(g), g.mean() if len(g) else 0.0)
    if depth == 0 or len(g) < 2 * leaf:
        return [], fit
    best = (1e-9, 0, 0.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(g[order])
        i = np.arange(leaf, len(g) - leaf + 1)
        i = i[v[i - 1] < v[np.minimum(i, len(v) - 1)]]
        if len(i):
            gain = s[i - 1] ** 2 / i + (s[-1] - s[i - 1]) ** 2 / (len(g) - i) - s[-1] ** 2 / len(g)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[i[k] - 1] + v[i[k]]) / 2))
    if best[0] <= 1e-9:
        return [], fit
    _, j, cut = best
    rules: list[Rule] = []
    for above in (False, True):
        side, here = (x[:, j] > cut) == above, (*path, (j, above, cut))
        more, fit[side] = grow(x[side], g[side], depth - 1, leaf, here)
        rules += [here, *more]
    return rules, fit


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, j] > cut) == above for j, above, cut in rule])


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, rate: float = 0.5, leaf: int = 5) -> list[Rule]:
    f, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        found, fit = grow(x, y - p, depth, leaf)
        rules += found
        f = f + rate * 4 * fit
    return list(dict.fromkeys(rules))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept bears no penalty."""
    n, k = z.shape
    a = np.concatenate([np.ones((n, 1)), z], axis=1)
    step = 4 * n / (np.linalg.norm(a, 2) ** 2 + 1e-9)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -40, 40))) - y) / n
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - step * penalty)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


class RuleModel:
    """Weighted conjunctive rules; ``column`` compiles them to one Spark expression."""

    def __init__(self, bias: float, rules: list[tuple[float, Rule]]):
        self.bias, self.rules = bias, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 2e-4) -> RuleModel:
        ones = int(y.sum())
        if ones in (0, len(y)):
            share = (ones + 1) / (len(y) + 2)
            return cls(float(np.log(share / (1 - share))), [])
        rules = boosted_rules(x, y)
        z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
        bias, w = lasso_logistic(z, y, penalty)
        return cls(bias, [(float(c), r) for c, r in zip(w, rules, strict=True) if abs(c) > 1e-6])

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for w, rule in self.rules:
            f += w * holds(rule, x)
        return 1 / (1 + np.exp(-f))

    def column(self, stats: str) -> Column:
        def test(j: int, above: bool, cut: float) -> Column:
            c = F.col(f"{stats}.{STATS[j]}")
            return c > cut if above else c <= cut

        total = F.lit(self.bias)
        for w, rule in self.rules:
            total = total + F.when(reduce(Column.__and__, [test(*t) for t in rule]), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, mark: str, id_col: str, limit: int) -> DataFrame:
    """The rows of ``docs`` that bear one of at most ``limit`` labels, outside the held-out fold."""
    few = labels.select(F.col("doc_id").cast("long").alias("_veil_id"), F.col(mark).cast("int").alias("_veil_y"))
    few = few.where(F.col("_veil_id").isNotNull() & F.col("_veil_y").isin(0, 1) & ~held_out("_veil_id"))
    few = few.groupBy("_veil_id").agg(F.min("_veil_y").alias("_veil_y"))
    few = few.orderBy(F.xxhash64("_veil_id"), "_veil_id").limit(limit)
    return docs.join(F.broadcast(few), F.col(id_col).cast("long") == F.col("_veil_id"))  # at most ``limit`` rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> RuleModel:
    workers_import(docs.sparkSession)
    rows = labelled_sample(docs.select(id_col, text_col), labels, "quality", id_col, limit)
    rows = rows.select("_veil_id", "_veil_y", stats_column(text_col).alias("s")).groupBy("_veil_id").agg(F.min("_veil_y").alias("y"), F.min("s").alias("s"))
    got = sorted(rows.collect())  # a row for each of at most ``limit`` labels
    x = np.array([list(r["s"]) for r in got], np.float64).reshape(len(got), len(STATS))
    return RuleModel.fit(x, np.array([r["y"] for r in got], np.float64))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; narrow."""
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), stats_column(text_col).alias("s"))
    rows = rows.select("doc_id", held_out().alias("held_out"), model.column("s").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; columns as they were; narrow."""
    s = free_name(docs.columns, "_veil_stats")
    return docs.withColumn(s, stats_column(text_col)).where(model.column(s) >= threshold).drop(s)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))
