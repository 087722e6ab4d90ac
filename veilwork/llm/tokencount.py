"""Token counts that follow edits.

A document's pre-tokens (the pieces that byte-pair merges never cross) lie in blocks under a segment tree whose nodes hold the
characters and tokens of their subtree. An edit descends by characters to the pre-tokens it touches and re-encodes
from the last pre-token that can see the edit up to the first boundary that old and new text share behind it:
the splitting pattern reads forward only, at most two characters past a match, so everything outside is as it was. Sums
are then updated on the way to the root.

Edge cases: null text counts as empty; an edit's position and length are clipped to the text; null edits, and null members
of them, change nothing; a null list is empty; extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.runtime import table, workers_import

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens of a block when the tree is built; a block may grow to four times that.
BLOCK = 64
#: Characters that a pre-token is seen to look past its own end, at most.
AHEAD = 2
#: Distinct pre-tokens whose count a worker keeps.
KEPT = 1 << 18
_RUN = re.compile(r" \s")
EDITS = "array<struct<pos:int,del:int,ins:string>>"


class Counter:
    """Splits text into pre-tokens and counts the tokens of each, every distinct one once."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("veilwork", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.words: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of a text's pre-tokens.

        A pre-token holds a space before other characters only at its start, so a text without white space behind
        a space splits exactly before each space, and every distinct word (with the space before it) is split once.
        """
        if text[-1:] in ("", " ") or text[0] == " " or _RUN.search(text):
            found = self.pattern.findall(text)
            return list(map(len, found)), self.counts(found)
        first, *rest = text.split(" ")
        found = self.pattern.findall(first)
        got = list(map(self.words.get, rest))
        if None in got:
            if len(self.words) > KEPT:
                self.words.clear()
            for w in set(rest).difference(self.words):
                parts = self.pattern.findall(f" {w}")
                self.words[w] = tuple(map(len, parts)), tuple(self.counts(parts))
            got = list(map(self.words.__getitem__, rest))
        lengths, tokens = list(map(len, found)), self.counts(found)
        lengths.extend(chain.from_iterable(g[0] for g in got))
        tokens.extend(chain.from_iterable(g[1] for g in got))
        return lengths, tokens

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > KEPT:
                known.clear()
            for p in set(pieces).difference(known):
                known[p] = len(self.encoding.encode_ordinary(p))
            out = list(map(known.__getitem__, pieces))
        return out

    def whole(self, text: str) -> int:
        """Plain count of a whole text, without the table."""
        return len(self.encoding.encode_ordinary(text))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str | None = None) -> Counter:
    import public_tokenizers as public

    path = path or public.path(RANKS)
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, public.PATTERN)
    return _COUNTERS[path]


class EditedText:
    """A text, its pre-tokens in blocks, and the segment tree of their characters and tokens."""

    def __init__(self, text: str, with_: Counter):
        self.with_, self.text, self.recoded = with_, text, 0
        lengths, tokens = with_.pieces(text)
        self.blocks = [(lengths[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self._tree()

    def _tree(self) -> None:
        self.leaves = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, (c, t) in enumerate(self.blocks):
            self.chars[self.leaves + i], self.tokens[self.leaves + i] = sum(c), sum(t)
        for n in range(self.leaves - 1, 0, -1):
            self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
            self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pieces(self) -> int:
        return sum(len(c) for c, _ in self.blocks)

    def _locate(self, at: int) -> tuple[int, int, int]:
        """(block, pre-token in it, start) of the pre-token that holds character ``at``, or of the last one."""
        n, start = 1, 0
        if not self.chars[1]:
            return 0, 0, 0
        at = min(at, self.chars[1] - 1)
        while n < self.leaves:
            n *= 2
            if at >= start + self.chars[n]:
                start += self.chars[n]
                n += 1
        b, i = n - self.leaves, 0
        lengths = self.blocks[b][0]
        while i < len(lengths) - 1 and at >= start + lengths[i]:
            start += lengths[i]
            i += 1
        return b, i, start

    def _update(self, b: int) -> None:
        n = self.leaves + b
        self.chars[n], self.tokens[n] = sum(self.blocks[b][0]), sum(self.blocks[b][1])
        while n > 1:
            n //= 2
            self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
            self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    def edit(self, pos: int, cut: int, ins: str) -> None:
        pos = min(max(0, pos), len(self.text))
        cut = min(max(0, cut), len(self.text) - pos)
        if not cut and not ins:
            return
        old = len(self.text)
        self.text = self.text[:pos] + ins + self.text[pos + cut :]
        b, i, start = self._locate(max(0, pos - AHEAD))
        shift, stop = len(ins) - cut, pos + len(ins)
        # old boundaries behind the edit, met as the new pre-tokens are
        eb, ei, edge = b, i, start
        new: list[str] = []
        at = start
        for m in self.with_.pattern.finditer(self.text, start):
            at = m.start()
            while at >= stop and edge + shift < at and edge < old:
                eb, ei, edge = self._after(eb, ei, edge)
            if at >= stop and edge + shift == at:
                break
            new.append(m[0])
        else:
            while edge < old:
                eb, ei, edge = self._after(eb, ei, edge)
        self.recoded += len(new)
        fresh = ([len(p) for p in new], self.with_.counts(new))
        tail = tuple(x[ei:] for x in self.blocks[eb]) if edge < old else ([], [])
        self.blocks[b] = tuple(x[:i] + f + t for x, f, t in zip(self.blocks[b], fresh, tail, strict=True))
        for k in range(b + 1, min(eb, len(self.blocks) - 1) + 1):
            self.blocks[k] = ([], [])
        if len(self.blocks[b][0]) > 4 * BLOCK or eb - b > 8:
            flat = [[v for blk in self.blocks for v in blk[s]] for s in (0, 1)]
            self.blocks = [(flat[0][k : k + BLOCK], flat[1][k : k + BLOCK]) for k in range(0, len(flat[0]), BLOCK)] or [([], [])]
            self._tree()
        else:
            for k in range(b, min(eb, len(self.blocks) - 1) + 1):
                self._update(k)

    def _after(self, b: int, i: int, start: int) -> tuple[int, int, int]:
        """The pre-token behind (b, i), which starts at ``start``; past the last one, (last block, its length, end)."""
        start += self.blocks[b][0][i] if i < len(self.blocks[b][0]) else 0
        i += 1
        while i >= len(self.blocks[b][0]) and b + 1 < len(self.blocks):
            b, i = b + 1, 0
        return b, i, start


def edited_counts(docs: DataFrame, text_col: str = "text", edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens_before``, ``n_tokens``, ``n_pretokens``, ``n_recoded`` and ``edited_sha256``.

    ``edits_col`` is an array as ``EDITS``, applied in order, positions being code points of the text as it then is.
    Columns of those names are replaced. Narrow.
    """
    workers_import(docs.sparkSession)
    names = ["n_tokens_before", "n_tokens", "n_pretokens", "n_recoded", "edited_sha256"]
    keep = [f for f in docs.schema.fields if f.name.lower() not in names]
    where = [f.name for f in keep]
    t, e = where.index(text_col), where.index(edits_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            rows = []
            for text, edits in zip(b.column(t), b.column(e), strict=True):
                doc = EditedText(text.as_py() or "", c)
                before = doc.n_tokens
                for x in edits.as_py() or []:
                    if x:
                        doc.edit(x["pos"] or 0, x["del"] or 0, x["ins"] or "")
                rows.append((before, doc.n_tokens, doc.n_pieces, doc.recoded, hashlib.sha256(doc.text.encode("utf-8", "surrogatepass")).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            made = [pa.array(x, pa.int64()) for x in cols[:4]] + [pa.array(cols[4], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *names])

    kinds = [T.StructField(n, T.LongType()) for n in names[:4]] + [T.StructField(names[4], T.StringType())]
    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, T.StructType([*keep, *kinds]))


def standing_edits(doc_id: str = "doc_id", text: str = "text"):
    """Three edits for every document, drawn from a hash of its id: an insertion, a deletion, an appended word."""
    n = F.coalesce(F.length(text), F.lit(0))
    at = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), n + 1).cast("int")
    edit = lambda pos, cut, ins: F.struct(pos.alias("pos"), F.lit(cut).alias("del"), F.lit(ins).alias("ins"))
    return F.array(edit(at(1), 0, " [edited  text]\n"), edit(at(2), 9, ""), edit(F.lit(2**31 - 1), 0, " don't stop"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", standing_edits())
    return edited_counts(docs).drop("text", "edits")
