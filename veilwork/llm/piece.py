"""SentencePiece encoding and decoding through a table of distinct chunks.

A model whose pieces never continue past a whitespace marker splits text exactly at the start of every run of
markers: no merge can join what lies on both sides. ``crosses_markers`` proves this from the model's own
pieces, and the encoder falls back to whole texts for a model that fails the proof. Each task keeps a
table of the distinct chunks it has met; a chunk is segmented once, and a document's ids are the ids
of its chunks joined by position. The table is emptied when it exceeds ``TABLE_SIZE``, so memory is bounded
whatever the vocabulary; results do not depend on that. Nothing is shuffled: a corpus-wide chunk table would
have to be joined back to every word of the corpus.

Edge cases: null text encodes as empty (no ids); a chunk of any length is encoded whole; control strings such as
``</s>`` in a text are ordinary text, as in the library; null elements of an id list are skipped; extra
columns are kept by ``encode`` and ``decode``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.runtime import table, workers_import

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Distinct chunks that one worker's table holds before it is emptied (some 60 MB).
TABLE_SIZE = 1 << 18
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def model_path(name: str = MODEL) -> str:
    """The public vocabulary file; tokenizers are never copied or trained here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def crosses_markers(sp) -> bool:
    """Whether chunks cannot be encoded apart: a piece holds a marker after another character, or text is rewritten."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return True
    # the normaliser must only add the leading marker and turn spaces into markers
    probes = ("a  b", " a", "a ", "\ta\n", "Ａ", "é", " x", "▁x", "\x00a")
    return any(sp.decode(sp.encode(p)) != p.replace(MARK, " ") for p in probes)


class ChunkTable:
    """Encoder and decoder; ``known`` maps what follows a chunk's first marker to the chunk's ids."""

    def __init__(self, path: str, limit: int = TABLE_SIZE):
        self.sp, self.limit = load(path), limit
        self.whole = crosses_markers(self.sp)
        self.known: dict[str, tuple[int, ...]] = {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.number = list(range(len(pieces)))  # one object an id, shared by all chunks
        self.digits = list(map(str, self.number))
        self.opens = np.array([p.startswith(MARK) for p in pieces])
        self.mark = (self.sp.piece_to_id(MARK),)

    def _chunks(self, text: str) -> list[str]:
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")  # one space between words: each chunk is a marker and a word
        return [c[1:].replace(MARK, " ") for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]

    def _learn(self, chunks: list[str]) -> None:
        known, number = self.known, self.number
        if len(known) > self.limit:
            known.clear()
        new = list({c for c in chunks if c not in known})
        words = [c for c in new if c and " " not in c]
        # words are encoded in one call: an id that opens with the marker begins the next word
        ids = self.sp.encode(" ".join(words), num_threads=1)
        at = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)] if ids else [0]
        for i, word in enumerate(words):
            known[word] = tuple([number[x] for x in ids[at[i] : at[i + 1]]])
        for c in new:
            if not c:
                known[c] = self.mark  # the marker alone, for which the library has no text
            elif " " in c:
                known[c] = tuple([number[x] for x in self.sp.encode(c, num_threads=1)])

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.whole:
            return self.sp.encode(text, num_threads=1)
        chunks = self._chunks(text)
        got = list(map(self.known.get, chunks))
        if None in got:
            self._learn(chunks)
            got = list(map(self.known.__getitem__, chunks))
        return list(chain.from_iterable(got))

    def joined(self, ids: list[int]) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int | None] | None) -> str:
        ids = [i for i in ids or [] if i is not None]
        return self.sp.decode(ids) if ids else ""


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    """The worker's table: later tasks of the same worker find it filled."""
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def _map(df: DataFrame, column: str, out: str, kind: T.DataType, arrow: pa.DataType, path: str, method: str) -> DataFrame:
    workers_import(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name.lower() != out.lower()]
    at = [f.name for f in keep].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = getattr(chunk_table(path), method)
        for b in batches:
            got = [apply(v.as_py()) for v in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, arrow)], [*b.schema.names, out])

    return df.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, T.StructType([*keep, T.StructField(out, kind)]))


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the column ``out`` of ids; a column of that name is replaced."""
    return _map(df, text_col, out, T.ArrayType(T.IntegerType(), False), pa.list_(pa.field("element", pa.int32(), False)), path or model_path(), "encode")


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the column ``out`` of texts, by the library's decode; a column of that name is replaced."""
    return _map(df, ids_col, out, T.StringType(), pa.string(), path or model_path(), "decode")


def encoded_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row, and ``ids`` if asked for; narrow."""
    workers_import(df.sparkSession)
    where = path or model_path()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(where)
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                counts, digests, texts, kept = [], [], [], []
                for v in b.column(1):
                    got = chunks.encode(v.as_py())
                    counts.append(len(got))
                    digests.append(sha(chunks.joined(got)))
                    texts.append(sha(chunks.decode(got)))
                    if with_ids:
                        kept.append(pa.array(got, pa.int32()))
                arrays = [b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
                if with_ids:
                    ends = np.cumsum([0, *counts], dtype=np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(kept)))
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, kind)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))
