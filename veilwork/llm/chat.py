"""Chat formatting with typed content parts.

Texts are read as typed parts (text, image, audio, document: what a Markdown reference points to, by its file name). A visitor
flattens the parts of a turn into text with ordered placeholders and records for each an attachment reference, the
source text it stands for and its expanded token count. The template marks turns as::

    <s>[ROLE]role[/ROLE]text</s>

Control strings inside texts are escaped reversibly: every character that can begin a mark (``<``, ``[``) and the escape
character itself (``\\``) gets a leading ``\\``, so no mark can appear in a text and unescaping is exact; a text that
looks like a placeholder stays a text.

One row comes out for each turn (its piece of the formatted conversation, the loss spans and attachments in it); a
conversation is the pieces in order. So a conversation of any number of turns is never held together in
memory; ``digests`` reads the stream of pieces back turn by turn.

Edge cases: null text is empty; a null role is the empty role; a null conv_id is a conversation of its own; repeated rows
are turns of their own; turns with equal (or null) number are ordered by role, then text; unknown part types are
kept as a placeholder of their own type; a reference to a file of no known kind is text; a turn is one row, so one task reads
a conversation through, turn by turn; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.runtime import table, workers_import

OPEN, ROLE, ROLE_END, CLOSE = "<s>", "[ROLE]", "[/ROLE]", "</s>"
#: Tokens that one attachment expands to, by part type: (fixed, per unit of ``size``).
EXPANSION = {"image": (64, 1 / 256), "audio": (8, 1 / 20), "document": (4, 1 / 4)}
LOSS_ROLES = ("assistant",)
_ESCAPED = re.compile(r"[\\<\[]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: One turn of formatted text; an escaped character never opens or closes a mark.
_TURN = re.compile(r"<s>\[ROLE\]((?:\\.|[^\\\[<])*)\[/ROLE\]((?:\\.|[^\\\[<]|<\||\[\|)*?)</s>", re.DOTALL)

#: Fixed value: the kind of an attachment by the ending of its file.
KINDS = {
    "image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff"),
    "audio": ("wav", "mp3", "ogg", "flac", "m4a"),
    "document": ("pdf", "docx", "odt", "csv", "xlsx"),
}
_KIND = {ending: kind for kind, endings in KINDS.items() for ending in endings}
_REFERENCE = re.compile(r"!?\[[^\[\]\n]*\]\(([^()\s]+)\)")
#: In a turn's body: an escaped character, or a placeholder.
_MARKED = re.compile(r"\\(.)|<\|((?:\\.|[^\\<\[])*?):(\d+)\|>", re.DOTALL)

PART = "type string, text string, ref string, size long"
PIECES = "conv_id long, turn long, role string, piece string, loss_start long, loss_end long, attachments array<struct<placeholder:string,type:string,ref:string,source:string,tokens:long>>"


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text) if "\\" in text else text


def content_parts(text: str | None) -> list[dict]:
    """The typed parts of a text, whose texts joined are the text: references to files of known kinds, and what is between."""
    text, parts, at = text or "", [], 0
    for m in _REFERENCE.finditer(text) if "](" in text else ():
        kind = _KIND.get(re.split(r"[?#]", m[1])[0].rpartition(".")[2].lower())
        if kind:
            parts += [{"type": "text", "text": text[at : m.start()]}] * (m.start() > at)
            parts.append({"type": kind, "text": m[0], "ref": m[1]})
            at = m.end()
    return [*parts, {"type": "text", "text": text[at:]}] if at < len(text) or not parts else parts


@dataclass
class Flattener:
    """Visitor over content parts; placeholders are numbered in order of appearance within a turn."""

    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_attachment)(part or {})

    def visit_text(self, part: dict) -> None:
        self.text.append(escape(part.get("text") or ""))

    def visit_attachment(self, part: dict) -> None:
        kind = part["type"]
        fixed, each = EXPANSION.get(kind, (1, 0))
        mark = f"<|{escape(kind)}:{len(self.attachments)}|>"
        self.text.append(mark)
        self.attachments.append({"placeholder": mark, "type": kind, "ref": part.get("ref"), "source": part.get("text"), "tokens": fixed + int((part.get("size") or 0) * each)})

    visit_image = visit_audio = visit_document = visit_attachment


def format_turn(role: str | None, parts: list[dict] | None, loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, int, int, list[dict]]:
    """The turn's piece, the half-open span of code points of it that bears loss, and its attachments."""
    seen = Flattener()
    for part in parts or []:
        seen.visit(part)
    head = f"{OPEN}{ROLE}{escape(role or '')}{ROLE_END}"
    body = "".join(seen.text)
    start, end = (len(head), len(head) + len(body)) if role in loss_roles else (len(head), len(head))
    return f"{head}{body}{CLOSE}", start, end, seen.attachments


def split_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, body as formatted) of each turn of formatted text; raises ``ValueError`` where it is not the template's."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), m[2]))
        at = m.end()
    return out


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, placeholders as they stand; ``read_parts`` tells them from texts."""
    return [(role, unescape(body)) for role, body in split_turns(formatted)]


def read_parts(body: str) -> list[tuple[str, str | int]]:
    """The parts of a turn's body as formatted: ``("text", text)``, or an attachment's type and number."""
    out: list[tuple[str, str | int]] = []
    text, at = [], 0
    for m in _MARKED.finditer(body):
        text.append(body[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text.append(m[1])
        else:
            out += [("text", "".join(text))] * any(text) + [(unescape(m[2]), int(m[3]))]
            text = []
    text.append(body[at:])
    return out + [("text", "".join(text))] * any(text)


def restored(body: str, attachments: list[dict]) -> str:
    """The source text of a turn's body: a placeholder is what it stands for, or itself if that has no text."""
    if not attachments:
        return unescape(body)
    source = lambda n: attachments[n].get("source") or attachments[n]["placeholder"]
    return "".join(x if isinstance(x, str) else source(x) for _, x in read_parts(body))


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Pieces of formatted text, one row a turn (``PIECES``); ``parts`` is an array of structs as ``PART``. Narrow."""
    workers_import(turns.sparkSession)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(parts).alias("parts"))
    kinds = [("placeholder", pa.string()), ("type", pa.string()), ("ref", pa.string()), ("source", pa.string()), ("tokens", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turn(r.as_py(), p.as_py()) for r, p in zip(b.column(2), b.column(3), strict=True)]
            cols = [pa.array(x, t) for x, t in zip(zip(*made, strict=True) if made else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct(kinds))), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["conv_id", "turn", "role", "piece", "loss_start", "loss_end", "attachments"])

    return rows.mapInArrow(run, PIECES)


def text_parts(text: str = "text"):
    """A plain text column as the one part of its turn."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), none.alias("ref"), F.lit(None).cast("long").alias("size")))


def typed_parts(text: str = "text"):
    """The typed parts of a plain text column."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("size", pa.int64())]))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([content_parts(t.as_py()) for t in texts], kind)

    return F.arrow_udf(run, f"array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>")(F.col(text).cast("string"))


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by conversation, in order; only running digests of the current one are kept."""
    now, state = object(), None
    names = _DIGESTS.replace(" long", "").replace(" string", "").split(", ")

    def row() -> list:
        return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

    for b in batches:
        done = []
        for conv, piece, start, end, files in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if state is None or conv != now:
                if state is not None:
                    done.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[4] += len(piece)
            for role, body in split_turns(piece):
                state[0] += 1
                state[1].update(f"{role}\n{restored(body, files)}\n".encode("utf-8", "surrogatepass"))
            lost = restored(piece[start:end], files)
            state[2] += len(lost)
            state[3].update(lost.encode("utf-8", "surrogatepass"))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=_arrow_digests())
    if state is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, row(), strict=True))], schema=_arrow_digests())


def _arrow_digests() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _DIGESTS.split(", ")])


def digests(pieces: DataFrame) -> DataFrame:
    """What each conversation's formatted text says when read back; a placeholder counts as the text it stands for."""
    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    return rows.select("conv_id", "piece", "loss_start", "loss_end", "attachments").mapInArrow(_read_back, _DIGESTS)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = reduce(DataFrame.unionByName, [turns, more]).withColumn("parts", typed_parts())
    return digests(format_turns(turns))


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(regexp_replace(role, '([\\<\[])', '\\\1', 'g')) + length(regexp_replace(text, '([\\<\[])', '\\\1', 'g')) + 20) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
