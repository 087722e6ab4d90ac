"""Streaming forms, an extension: the analysis is stateless, numbering across documents of one case is not."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilwork.operators.codes import TABLE, number
from veilwork.plans.pipeline import analyse, pseudonymise


def pseudonymise_stream(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The batch plan on a stream: each document is coded on its own, so there is no state."""
    return pseudonymise(docs, text_col)


class _Cases(StatefulProcessor):
    """One code table a case; documents of a case are numbered in order of id within a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.codes = handle.getMapState("codes", "code string", "category string, vals array<string>, place int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = sorted((v[2], k[0], v[0], list(v[1])) for k, v in self.codes.iterator())
        docs = pd.concat(list(rows)).sort_values("doc_id")
        spans = [sorted(d.spans, key=lambda s: s["start"]) for d in docs.itertuples()]
        found = [(s["category"], s["text"]) for part in spans for s in part]
        codes, table = number(found, [{"code": c, "category": cat, "values": vals} for _, c, cat, vals in held])
        given, out, last = iter(codes), [], len(docs) - 1
        entries = [{"code": e["code"], "category": e["category"], "values": e["values"]} for e in table]
        for n, (d, part) in enumerate(zip(docs.itertuples(), spans, strict=True)):
            text, pieces, at = d.text or "", [], 0
            for s in part:
                pieces += [text[at : s["start"]], next(given)]
                at = s["end"]
            out.append((key[0], d.doc_id, "".join([*pieces, text[at:]]), entries if n == last else None))
        for place, e in enumerate(table):
            self.codes.updateValue((e["code"],), (e["category"], e["values"], place))
        yield pd.DataFrame(out, columns=["case_id", "doc_id", "masked_text", "code_table"])

    def close(self) -> None:
        pass


def pseudonymise_cases(docs: DataFrame) -> DataFrame:
    """Documents ``(case_id, doc_id, text)`` masked with one code table per case, which outlives micro-batches.

    The last document of a case in a micro-batch carries the case's table so far, so that what was masked can be restored:
    write ``code_table`` where tables are kept, apart from the masked texts. Needs the RocksDB state store.
    """
    spans = analyse(docs.select(F.col("case_id").cast("string"), F.col("doc_id").cast("long"), "text")).drop("flags")
    out = f"case_id string, doc_id long, masked_text string, code_table {TABLE}"
    return spans.groupBy("case_id").transformWithStateInPandas(_Cases(), out, "Append", "None")
