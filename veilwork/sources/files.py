"""File sources and sinks.

Documents are read with Spark's binary source, so any store that Spark reads will do; text and Markdown are decoded by
expressions, DOCX and PDF by an Arrow function over the bytes of a file. What cannot be read is a row with its reason,
never a failed job. A document's key is its path below the folder that was read, so equal names in two folders are two documents.
Masked texts go to a table, or to one file per document, which the executors write in the documents' own tasks.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from veilwork.functions import values
from veilwork.operators import codes

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_READ = "struct<text:string,error:string>"


def _paragraph(p: ElementTree.Element) -> str:
    shown = {f"{_W}t": None, f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
    return "".join((x.text or "") if shown[x.tag] is None else shown[x.tag] for x in p.iter() if x.tag in shown)


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, then every table row with its cells joined by tabs; a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = [_paragraph(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            lines.append("\t".join("\n".join(_paragraph(p) for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")))
    return "\n".join(lines)


def pdf_pages(content: bytes) -> list[str]:
    """Page texts; needs the optional ``pypdf``."""
    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def pdf_text(content: bytes, pages=pdf_pages) -> tuple[str | None, str | None]:
    """(text, error): a document with next to no text a page is a scan, and refused."""
    got = pages(content)
    text = "\n\n".join(got)
    shown = len(text.strip())
    if got and shown < values.SCANNED_BELOW * len(got):
        return None, f"PDF sans texte : {shown} caractere(s) sur {len(got)} page(s)"
    return text, None


def _read_binary(kinds: pa.Array, contents: pa.Array) -> pa.Array:
    out = []
    for kind, content in zip(kinds.to_pylist(), contents, strict=True):
        text = error = None
        if kind in (".docx", ".pdf"):
            try:
                text, error = (docx_text(content.as_py()), None) if kind == ".docx" else pdf_text(content.as_py())
            except ImportError:
                error = "lecteur PDF absent"
            except Exception as e:  # a broken file is a row with its reason
                error = f"illisible : {type(e).__name__}"
        out.append({"text": text, "error": error})
    return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))


def read_documents(spark: SparkSession, path: str, rich: bool = True) -> DataFrame:
    """``(path, text, error)`` of all files under ``path``; ``error`` says why there is no text.

    ``rich``: whether DOCX and PDF are wanted; without them no Python runs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kind = F.lower(F.regexp_extract("path", "[^/](\\.[^./]+)$", 1))
    files = files.withColumn("kind", kind)
    plain = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    known = ", ".join(values.FORMATS)
    bad = F.format_string("Format %s non pris en charge. Formats acceptes : %s.", F.when(F.col("kind") == "", "inconnu").otherwise(F.col("kind")), F.lit(known))
    text, error = F.when(F.col("kind").isin(".txt", ".md"), plain), F.when(~F.col("kind").isin(*values.FORMATS), bad)
    if rich:
        files = files.withColumn("_r", F.arrow_udf(_read_binary, _READ)("kind", F.when(F.col("kind").isin(".docx", ".pdf"), F.col("content"))))
        text, error = F.coalesce(text, "_r.text"), F.coalesce(error, "_r.error")
    else:
        error = F.coalesce(error, F.when(F.col("kind").isin(".docx", ".pdf"), "format non demande"))
    return files.select("path", text.alias("text"), error.alias("error"))


def readable(files: DataFrame) -> DataFrame:
    return files.where("error IS NULL").select("path", "text")


def rejects(files: DataFrame) -> DataFrame:
    return files.where("error IS NOT NULL").select("path", F.col("error").alias("reason"))


def key_below(spark: SparkSession, path: Column, root: str) -> Column:
    """The path of a file below ``root``, a folder or the file itself; what is not below it keeps its whole path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/") + "/"
    plain = F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    name = F.regexp_extract(plain, "([^/]*)$", 1)
    return F.when(F.startswith(plain, F.lit(at)), F.substring(plain, F.lit(len(at) + 1), F.length(plain))).when(plain == at.rstrip("/"), name).otherwise(plain)


def output_name(path: Column, suffix: str) -> Column:
    """``name.ext`` becomes ``name.ext<suffix>``."""
    return F.concat(F.regexp_extract(path, "([^/]*)$", 1), F.lit(suffix))


MASKED_SUFFIX, RESTORED_SUFFIX = ".pseudonymise.txt", ".reinjecte.txt"


def write_masked(masked: DataFrame, path: str) -> None:
    """Masked texts as a table (Parquet), without any original value."""
    masked.select("path", output_name(F.col("path"), MASKED_SUFFIX).alias("name"), "masked_text").write.mode("errorifexists").parquet(path)


def write_files(texts: DataFrame, folder: str, key_col: str, text_col: str, suffix: str) -> None:
    """One UTF-8 file ``folder/<key><suffix>`` per row, written by the executors; a task that runs again writes the same files.

    ``folder`` is a path or address that all executors share; keys are paths below it and must differ.
    """

    def run(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        for key, text in rows:
            store, at = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
            at = f"{at.rstrip('/')}/{key.lstrip('/')}{suffix}"
            store.create_dir(at.rpartition("/")[0], recursive=True)
            half = f"{at}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(half) as f:
                f.write((text or "").encode())
            store.move(half, at)

    texts.select(key_col, text_col).foreachPartition(run)


def new_run() -> str:
    """The name of a run: its time, and what tells it from others of the same second."""
    return f"{datetime.now(UTC):%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}"


def protect(spark: SparkSession, path: str) -> None:
    """Leave a folder to its owner alone, where the store knows permissions."""
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).setPermission(at, fs.permission.FsPermission("700"))


def write_tables(masked: DataFrame, path: str, key: str = "doc_id", run: str | None = None) -> str:
    """Code tables as JSON lines ``(key, table)`` under ``run=``, whose name is returned; they hold the original values.

    The folder is left to its owner alone, where the store knows permissions.
    """
    run = run or new_run()
    created = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.expr("current_timezone()")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    out = masked.select(key, codes.to_json(F.col("code_table"), created).alias("table"))
    out.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").json(path)
    protect(masked.sparkSession, path)
    return run


def read_tables(spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "long", run: str | None = None) -> DataFrame:
    """``(key, code_table)`` of one run's stored tables, the latest by name unless ``run`` is given.

    A key with several tables in a run is an error: which of them a reply belongs to cannot be told.
    """
    rows = spark.read.schema(f"{key} {key_type}, table string, run string").json(path)
    run = run or rows.agg(F.max("run")).first()[0]
    one = rows.where(F.col("run") == run).groupBy(key).agg(F.count("*").alias("n"), F.first("table").alias("table"))
    several = F.raise_error(F.concat(F.lit("several code tables of one run for "), F.col(key).cast("string"))).cast("string")
    return one.select(key, codes.from_json(F.when(F.col("n") == 1, F.col("table")).otherwise(several)).alias("code_table"))


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """``(path, reply, name, error)`` of reply files; ``name`` is that of the restored text.

    Replies are strictly UTF-8: one that is not has no text but a reason.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.concat(F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.[^.]*$", ""), F.lit(RESTORED_SUFFIX))
    reply = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", reply.alias("reply"), name.alias("name"), F.when(reply.isNull(), "pas de l'UTF-8").alias("error"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(name, directs, indirects)`` of an annotation file."""
    kind = "documents map<string,struct<directs:map<string,array<string>>,indirects:array<string>>>"
    rows = spark.read.schema(kind).option("multiLine", "true").json(path).select(F.explode("documents").alias("name", "t"))
    return rows.select("name", "t.directs", F.coalesce("t.indirects", F.array().cast("array<string>")).alias("indirects"))


def read_cases(spark: SparkSession, path: str, groups: tuple[str, ...] = ("annoncees", "typees", "nues", "pieges")) -> DataFrame:
    """``(group, id, phrase, references)`` of a file of reference cases; traps have no references."""
    kind = ", ".join(f"{g} array<struct<id:string,phrase:string,references:array<string>>>" for g in groups)
    doc = spark.read.schema(kind).option("multiLine", "true").json(path)
    parts = [doc.select(F.lit(g).alias("group"), F.inline(g)) for g in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


def read_listed_cases(spark: SparkSession, path: str) -> DataFrame:
    """``(section, phrase, expected)`` of a Markdown sheet: in fenced blocks ``+ text => a ; b`` or ``- text``, ``\\n`` for a line end."""
    sheet = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines"))
    start = F.struct(F.lit("").alias("section"), F.lit(False).alias("fenced"), F.array().cast("array<struct<section:string,line:string>>").alias("out"))

    def step(a, x):
        fence = F.startswith(x, F.lit("```"))
        heading = ~a["fenced"] & F.startswith(x, F.lit("## "))
        case = a["fenced"] & ~fence & x.rlike("^[+-] ")
        return F.struct(
            F.when(heading, F.substring(x, F.lit(4), F.length(x))).otherwise(a["section"]).alias("section"),
            F.when(fence, ~a["fenced"] & F.startswith(x, F.lit("```cas"))).otherwise(a["fenced"]).alias("fenced"),
            F.when(case, F.array_append(a["out"], F.struct(a["section"].alias("section"), x.alias("line")))).otherwise(a["out"]).alias("out"),
        )

    rows = sheet.select(F.inline(F.aggregate("lines", start, step, lambda a: a["out"])))
    parts = F.split(F.substring("line", 3, 1_000_000), " => ", 2)
    want = F.transform(F.split(F.get(parts, 1), " ; "), lambda w: F.trim(w))
    return rows.select("section", F.replace(F.get(parts, 0), F.lit("\\n"), F.lit("\n")).alias("phrase"), F.when(F.startswith("line", F.lit("+")), want).otherwise(F.array().cast("array<string>")).alias("expected"))
