"""Files as uploaded: text, word-processor documents, archives of notes, pipe-separated tables; and files as exported."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import strings as S
from .tables import decoded

# Limits of an upload, and the name space of word-processor documents.
MAX_BYTES, MAX_XML_BYTES = 20 * 1024 * 1024, 50 * 1024 * 1024
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
READ = StructType([StructField("text", StringType()), StructField("error", StringType())])


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def upload_error(name: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """Why a file can't be taken: its size, then its kind; null if it can."""
    return F.when(size > most, "too large").when(~extension(name).isin("txt", "docx", "pdf"), "unsupported")


def _paragraph(p) -> str:
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    return "".join(e.text or "" if e.tag == f"{WORD}t" else marks.get(e.tag, "") for e in p.iter())


def document_text(data: bytes) -> tuple[str | None, str | None]:
    """Paragraphs and rows of tables in order, cells with tabs between; (None, reason) for what can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if z.getinfo("word/document.xml").file_size > MAX_XML_BYTES:
                return None, "too large"
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, "not readable"
    lines: list[str] = []
    for e in body if body is not None else []:
        if e.tag == f"{WORD}p":
            lines.append(_paragraph(e))
        elif e.tag == f"{WORD}tbl":
            lines += ["\t".join(" ".join(_paragraph(p) for p in c.iter(f"{WORD}p")).strip() for c in r.iter(f"{WORD}tc")) for r in e.iter(f"{WORD}tr")]
    return "\n".join(lines), None


def page_text(data: bytes) -> tuple[str | None, str | None]:
    """Text of a PDF's pages, if a reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None, "no reader installed"
    try:
        reader = PdfReader(io.BytesIO(data))
        if reader.is_encrypted and not reader.decrypt(""):
            return None, "password"
        text = "\n\n".join(p.extract_text() or "" for p in reader.pages)
    except Exception as e:  # a reader's errors have many types; each is reported by name
        return None, f"not readable: {type(e).__name__}"
    return (text, None) if text.strip() else (None, "no text layer")


@F.pandas_udf(READ)
def read_binary(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    readers = {"docx": document_text, "pdf": page_text}
    rows = [readers[k](c) if k in readers and c is not None else (None, None) for k, c in zip(kind, content, strict=True)]
    return pd.DataFrame(rows, columns=["text", "error"])


def notes_of(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """(name, text, error) of uploaded files (name, content): a tidy text, or why there is none."""
    rows = files.withColumns({"kind": extension(F.col("name")), "refused": upload_error(F.col("name"), F.length("content"), most)})
    binary = F.when(F.col("refused").isNull() & F.col("kind").isin("docx", "pdf"), F.col("kind"))
    rows = rows.withColumn("read", read_binary(binary, F.col("content")))
    text = F.when(F.col("refused").isNull(), F.when(F.col("kind") == "txt", decoded(F.col("content"))).otherwise(F.col("read.text")))
    rows = rows.withColumn("text", S.tidy(text))
    empty = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \n\t")) == ""
    error = F.coalesce("refused", "read.error", F.when(empty, "empty"))
    return rows.select("name", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = {n for n in z.namelist() if not n.startswith("__MACOSX") and not n.rsplit("/", 1)[-1].startswith(".")}
                for name in sorted(n for n in names if n.endswith(".txt") and n[:-4] + ".ann" in names):
                    one = [path, name.rsplit("/", 1)[-1][:-4], z.read(name).decode("utf-8"), z.read(name[:-4] + ".ann").decode("utf-8")]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in one], ["archive", "note_id", "text", "ann"])


def note_archives(spark: SparkSession, pattern: str, split: str) -> DataFrame:
    """(archive, note_id, text, ann, split): pairs of a text and its annotations in zip archives, a task for each archive; other members are left out."""
    rows = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return rows.mapInArrow(_members, "archive string, note_id string, text string, ann string").withColumn("split", F.lit(split))


def all_splits(spark: SparkSession, patterns: dict[str, str]) -> DataFrame:
    out = None
    for split, pattern in patterns.items():
        one = note_archives(spark, pattern, split)
        out = one if out is None else out.unionByName(one)
    return out


def pipe_table(spark: SparkSession, path: str, columns: dict[int, str]) -> DataFrame:
    """Columns of a pipe-separated table without a header, by their places."""
    width = max(columns) + 1
    rows = spark.read.schema(", ".join(f"_c{i} string" for i in range(width))).option("sep", "|").option("quote", "").csv(path)
    return rows.select(*(F.col(f"_c{i}").alias(name) for i, name in columns.items()))


def concept_names(spark: SparkSession, path: str) -> DataFrame:
    """(rxcui, tty, name) of a table of concept names, those of its own vocabulary."""
    return pipe_table(spark, path, {0: "rxcui", 11: "sab", 12: "tty", 14: "name"}).filter("sab = 'RXNORM'").select("rxcui", "tty", S.norm(F.col("name")).alias("name"))


def concept_relations(spark: SparkSession, path: str) -> DataFrame:
    """(rxcui1, rxcui2, rela): forms and trade names of ingredients; a row reads rxcui2 rela rxcui1."""
    rows = pipe_table(spark, path, {0: "rxcui1", 4: "rxcui2", 7: "rela", 10: "sab"})
    return rows.filter((F.col("sab") == "RXNORM") & F.col("rela").isin("form_of", "tradename_of")).select("rxcui1", "rxcui2", "rela")


def whole_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the text files of a folder, each as one note under its title."""
    rows = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_extract("_metadata.file_name", r"([^/]+)\.txt$", 1).alias("stem"), F.col("value").alias("text"))
    return rows.select(S.pretty(F.col("stem")).alias("name"), "text")


def export_csv(log: DataFrame, order: str, path: str) -> None:
    """A log as CSV, newest first, with cells that no spreadsheet takes for formulas; files follow the order by name."""
    safe = [S.csv_safe(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in log.dtypes]
    log.repartitionByRange(F.desc(order)).sortWithinPartitions(F.desc(order)).select(*safe).write.option("header", True).option("escape", '"').csv(path)


def export_json_lines(rows: DataFrame, path: str) -> None:
    """Each row as a line of JSON, nulls included."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def chat_examples(chunks: DataFrame, mentions: DataFrame, system: str) -> DataFrame:
    """(note_id, s, example): a chat for each chunk (note_id, s, e, text) with the rows (note_id, s, e, row) of the mentions that lie inside it; chunks without any are left out."""
    m = mentions.select("note_id", F.col("s").alias("m_s"), F.col("e").alias("m_e"), "row")
    inside = chunks.join(m, "note_id").filter("s <= m_s and m_e <= e")
    held = inside.groupBy("note_id", "s", "e", "text").agg(F.transform(F.array_sort(F.collect_list(F.struct("m_s", "m_e", "row"))), lambda x: x["row"]).alias("meds"))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    answer = F.to_json(F.struct(F.col("meds")))
    return held.select("note_id", "s", F.to_json(F.struct(F.array(turn("system", F.lit(system)), turn("user", F.col("text")), turn("assistant", answer)).alias("messages"))).alias("example"))
