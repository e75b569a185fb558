"""Readers of uploaded files and of staged book payloads."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import strip_space

#: Name space and part of the word-processing format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PART = "word/document.xml"
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
BOOK_SCHEMA = "chapters array<struct<chapter: string, verses: array<struct<verse: string, text: string>>>>"


def decode_plain(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds text, engine, confidence: bytes as strict UTF-8 (1.0), else as Latin-1 (0.6). Null bytes have a null text."""
    good = F.expr(f"is_valid_utf8(cast({content} as string))")
    return rows.select(
        "*",
        F.when(good, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")).alias("text"),
        F.when(good, "text/utf-8").otherwise("text/latin-1").alias("engine"),
        F.when(good, 1.0).otherwise(0.6).alias("confidence"),
    )


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """path, text, engine, confidence of plain text files."""
    return decode_plain(spark.read.format("binaryFile").load(path).select("path", "content")).drop("content")


def docx_text(content: bytes) -> tuple[str | None, str | None]:
    """Text of a word-processing file, or what is wrong with it. The part is read as a stream of events, a paragraph at once."""
    lines: list[str] = []
    pieces: list[str] = []
    tabbed = False
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(_PART) as part:
            for _, node in ElementTree.iterparse(part):
                match node.tag.removeprefix(_W):
                    case "t":
                        pieces.append(node.text or "")
                    case "tab":
                        tabbed = True
                    case "p":
                        lines.append(("\t" if tabbed else "").join(pieces))
                        pieces, tabbed = [], False
                        node.clear()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return None, f"not a readable docx: {type(e).__name__}"
    text = "\n".join(lines).strip()
    return (text, None) if text else (None, "docx without text")


def docx_bytes(text: str) -> bytes:
    """A word-processing file with a paragraph for each line; what XML can't hold is left out."""
    body = []
    for line in text.split("\n"):
        runs = [f'<w:t xml:space="preserve">{escape(_NO_XML.sub("", x), {chr(13): "&#13;"})}</w:t>' for x in line.split("\t")]
        body.append(f"<w:p><w:r>{'<w:tab/>'.join(runs)}</w:r></w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(_PART, f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def stage(rows: DataFrame, folder: str, name: str, content: str, make=None) -> DataFrame:
    """Writes a file for each row below a folder that all machines share, on the executors; path and size of what was written.

    `make` turns a value into bytes, where it isn't bytes. Null values give no file. A file is written under its own name,
    so a task that runs again writes the same.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for n, x in zip(batch["n"], batch["x"], strict=True):
                if x is not None:
                    data = bytes(x) if make is None else make(x)
                    with fs.open_output_stream(f"{root}/{n}") as f:
                        f.write(data)
                    out.append((f"{folder}/{n}", len(data)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return rows.select(F.col(name).cast("string").alias("n"), F.col(content).alias("x")).mapInPandas(run, "path string, bytes long")


def read_bytes(spark: SparkSession, folder: str, names: DataFrame, column: str) -> DataFrame:
    """`names` with the content of the file that `column` names, null without one; a scan and a join, no file is looked up alone."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("__name"), "content")
    return names.join(files, names[column] == F.col("__name"), "left").drop("__name")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, text, confidence, error of word-processing files; bytes are parsed in Python, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [docx_text(bytes(b)) for b in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "text": [t for t, _ in parsed], "confidence": [1.0 if t else None for t, _ in parsed], "error": [e for _, e in parsed]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, confidence double, error string")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """path, chapter, verse, text, position of staged book payloads (JSON); numbers may be strings, texts are trimmed."""
    raw = spark.read.schema(BOOK_SCHEMA).option("multiLine", True).json(path).select(F.input_file_name().alias("path"), F.posexplode("chapters").alias("cp", "c"))
    each = raw.select("path", "cp", F.col("c.chapter").alias("chapter"), F.posexplode("c.verses").alias("vp", "v"))
    return each.select("path", F.col("chapter").try_cast("long").alias("chapter"), F.col("v.verse").try_cast("long").alias("verse"), F.coalesce(strip_space(F.col("v.text")), F.lit("")).alias("text"), F.struct("cp", "vp").alias("position"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a registry file {packs: [...]}."""
    schema = "packs array<struct<abbrev: string, name: string, slug: string, language: string, license: string, year: string, versification: string, blurb: string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("packs").alias("p")).select("p.*")


def read_book_lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The `fields` of each payload, chapter, verse and text of book payloads that are staged one a line."""
    raw = spark.read.schema(f"{fields}, {BOOK_SCHEMA}").json(path)
    names = [x.split()[0] for x in fields.split(", ")]
    each = raw.select(*names, F.explode("chapters").alias("c")).select(*names, F.col("c.chapter").alias("chapter"), F.explode("c.verses").alias("v"))
    return each.select(*names, F.col("chapter").try_cast("long").alias("chapter"), F.col("v.verse").try_cast("long").alias("verse"), F.coalesce(strip_space(F.col("v.text")), F.lit("")).alias("text"))


def settings(lines: DataFrame, column: str, refused: tuple[str, ...] = ()) -> DataFrame:
    """Adds key and value of lines of a .env file: blank lines, comments and refused keys are left out, one pair of quotes goes."""
    line = strip_space(F.col(column))
    rows = lines.where(~line.rlike("^(#|$)") & line.contains("="))
    rest = F.regexp_replace(line, "^export ", "")
    value = strip_space(F.expr("substr(__rest, instr(__rest, '=') + 1)"))
    out = rows.withColumn("__rest", rest).withColumn("key", strip_space(F.substring_index("__rest", "=", 1))).withColumn("value", F.regexp_replace(value, "^(['\"])(.*)\\1$", "$2"))
    return out.where(~F.col("key").isin(*refused) if refused else F.lit(True)).drop("__rest")
