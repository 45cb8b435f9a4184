"""Blocks of DOCX files, in reading order, and what such a file holds that is not read.

Files come as rows (path, content): from binaryFile, which opens whatever file system Spark reads, or from any table. A file
is a zip of XML and one row's work; files are dealt out by Spark.

Text, line breaks, page and section breaks and bold stretches come from the runs of the body's paragraphs; drawings give
image rows where they stand. A break at the end of a file gives a row of its own. Tables and text boxes are not read: their drawings
are counted by unsupported_media(). A file that is no DOCX gives one row of kind "broken".
"""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.functions.text import collapse

SCHEMA = (
    "file string, pos int, kind string, block_id string, paragraph int, text string, style string, bold array<struct<start:int,end:int>>, "
    "blank_before int, page_break_before boolean, section_break_before boolean, media array<string>"
)
COLUMNS = ["file", "pos", "kind", "block_id", "paragraph", "text", "style", "bold", "blank_before", "page_break_before", "section_break_before", "media"]
ARROW = pa.schema(
    [
        ("file", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("block_id", pa.string()), ("paragraph", pa.int32()), ("text", pa.string()), ("style", pa.string()),
        ("bold", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("blank_before", pa.int32()), ("page_break_before", pa.bool_()), ("section_break_before", pa.bool_()), ("media", pa.list_(pa.string())),
    ]
)
COUNTS = pa.schema([("file", pa.string()), *((c, pa.int32()) for c in ("tables", "text_boxes", "images", "drawings"))])
#: Rows of one batch that a task gives back.
ROWS = 1000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Starts of heading styles, prefixes of ids by kind.
HEADINGS = ("heading", "заголовок")
PREFIX = {"heading": "p", "paragraph": "p", "image": "img", "break": "br"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the DOCX files below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path).select("path", "content")


def _pieces(paragraph) -> Iterator[tuple[str, str, bool]]:
    """("text" | "image" | "page", value, bold) of a paragraph's own runs, in order."""
    for run in paragraph.findall(f"{W}r"):
        weight = run.find(f"{W}rPr/{W}b")
        bold = weight is not None and weight.get(f"{W}val", "1") not in ("0", "false")
        for node in run:
            if node.tag == f"{W}t":
                yield "text", node.text or "", bold
            elif node.tag == f"{W}tab":
                yield "text", "\t", bold
            elif node.tag == f"{W}cr" or node.tag == f"{W}br" and node.get(f"{W}type") != "page":
                yield "text", "\n", bold
            elif node.tag == f"{W}br":
                yield "page", "", bold
            else:
                for drawing in node.iter(f"{W}drawing"):
                    for blip in drawing.iter(f"{A}blip"):
                        yield "image", blip.get(f"{R}embed", ""), bold


def _body(data: bytes):
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None


def blocks_of(name: str, data: bytes | None) -> Iterator[tuple]:
    """Rows of one file."""
    body = _body(data or b"")
    if body is None:
        yield (name, 1, "broken", None, None, "", "", [], 0, False, False, [])
        return
    n, pos = {"p": 0, "img": 0, "br": 0}, 0
    blanks, page, section = 0, False, False

    def row(kind: str, at: int | None, text: str, style: str, bold: list, media: list) -> tuple:
        nonlocal pos, blanks, page, section
        prefix = PREFIX[kind]
        pos, n[prefix] = pos + 1, n[prefix] + 1
        out = (name, pos, kind, f"{prefix}-{n[prefix]:04d}", at, text, style, bold, blanks, page, section, media)
        blanks, page, section = 0, False, False
        return out

    for at, paragraph in enumerate(body.findall(f"{W}p"), start=1):
        style = paragraph.find(f"{W}pPr/{W}pStyle")
        style = style.get(f"{W}val", "") if style is not None else ""
        kind = "heading" if style.lower().startswith(HEADINGS) else "paragraph"
        text, bold, seen = "", [], False
        for piece, value, strong in [*_pieces(paragraph), ("end", "", False)]:
            if piece == "text":
                if strong and value:
                    bold.append({"start": len(text), "end": len(text) + len(value)})
                text += value
                continue
            if text.strip():
                seen = True
                yield row(kind, at, text, style, bold, [])
            text, bold = "", []
            if piece == "image":
                seen = True
                yield row("image", at, "", style, [], [value])
            elif piece == "page":
                page = seen = True
        blanks += not seen
        section = section or paragraph.find(f"{W}pPr/{W}sectPr") is not None
    if page or section:
        yield row("break", None, "", "", [], [])


def _one_by_one(batches) -> Iterator[tuple[str, bytes | None]]:
    """(path, content) of the files of Arrow batches; one content at a time becomes a Python object."""
    for batch in batches:
        for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
            yield name.as_py(), data.as_py()


def _in_batches(rows: Iterator[tuple], names: list[str], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ROWS."""
    while some := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in some], kinds)


def blocks(docs: DataFrame) -> DataFrame:
    """SCHEMA rows of files (path, content)."""

    def cut(batches):
        rows = (row for name, data in _one_by_one(batches) for row in blocks_of(name, data))
        yield from _in_batches(rows, COLUMNS, ARROW)

    return docs.select("path", "content").mapInArrow(cut, SCHEMA)


def unsupported_media(docs: DataFrame) -> DataFrame:
    """(file, tables, text_boxes, images, drawings): how much of a file is not read; drawings count those in tables and those in text boxes."""

    def counted(batches):
        for name, data in _one_by_one(batches):
            body = _body(data or b"")
            if body is None:
                continue
            tables, boxes = body.findall(f"{W}tbl"), list(body.iter(f"{W}txbxContent"))
            drawn = lambda of: sum(1 for x in of for _ in x.iter(f"{W}drawing"))
            yield name, len(tables), len(boxes), sum(1 for _ in body.iter(f"{W}drawing")), drawn(tables) + drawn(boxes)

    def count(batches):
        yield from _in_batches(counted(batches), [f.name for f in COUNTS], COUNTS)

    return docs.select("path", "content").mapInArrow(count, "file string, tables int, text_boxes int, images int, drawings int")


def paragraphs(found: DataFrame) -> DataFrame:
    """Blocks for operators.blocks: (document, pos, kind, text, bold_text, blank_before, is_heading); texts collapsed, breaks left out."""
    bold = F.array_join(F.transform("bold", lambda b: F.substring(F.col("text"), b["start"] + 1, b["end"] - b["start"])), "")
    image = F.col("kind") == "image"
    return found.where(F.col("kind").isin("heading", "paragraph", "image")).select(
        F.col("file").alias("document"), "pos", F.when(image, "image").otherwise("text").alias("kind"), F.when(image, F.get("media", F.lit(0))).otherwise(collapse(F.col("text"))).alias("text"),
        collapse(bold).alias("bold_text"), "blank_before", (F.col("kind") == "heading").alias("is_heading"),
    )


def prepared(found: DataFrame) -> DataFrame:
    """Blocks for operators.prepare: (document, pos, kind, text, bold, page_break, media)."""
    return found.where("kind <> 'broken'").select(
        F.col("file").alias("document"), "pos", "kind", "text", (F.size("bold") > 0).alias("bold"), F.col("page_break_before").alias("page_break"), "media"
    )


def scanned(found: DataFrame) -> DataFrame:
    """(file, block_id, paragraph_id, kind, text, bold_text, media): blocks numbered over all kinds, images with the paragraph they stand in."""
    bold = F.array_join(F.transform("bold", lambda b: F.substring(F.col("text"), b["start"] + 1, b["end"] - b["start"])), "")
    place = F.row_number().over(Window.partitionBy("file").orderBy("pos"))
    numbered = found.where(F.col("kind").isin("heading", "paragraph", "image")).withColumn("place", place)
    return numbered.select(
        "file", F.concat(F.lit("b"), F.lpad(F.col("place").cast("string"), 4, "0")).alias("block_id"), F.concat(F.lit("p"), F.lpad(F.col("paragraph").cast("string"), 4, "0")).alias("paragraph_id"), "kind", "text", bold.alias("bold_text"), "media"
    )
