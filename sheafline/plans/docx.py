"""DOCX files made of conversations, read as blocks; what is in them and not read is counted."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.plans.items import table
from sheafline.sources import docx_blocks

#: Files of one batch.
FILES = 64
HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    ' xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>'
)


def _drawing(name):
    return F.concat(F.lit('<w:r><w:drawing><a:blip r:embed="'), name, F.lit('"/></w:drawing></w:r>'))


def zipped(docs: DataFrame) -> DataFrame:
    """(path, content) of (path, xml, broken): the XML as a DOCX file, a few files at a time; a broken one holds no zip."""

    def one(x: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", x)
        return out.getvalue()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, FILES):
                some = batch.slice(lo, FILES)
                made = [b"no zip" if broken.as_py() else one(xml.as_py()) for xml, broken in zip(some.column("xml"), some.column("broken"), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("path"), pa.array(made, pa.binary())], ["path", "content"])

    return docs.select("path", "xml", "broken").mapInArrow(run, "path string, content binary")


def _files(spark, sf_dir):
    """(path, content): a file a conversation; turns as paragraphs, with bold roles, headings, images, blank lines, page breaks, tables and text boxes. Every 20th is broken."""
    c, s = table(spark, sf_dir, "conversations").where(F.length(F.trim("text")) > 0), F.lit
    said = T.collapse(F.col("text"))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        said = F.replace(said, s(raw), s(safe))
    t = F.col("turn")
    paragraph = F.concat(
        F.when(t % 4 == 1, "<w:p/>").otherwise(""), s("<w:p>"), F.when(F.col("role") == "system", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>').otherwise(""),
        s("<w:r><w:rPr><w:b/></w:rPr><w:t>"), F.col("role"), s('</w:t></w:r><w:r><w:t xml:space="preserve"> '), said, s("</w:t></w:r>"),
        F.when(t % 5 == 3, _drawing(F.concat(s("r"), t.cast("string")))).otherwise(""), F.when(t % 7 == 4, '<w:r><w:br w:type="page"/></w:r>').otherwise(""), s("</w:p>"),
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", paragraph.alias("p")))), lambda x: x.p), "")
    more = F.when(F.col("conv_id") % 6 == 0, F.concat(s("<w:tbl><w:tr><w:tc><w:p>"), _drawing(s("t")), s("</w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:pict><w:txbxContent><w:p>"), _drawing(s("x")), s("</w:p></w:txbxContent></w:pict></w:r></w:p>"))).otherwise("")
    d = c.groupBy("conv_id").agg(body.alias("body"))
    xml = F.concat(s(HEAD), "body", more, s("</w:body></w:document>"))
    return zipped(d.select(F.col("conv_id").cast("string").alias("path"), xml.alias("xml"), (F.col("conv_id") % 20 == 7).alias("broken")))


def docx_rows(spark, sf_dir):
    found = docx_blocks.blocks(_files(spark, sf_dir))
    return found.select(
        "file", "pos", "kind", "block_id", "paragraph", F.md5("text").alias("md5"), "style", F.size("bold").cast("long").alias("n_bold"), "blank_before", "page_break_before",
        F.array_join("media", ",").alias("media"),
    )


_ROWS = r"""
WITH c AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, lag(turn) OVER w AS before, sum((turn % 4 = 1)::INT + 1) OVER w AS paragraph, conv_id % 6 = 0 AS more, conv_id % 20 = 7 AS broken,
    role || ' ' || trim(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g')) AS said
  FROM conversations WHERE length(trim(text)) > 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (
  SELECT conv_id, turn, 1 AS part, CASE WHEN role = 'system' THEN 'heading' ELSE 'paragraph' END AS kind, paragraph, said AS text, CASE WHEN role = 'system' THEN 'Heading1' ELSE '' END AS style, 1 AS n_bold,
    (turn % 4 = 1)::INT AS blank_before, coalesce(before % 7 = 4, false) AS page_break_before, '' AS media FROM c WHERE NOT broken
  UNION ALL SELECT conv_id, turn, 2, 'image', paragraph, '', CASE WHEN role = 'system' THEN 'Heading1' ELSE '' END, 0, 0, false, 'r' || turn FROM c WHERE NOT broken AND turn % 5 = 3
  UNION ALL SELECT conv_id, turn, 3, 'image', paragraph + 1, '', '', 0, 0, turn % 7 = 4, 'x' FROM c WHERE NOT broken AND more AND k = n
  UNION ALL SELECT conv_id, turn, 4, 'break', NULL, '', '', 0, 0, true, '' FROM c WHERE NOT broken AND NOT more AND k = n AND turn % 7 = 4
  UNION ALL SELECT DISTINCT conv_id, 0, 0, 'broken', NULL::HUGEINT, '', '', 0, 0, false, '' FROM c WHERE broken)
"""
ROWS = _ROWS + """
SELECT CAST(conv_id AS VARCHAR) AS file, row_number() OVER w AS pos, kind,
  CASE kind WHEN 'image' THEN 'img-' || lpad(sum((kind = 'image')::INT) OVER w::VARCHAR, 4, '0') WHEN 'break' THEN 'br-0001' WHEN 'broken' THEN NULL ELSE 'p-' || lpad(sum((kind IN ('heading', 'paragraph'))::INT) OVER w::VARCHAR, 4, '0') END AS block_id,
  paragraph, md5(text) AS md5, style, n_bold, blank_before, page_break_before, media FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, part)
"""


def unread_media(spark, sf_dir):
    return docx_blocks.unsupported_media(_files(spark, sf_dir))


UNREAD = """
SELECT CAST(conv_id AS VARCHAR) AS file, CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS tables, CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS text_boxes,
  count(*) FILTER (turn % 5 = 3) + CASE WHEN conv_id % 6 = 0 THEN 2 ELSE 0 END AS images, CASE WHEN conv_id % 6 = 0 THEN 2 ELSE 0 END AS drawings
FROM conversations WHERE length(trim(text)) > 0 AND conv_id % 20 <> 7 GROUP BY conv_id
"""


def docx_scan(spark, sf_dir):
    """Blocks numbered over all kinds, with the paragraph that they stand in and their bold text."""
    return docx_blocks.scanned(docx_blocks.blocks(_files(spark, sf_dir))).select("file", "block_id", "paragraph_id", "kind", F.md5("text").alias("md5"), "bold_text")


SCAN = _ROWS + """
SELECT CAST(r.conv_id AS VARCHAR) AS file, 'b' || lpad(row_number() OVER (PARTITION BY r.conv_id ORDER BY r.turn, part)::VARCHAR, 4, '0') AS block_id, 'p' || lpad(r.paragraph::VARCHAR, 4, '0') AS paragraph_id, kind, md5(r.text) AS md5,
  CASE WHEN kind = 'image' THEN '' ELSE c.role END AS bold_text FROM r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.turn WHERE kind IN ('heading', 'paragraph', 'image')
"""


QUERIES = {f.__name__: f for f in (docx_rows, unread_media, docx_scan)}
ORACLES = {"docx_rows": ROWS, "unread_media": UNREAD, "docx_scan": SCAN}
