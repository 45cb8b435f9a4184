"""DOCX files on disk: breaks, tabs, bold, text boxes, broken files, and on to questions."""

import zipfile

from sheafline.operators import blocks, prepare
from sheafline.plans.docx import HEAD
from sheafline.sources import docx_blocks

BODY = (
    "<w:p><w:pPr><w:pStyle w:val='Заголовок1'/></w:pPr><w:r><w:t>Part</w:t><w:tab/><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t> </w:t></w:r></w:p>"
    "<w:p><w:pPr><w:sectPr/></w:pPr><w:r><w:t>About</w:t><w:br/><w:t>rivers</w:t><w:lastRenderedPageBreak/></w:r><w:r><w:drawing><a:blip r:embed='r1'/></w:drawing></w:r><w:r><w:t>after</w:t></w:r></w:p>"
    "<w:p><w:r><w:br w:type='page'/></w:r></w:p><w:p><w:r><w:t>Which is longer?</w:t></w:r></w:p>"
    "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>A) one</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b w:val='0'/></w:rPr><w:t>B) two</w:t></w:r></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:drawing><a:blip r:embed='t'/></w:drawing></w:r></w:p></w:tc></w:tr></w:tbl>"
    "<w:p><w:r><w:pict><w:txbxContent><w:p><w:r><w:t>boxed</w:t><w:drawing/></w:r></w:p></w:txbxContent></w:pict></w:r></w:p><w:p><w:r><w:br w:type='page'/></w:r></w:p>"
)


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "a.docx", "w") as z:
        z.writestr("word/document.xml", HEAD + BODY + "</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"not read")
    found = docx_blocks.blocks(docx_blocks.files(spark, str(tmp_path))).cache()
    rows = {}
    for r in found.orderBy("file", "pos").collect():
        rows.setdefault(r.file.rpartition("/")[2], []).append(r)
    a = rows["a.docx"]
    assert [(r.kind, r.block_id, r.paragraph, r.text, r.blank_before, r.page_break_before, r.section_break_before) for r in a] == [
        ("heading", "p-0001", 1, "Part\tone", 0, False, False), ("paragraph", "p-0002", 4, "About\nrivers", 2, False, False), ("image", "img-0001", 4, "", 0, False, False), ("paragraph", "p-0003", 4, "after", 0, False, False),
        ("paragraph", "p-0004", 6, "Which is longer?", 0, True, True), ("paragraph", "p-0005", 7, "A) one", 0, False, False), ("paragraph", "p-0006", 8, "B) two", 0, False, False), ("break", "br-0001", None, "", 1, True, False),
    ]
    assert a[2].media == ["r1"] and [(b.start, b.end) for b in a[5].bold] == [(0, 6)] and a[6].bold == [] and [r.kind for r in rows["b.docx"]] == ["broken"] and len(rows) == 2
    (m,) = docx_blocks.unsupported_media(docx_blocks.files(spark, str(tmp_path))).collect()
    assert (m.tables, m.text_boxes, m.images, m.drawings) == (1, 1, 3, 2)
    (q,) = prepare.prepare(docx_blocks.prepared(found))[0].collect()
    assert (q.text, q.answers, q.title) == ("Which is longer?", [1], "Part\tone")
    (q,) = blocks.questions_of_blocks(docx_blocks.paragraphs(found.where("kind <> 'broken'"))).collect()
    assert (q.question, q.options, q.answers, q.context_title) == ("Which is longer?", ["one", "two"], [1], "Part one")
    assert docx_blocks.blocks(docx_blocks.files(spark, str(tmp_path)).limit(0)).count() == 0


def test_long_files_come_back_in_bounded_batches():
    """A file of 2,500 paragraphs is no one frame, and files become Python objects one at a time."""
    import io

    import pyarrow as pa

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", HEAD + "<w:p><w:r><w:t>x</w:t></w:r></w:p>" * 2500 + "</w:body></w:document>")
    files = docx_blocks._one_by_one(iter([pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [out.getvalue(), None]})]))
    rows = (row for name, data in files for row in docx_blocks.blocks_of(name, data))
    sizes = [b.num_rows for b in docx_blocks._in_batches(rows, docx_blocks.COLUMNS, docx_blocks.ARROW)]
    assert sum(sizes) == 2501 and max(sizes) <= docx_blocks.ROWS
