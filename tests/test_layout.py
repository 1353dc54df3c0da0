"""Page geometry and cover pages."""

import json

from pyspark.sql import functions as F

from quillspark.operators import corpus, layout
from quillspark.schemas import LAYOUT
from quillspark.sources import files


def line(x0, y0, x1, y1, text):
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": text}


def block(*lines):
    return {"lines": list(lines)}


def table(box, *rows):
    return {"bbox": dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)), "rows": [list(r) for r in rows]}


def pages(spark, tmp_path, *rows):
    path = tmp_path / "layout.jsonl"
    path.write_text("\n".join(json.dumps({"file": f, "page": p, "raw_text": "raw", "blocks": b, "tables": t}) for f, p, b, t in rows))
    return files.layout_json(spark, str(path))


def test_body(spark, tmp_path):
    blocks = [
        block(line(0.0, 5.0, 50.0, 15.0, "header words")),
        block(line(0.0, 50.0, 10.0, 60.0, "●"), line(15.0, 50.0, 90.0, 60.0, "marked"), line(20.0, 62.0, 90.0, 72.0, " ​")),
        block(line(0.0, 64.0, 50.0, 74.0, "soft wrap")),
        block(line(100.0, 64.0, 150.0, 74.0, "beside")),
        block(line(0.0, 100.0, 50.0, 110.0, "in table")),
        block(line(0.0, 112.0, 50.0, 120.0, "in table too")),
        block(line(0.0, 200.0, 50.0, 210.0, "left"), line(80.0, 201.0, 120.0, 211.0, "pieces"), line(170.0, 200.0, 190.0, 210.0, "column")),
    ]
    tables = [table((0.0, 0.0, 200.0, 40.0), ["Policy & Standard Operating Procedure"], ["Title: My  Title", "Issued to: HA"]), table((0.0, 95.0, 200.0, 125.0), ["a", " b\nc "], ["", " "], ["1", None]), table((0.0, 300.0, 9.0, 310.0), ["late"])]
    header, own = layout.split_header(F.col("tables"))
    rows = pages(spark, tmp_path, ("f.pdf", 1, blocks, tables)).withColumn("h", header).withColumn("o", own)
    got = rows.select(layout.body_text(F.col("blocks"), F.col("o"), F.col("h")), layout.parse_header(F.col("h.rows"))).first()
    assert got[0] == "● marked\nsoft wrap | beside\n\n| a | b c |\n| --- | --- |\n| 1 |  |\n\nleft pieces | column\n\n| late |\n| --- |"
    assert got[1] == {"title": "My Title", "issued_to": "HA"}


def test_pages_from_layout(spark, tmp_path):
    cover = [table((0.0, 0.0, 9.0, 9.0), ["Version:", "# 003"], ["Process Owner:\nVP Human Asset\nSignature", ""]), table((0.0, 10.0, 9.0, 19.0), ["Revision History"], ["Rev", "What"], ["1", "first  issue", "2020", "2021"], ["", ""])]
    loose = block(line(0.0, 50.0, 90.0, 60.0, "Prepared by: Someone"))
    text = block(line(0.0, 50.0, 90.0, 60.0, "1.​Purpose"), line(0.0, 61.0, 90.0, 70.0, "of it"))
    head = table((0.0, 0.0, 200.0, 40.0), ["Policy & Standard Operating Procedure"], ["Title: My Title"])
    rows = pages(spark, tmp_path, ("f.pdf", 1, [loose], cover), ("f.pdf", 2, [text], [head]), ("f.pdf", 3, [text], []), ("g.h.pdf", 1, [text], []))
    reg = files.registry(spark, [("f.pdf", "Doc F", "sop", 1, [3])])
    got = {(r["doc"], r["page"]): r for r in layout.pages_from_layout(corpus.with_registry(rows, reg)).collect()}
    assert set(got) == {("Doc F", 1), ("Doc F", 2), ("g.h", 1)}
    assert got["Doc F", 1]["text"] == "Document: My Title\nVersion: # 003\n\nApprovals:\n- Process Owner: VP Human Asset\n- Prepared By: Someone\n\nRevision History:\n- 1 (revised 2020, effective 2021): first issue"
    assert got["Doc F", 2]["text"] == "1. Purpose of it"
    assert got["Doc F", 1]["metadata"]["page_type"] == "cover" and got["Doc F", 2]["metadata"]["version"] == "# 003" and got["Doc F", 1]["metadata"]["total_pages"] == 3
    assert got["g.h", 1]["metadata"]["title"] is None
