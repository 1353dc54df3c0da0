"""An adapter for a PDF library, used only where that library is installed."""

from __future__ import annotations

from collections.abc import Iterator


def parse_pdf(content: bytes) -> Iterator[tuple[int, str, list, list]]:
    """(page, raw text, blocks of lines, tables) of each page, for files.pdf_layout(). Needs the package `pymupdf`.

    A line's text is that of its spans; blocks without lines (images) are left out; a missing cell is empty.
    """
    try:
        import pymupdf
    except ImportError as e:
        raise ImportError("reading PDF files needs the package pymupdf; layouts parsed elsewhere are read by layout_json()") from e

    def line(x) -> dict:
        return dict(zip(("x0", "y0", "x1", "y1"), map(float, x["bbox"]), strict=True)) | {"text": "".join(s["text"] for s in x["spans"])}

    def table(t) -> dict:
        return {"bbox": dict(zip(("x0", "y0", "x1", "y1"), map(float, t.bbox), strict=True)), "rows": [["" if c is None else c for c in row] for row in t.extract()]}

    with pymupdf.open(stream=content, filetype="pdf") as file:
        for number, page in enumerate(file, 1):
            blocks = [{"lines": [line(x) for x in b["lines"]]} for b in page.get_text("dict")["blocks"] if b.get("lines")]
            yield number, page.get_text(), blocks, [table(t) for t in page.find_tables().tables]
