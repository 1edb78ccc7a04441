"""Minutes as a word-processor file, and content types of the formats."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

# fixed values: content types by format
CONTENT_TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "html": "text/html; charset=utf-8",
    "md": "text/markdown; charset=utf-8",
    "json": "application/json",
}
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def docx(lines: list[tuple[str, bool]]) -> bytes:
    """A document of paragraphs (text, bold), with fixed dates so that equal input gives equal bytes."""
    legal = lambda s: "".join(ch for ch in s if ch in "\t\n" or ord(ch) >= 32)
    body = "".join(f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(legal(text))}</w:t></w:r></w:p>' for text, bold in lines)
    main = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {**_PARTS, "word/document.xml": main}.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def docx_files(markdown: DataFrame) -> DataFrame:
    """Rows (meeting_id, docx) from rows (meeting_id, markdown): headings in bold; null gives an empty document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [docx([(line.lstrip("# "), line.startswith("#")) for line in (text or "").split("\n")]) for text in pdf["markdown"]]
            yield pd.DataFrame({"meeting_id": pdf["meeting_id"], "docx": made})

    return markdown.select("meeting_id", "markdown").mapInPandas(run, "meeting_id string, docx binary")
