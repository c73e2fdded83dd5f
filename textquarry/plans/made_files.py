"""Files made from texts, for queries and tests of the readers."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes(paragraphs: list[str], app: str = "", core: str = "") -> bytes:
    out = io.BytesIO()
    clean = ("".join(c for c in p if c >= " " or c in "\t") for p in paragraphs)
    body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in clean)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        package.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_NS}"><w:body>{body}</w:body></w:document>')
        for name, xml in (("docProps/app.xml", app), ("docProps/core.xml", core)):
            if xml:
                package.writestr(name, xml)
    return out.getvalue()


def pdf_bytes(lines: list[str], extra: dict[int, bytes] | None = None) -> bytes:
    """One page of lines in a standard font; characters beyond Windows-1252 are left out."""
    shown = []
    for line in lines:
        raw = line.encode("cp1252", "ignore").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        shown.append(b"(" + raw + b") Tj T*")
    content = zlib.compress(b"BT /F1 10 Tf 12 TL 50 700 Td\n" + b"\n".join(shown) + b"\nET")
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>",
        4: b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(content) + content + b"\nendstream",
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    } | (extra or {})
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())
    return b"%PDF-1.4\n" + body + b"trailer\n<< /Root 1 0 R /Size 6 >>\n%%EOF\n"


def _made(suffix: str, make) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"made/{i}.{suffix}" for i in ids], pa.string()), "content": pa.array([make((t or "").replace("\r", "").split("\n")) for t in texts], pa.binary())})

    return run


def as_docx(docs: DataFrame) -> DataFrame:
    return docs.select("id", "text").mapInArrow(_made("docx", docx_bytes), "path string, content binary")


def as_pdf(docs: DataFrame) -> DataFrame:
    return docs.select("id", "text").mapInArrow(_made("pdf", pdf_bytes), "path string, content binary")
