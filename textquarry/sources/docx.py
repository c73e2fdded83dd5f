"""Word documents: paragraphs of word/document.xml, and the properties of the package.

A paragraph is the text of all its descendants in order, with nothing between runs (breaks and tabs give nothing, a
text box appears in its own paragraph and in the one around it). No entity is expanded: a part with a document type is
refused, and parts are read up to a bound.
"""

from __future__ import annotations

import html
import io
import re
import xml.etree.ElementTree as ET
import zipfile

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MOST_BYTES = 64 << 20
OLD_FORMAT = bytes.fromhex("D0CF11E0A1B11AE1")
TRIMMED = " \t\n\r\x00\x0b"
#: Property names and the elements that hold them.
FIELDS = {
    "docProps/app.xml": {"editing_minutes": "TotalTime", "application": "Application", "app_version": "AppVersion", "declared_words": "Words"},
    "docProps/core.xml": {"created": "created", "modified": "modified", "revision": "revision", "creator": "creator", "last_modified_by": "lastModifiedBy"},
}


def _part(content: bytes, name: str) -> bytes | None:
    if content.startswith(OLD_FORMAT):
        raise ValueError("old binary Word format; save the document as .docx")
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise ValueError("the file can't be opened as a .docx package") from None
    with package:
        if name not in package.namelist():
            return None
        with package.open(name) as part:
            data = part.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError("a part of the package is too large")
    return data


def text_of(content: bytes) -> str:
    data = _part(content, "word/document.xml")
    if data is None:
        raise ValueError("the package holds no word/document.xml")
    if b"<!DOCTYPE" in data:
        raise ValueError("a document type is not allowed in a .docx part")
    paragraphs = ("".join(p.itertext()).strip(TRIMMED) for p in ET.fromstring(data).iter(f"{W}p"))
    return "\n\n".join(p for p in paragraphs if p)


def fields_of(content: bytes) -> dict[str, str]:
    out = {}
    for part, wanted in FIELDS.items():
        xml = (_part(content, part) or b"").decode("utf-8", "replace")
        for field, tag in wanted.items():
            m = re.search(rf"<(?:[A-Za-z0-9]+:)?{tag}\b[^>]*>(.*?)</", xml, re.DOTALL)
            if m and (value := html.unescape(m[1]).strip(TRIMMED)):
                out[field] = value
    return out
