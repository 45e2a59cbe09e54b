"""Small packages made of texts, for queries and tests."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from .archives import pack
from .office import WORD, write_xlsx


def docx(paragraphs: list[str], more: dict[str, bytes] | None = None) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        target.writestr(zipfile.ZipInfo("[Content_Types].xml"), '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        target.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
        for name, data in (more or {}).items():
            target.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def sample(end: str, texts: list[str]) -> bytes:
    if end == ".docx":
        return docx(texts)
    if end == ".xlsx":
        return write_xlsx([("Sheet1", [[i, t] for i, t in enumerate(texts)])])
    return pack([(f"turns/{i}.txt", t.encode("utf-8")) for i, t in enumerate(texts)], end)[0]
