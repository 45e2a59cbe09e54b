"""DOCX and XLSX packages with the standard library: the text units of a package, masked in place.

Both functions take a package's bytes and return (new bytes, hits); a hit is (location, kind, count). They raise ValueError for
what can't be masked safely: broken packages, embedded files, macros, packages of images only, document type declarations.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from functools import wraps
from xml.dom import minidom
from xml.parsers.expat import ExpatError

from ..functions.masking import mask_text

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD_TEXT = {"t", "instrText", "delText", "delInstrText"}

Hit = tuple[str, str, int]


def refuses_broken(mask):
    """Turns what a broken package raises, whatever part of it is broken, into ValueError."""

    @wraps(mask)
    def masked(content: bytes, rules: list[str]) -> tuple[bytes, list[Hit]]:
        try:
            return mask(content, rules)
        except (zipfile.BadZipFile, zlib.error, EOFError, LookupError, RuntimeError, AttributeError) as error:
            raise ValueError(f"broken or encrypted Office package: {type(error).__name__}: {error}") from error

    return masked


def _open(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as error:
        raise ValueError(f"not an Office package: {error}") from error


def _parsed(data: bytes) -> minidom.Document:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document type declarations are not allowed in packages")
    try:
        return minidom.parseString(data)
    except ExpatError as error:
        raise ValueError(f"broken XML: {error}") from error


def _text(node) -> str:
    return "".join(c.data for c in node.childNodes if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE))


def _set_text(node, text: str) -> None:
    for child in [c for c in node.childNodes if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE)]:
        node.removeChild(child)
    if text:
        node.appendChild(node.ownerDocument.createTextNode(text))


def _spread(nodes: list, masked: str) -> None:
    """Gives each node as much of the masked text as it had."""
    at = 0
    for node in nodes:
        size = len(_text(node))
        _set_text(node, masked[at : at + size])
        at += size
    if at != len(masked):
        raise ValueError("masking changed the length of a paragraph")


def part_label(name: str) -> str:
    base = posixpath.basename(name)
    if name == "word/document.xml":
        return "Document"
    named = re.fullmatch(r"(header|footer)(.*)\.xml", base)
    if named:
        return f"{named[1].capitalize()} {named[2]}"
    return {"footnotes.xml": "Footnotes", "endnotes.xml": "Endnotes", "comments.xml": "Comments"}.get(base, base)


def _paragraph(node):
    node = node.parentNode
    while node is not None and not (node.nodeType == node.ELEMENT_NODE and node.namespaceURI == WORD and node.localName == "p"):
        node = node.parentNode
    return node


def _mask_word(document: minidom.Document, label: str, rules: list[str]) -> tuple[list[Hit], int]:
    hits: list[Hit] = []
    runs: dict[int, list] = {}
    for kind in document.getElementsByTagNameNS(WORD, "*"):
        if kind.localName in WORD_TEXT and (owner := _paragraph(kind)) is not None:
            runs.setdefault(id(owner), []).append(kind)
    number = 0
    for paragraph in document.getElementsByTagNameNS(WORD, "p"):
        nodes = runs.get(id(paragraph))
        if not nodes:
            continue
        number += 1
        masked, total, counts = mask_text("".join(map(_text, nodes)), rules)
        if total:
            _spread(nodes, masked)
            hits += [(f"{label} paragraph {number}", kind, n) for kind, n in counts.items()]
    return hits, number


def _mask_leaves(document: minidom.Document, rules: list[str]) -> list[Hit]:
    hits: list[Hit] = []
    for node in document.getElementsByTagName("*"):
        if any(c.nodeType == c.ELEMENT_NODE for c in node.childNodes):
            continue
        masked, total, counts = mask_text(_text(node), rules)
        if total:
            _set_text(node, masked)
            hits += [(f"DOCX metadata: {node.localName}", kind, n) for kind, n in counts.items()]
    return hits


def _mask_links(document: minidom.Document, rules: list[str]) -> list[Hit]:
    hits: list[Hit] = []
    for node in document.documentElement.childNodes:
        if node.nodeType == node.ELEMENT_NODE and node.getAttribute("TargetMode") == "External":
            masked, total, counts = mask_text(node.getAttribute("Target"), rules)
            if total:
                node.setAttribute("Target", masked)
                hits += [("DOCX external relationship", kind, n) for kind, n in counts.items()]
    return hits


@refuses_broken
def mask_docx(content: bytes, rules: list[str]) -> tuple[bytes, list[Hit]]:
    with _open(content) as source:
        names = source.namelist()
        if any(n.startswith("word/embeddings/") for n in names):
            raise ValueError("the DOCX holds embedded files; these must be masked by themselves")
        if any(n.endswith("vbaProject.bin") for n in names):
            raise ValueError("Word documents with macros are not supported")
        if "word/document.xml" not in names:
            raise ValueError("not a Word document")
        hits: list[Hit] = []
        paragraphs = 0
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
            for info in source.infolist():
                data, name = source.read(info), info.filename
                if name.startswith("word/") and name.endswith(".xml"):
                    document = _parsed(data)
                    found, number = _mask_word(document, part_label(name), rules)
                    paragraphs += number
                elif name in ("docProps/core.xml", "docProps/custom.xml"):
                    document = _parsed(data)
                    found = _mask_leaves(document, rules)
                elif name.startswith("word/_rels/") and name.endswith(".rels"):
                    document = _parsed(data)
                    found = _mask_links(document, rules)
                else:
                    found = []
                hits += found
                target.writestr(info, document.toxml("UTF-8") if found else data)
    if not paragraphs and any(n.startswith("word/media/") for n in names):
        raise ValueError("the DOCX seems to hold images only")
    return out.getvalue(), hits


def _sheets(source: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the worksheets in their order."""
    links = {r.getAttribute("Id"): r.getAttribute("Target") for r in _parsed(source.read("xl/_rels/workbook.xml.rels")).documentElement.childNodes if r.nodeType == r.ELEMENT_NODE}
    found = []
    for sheet in _parsed(source.read("xl/workbook.xml")).getElementsByTagNameNS(SHEET, "sheet"):
        target = links.get(sheet.getAttributeNS(RELATIONS, "id"), "")
        part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        if part in source.namelist() and "worksheet" in part:
            found.append((sheet.getAttribute("name"), part))
    return found


def _children(node, name: str) -> list:
    return [c for c in node.childNodes if c.nodeType == c.ELEMENT_NODE and c.namespaceURI == SHEET and c.localName == name]


def _string_nodes(item) -> list:
    """The t elements of a string, without phonetic ones."""
    return [t for t in item.getElementsByTagNameNS(SHEET, "t") if t.parentNode.localName != "rPh"]


@refuses_broken
def mask_xlsx(content: bytes, rules: list[str]) -> tuple[bytes, list[Hit]]:
    """Masks string cells and formulas of all worksheets. Numbers, dates, sheet names and comments stay."""
    with _open(content) as source:
        if "xl/workbook.xml" not in source.namelist():
            raise ValueError("not a workbook")
        hits: list[Hit] = []
        changed: dict[str, bytes] = {}
        strings: list[str] = []
        if "xl/sharedStrings.xml" in source.namelist():
            shared = _parsed(source.read("xl/sharedStrings.xml"))
            for item in shared.getElementsByTagNameNS(SHEET, "si"):
                nodes = _string_nodes(item)
                strings.append("".join(map(_text, nodes)))
                masked, total, _ = mask_text(strings[-1], rules)
                if total:
                    _spread(nodes, masked)
            changed["xl/sharedStrings.xml"] = shared.toxml("UTF-8")
        for sheet, part in _sheets(source):
            document = _parsed(source.read(part))
            for cell in document.getElementsByTagNameNS(SHEET, "c"):
                kind, formula = cell.getAttribute("t"), _children(cell, "f")
                nodes = _children(cell, "v")
                if formula:
                    text, nodes = "=" + _text(formula[0]), formula
                    for value in _children(cell, "v"):  # a remembered result could show what the formula hides
                        cell.removeChild(value)
                elif kind == "s" and nodes:
                    text, nodes = strings[int(_text(nodes[0]))], []
                elif kind == "inlineStr":
                    nodes = [t for item in _children(cell, "is") for t in _string_nodes(item)]
                    text = "".join(map(_text, nodes))
                elif kind == "str" and nodes:
                    text = _text(nodes[0])
                else:
                    continue
                masked, total, counts = mask_text(text, rules)
                if total:
                    if formula:
                        _set_text(formula[0], masked[1:])
                    elif nodes:
                        _spread(nodes, masked)
                    hits += [(f"{sheet}!{cell.getAttribute('r')}", k, n) for k, n in counts.items()]
            changed[part] = document.toxml("UTF-8")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
            for info in source.infolist():
                target.writestr(info, changed.get(info.filename) or source.read(info))
    return out.getvalue(), hits


def write_xlsx(sheets: list[tuple[str, list[list[object]]]]) -> bytes:
    """A plain workbook: bold first rows that stay in view, columns as wide as their texts (12 to 70)."""
    def escaped(value: object) -> str:
        text = re.sub(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010FFFF]", "", str(value))
        return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def column(k: int) -> str:
        name = ""
        while k >= 0:
            name, k = chr(65 + k % 26) + name, k // 26 - 1
        return name

    def cell(row: int, k: int, value: object) -> str:
        at = f'r="{column(k)}{row}"' + (' s="1"' if row == 1 else "")
        if value is None:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c {at}><v>{value}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escaped(value)}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    package = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        target.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
        target.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        target.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{SHEET}" xmlns:r="{RELATIONS}"><sheets>' + "".join(f'<sheet name="{escaped(name)}" sheetId="{i}" r:id="r{i}"/>' for i, (name, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        target.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="rs" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>')
        target.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{SHEET}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, (_, rows) in enumerate(sheets, 1):
            widths = [max(12, min(70, max(len(str(r[k])) if k < len(r) and r[k] is not None else 0 for r in rows) + 2)) for k in range(max(map(len, rows), default=0))]
            columns = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
            body = "".join(f'<row r="{n}">' + "".join(cell(n, k, v) for k, v in enumerate(row)) + "</row>" for n, row in enumerate(rows, 1))
            target.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{SHEET}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>' + (f"<cols>{columns}</cols>" if columns else "") + f"<sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()
