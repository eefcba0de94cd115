"""Text of office documents held in memory."""

from __future__ import annotations

import datetime
import io
import math
import re
import zipfile
from xml.etree import ElementTree

from veldspar.sources.text import ParseFailed, decode_csv, normalised_lines, records, sniff_delimiter

_DATE_FORMAT = re.compile(r"[dmyhs]", re.I)
_QUOTED = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.I)
#: Number formats that stand for dates without a format of their own, and for durations.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
DURATION_FORMATS = {46}


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(archive.read(name))
    except (KeyError, ElementTree.ParseError) as error:
        raise ParseFailed(f"{name}: {error}") from error


def _archive(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as error:
        raise ParseFailed(str(error)) from error


def _paragraph(element: ElementTree.Element) -> str:
    """Runs of a paragraph; a tab or break counts once there is text before it."""
    out = []
    for e in element.iter():
        name = _local(e)
        if name == "t":
            out.append(e.text or "")
        elif name in ("tab", "br") and any(out):
            out.append("\t" if name == "tab" else "\n")
    return "".join(out).strip()


def _cell(element: ElementTree.Element) -> str:
    return "\n".join(t for p in element.iter() if _local(p) == "p" and (t := _paragraph(p))).strip()


def docx_text(data: bytes) -> str:
    """Paragraphs, and the rows of outer tables with tabs between cells, in document order."""
    body = _xml(_archive(data), "word/document.xml")
    blocks: list[str] = []

    def walk(element: ElementTree.Element) -> None:
        for child in element:
            name = _local(child)
            if name == "p":
                blocks.append(_paragraph(child))
            elif name == "tbl":
                for row in (r for r in child if _local(r) == "tr"):
                    cells = [_cell(c) for c in row if _local(c) == "tc"]
                    while cells and not cells[-1]:
                        cells.pop()
                    blocks.append("\t".join(cells))
            else:
                walk(child)

    walk(body)
    return "\n".join(b for b in blocks if b)


def clock(milliseconds: int, wide: bool = True) -> str:
    """h:mm:ss, with microseconds if there are milliseconds."""
    hours, rest = divmod(milliseconds, 3_600_000)
    minutes, rest = divmod(rest, 60_000)
    seconds, millis = divmod(rest, 1000)
    text = f"{hours:02d}" if wide else str(hours)
    return f"{text}:{minutes:02d}:{seconds:02d}" + (f".{millis:03d}000" if millis else "")


def excel_duration(days: float) -> str:
    """A duration as days and a clock."""
    whole, rest = divmod(math.floor(days * 86_400_000 + 0.5), 86_400_000)
    text = clock(rest, wide=False)
    return text if whole == 0 else f"1 day, {text}" if whole == 1 else f"{whole} days, {text}"


def excel_datetime(serial: float, from_1904: bool = False) -> str:
    """A date with a clock, or the clock alone for serial numbers below one."""
    millis = math.floor(serial * 86_400_000 + 0.5)
    if 0 <= serial < 1:
        return clock(millis % 86_400_000)
    day, rest = divmod(millis, 86_400_000)
    # The 1900 calendar counts a 29 February that never was.
    epoch = datetime.date(1904, 1, 1) if from_1904 else datetime.date(1899, 12, 30) if day >= 60 else datetime.date(1899, 12, 31)
    return f"{epoch + datetime.timedelta(days=day)} {clock(rest)}"


def number_text(value: float) -> str:
    """Integral numbers without a fraction, others in their shortest form."""
    return f"{value:.0f}" if math.isfinite(value) and value == int(value) else repr(value)


def _styles(archive: zipfile.ZipFile) -> list[str]:
    """date, duration or nothing for each cell style."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    root = _xml(archive, "xl/styles.xml")
    own = {int(e.get("numFmtId")): _QUOTED.sub("", e.get("formatCode") or "") for e in root.iter() if _local(e) == "numFmt"}
    kinds = []
    for cell in (x for e in root if _local(e) == "cellXfs" for x in e):
        code = int(cell.get("numFmtId") or 0)
        text = own.get(code, "")
        duration = code in DURATION_FORMATS or bool(re.search(r"\[(?:h+|m+|s+)\]", text, re.I))
        kinds.append("duration" if duration else "date" if code in DATE_FORMATS or _DATE_FORMAT.search(text) else "")
    return kinds


def _column(reference: str) -> int:
    out = 0
    for c in reference:
        if not c.isalpha():
            break
        out = out * 26 + ord(c.upper()) - 64
    return out - 1


def xlsx_text(data: bytes) -> str:
    """All sheets in order, hidden ones too, each under its heading; sheets without text are left out."""
    archive = _archive(data)
    book = _xml(archive, "xl/workbook.xml")
    links = {e.get("Id"): e.get("Target") for e in _xml(archive, "xl/_rels/workbook.xml.rels")}
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _xml(archive, "xl/sharedStrings.xml") if _local(si) == "si"]
    from_1904 = any(_local(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
    kinds = _styles(archive)

    def cell(element: ElementTree.Element) -> str:
        kind = element.get("t")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in element.iter() if _local(t) == "t")
        raw = next((e.text or "" for e in element if _local(e) == "v"), "")
        if not raw:
            return ""
        if kind == "s":
            return shared[int(raw)]
        if kind == "b":
            return "TRUE" if raw in ("1", "true") else "FALSE"
        if kind == "d":
            return raw.replace("T", " ", 1)
        if kind in ("str", "e"):
            return raw
        style = int(element.get("s") or 0)
        what = kinds[style] if style < len(kinds) else ""
        value = float(raw)
        return excel_duration(value) if what == "duration" else excel_datetime(value, from_1904) if what == "date" else number_text(value)

    sections = []
    for sheet in (s for e in book if _local(e) == "sheets" for s in e):
        target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        root = _xml(archive, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        rows: dict[int, dict[int, str]] = {}
        for row in (r for e in root if _local(e) == "sheetData" for r in e):
            at = int(row.get("r") or max(rows, default=0) + 1)
            cells = rows.setdefault(at, {})
            for c in row:
                cells[_column(c.get("r")) if c.get("r") else max(cells, default=-1) + 1] = cell(c)
        used = [(r, k) for r, cells in rows.items() for k, v in cells.items() if v]
        if used:
            left = min(k for _, k in used)
            top, bottom = min(r for r, _ in used), max(r for r, _ in used)
            table = [[rows.get(r, {}).get(k, "") for k in range(left, max(rows.get(r, {}), default=left - 1) + 1)] for r in range(top, bottom + 1)]
            sections.append(f"=== Sheet: {sheet.get('name')} ===\n" + "\n".join(normalised_lines(table)))
    return "\n\n".join(sections)


def csv_text(data: bytes) -> str:
    """Delimited text under its heading, or nothing if it has no text."""
    text = decode_csv(data)
    lines = normalised_lines(records(text, sniff_delimiter(text)))
    return "=== CSV ===\n" + "\n".join(lines) if any(lines) else ""


def page_texts(pages: list[str]) -> str:
    """Trimmed pages that have text, a blank line between them."""
    return "\n\n".join(t for p in pages if (t := p.strip()))


def pdf_text(data: bytes) -> str:
    """Pages of a PDF, by an optional library."""
    try:
        import pypdf
    except ImportError as error:
        raise ParseFailed("reading PDF needs the pypdf package") from error
    try:
        return page_texts([p.extract_text() for p in pypdf.PdfReader(io.BytesIO(data)).pages])
    except Exception as error:  # noqa: BLE001  the library's errors have no common base
        raise ParseFailed(str(error)) from error


def xls_text(data: bytes) -> str:
    """Sheets of an old workbook, by an optional library."""
    try:
        import xlrd
    except ImportError as error:
        raise ParseFailed("reading XLS needs the xlrd package") from error
    try:
        book = xlrd.open_workbook(file_contents=data)
    except Exception as error:  # noqa: BLE001
        raise ParseFailed(str(error)) from error
    sections = []
    for sheet in book.sheets():
        rows = [[_xls_cell(c, book.datemode) for c in sheet.row(r)] for r in range(sheet.nrows)]
        lines = normalised_lines(rows)
        if any(lines):
            sections.append(f"=== Sheet: {sheet.name} ===\n" + "\n".join(lines))
    return "\n\n".join(sections)


def _xls_cell(cell, datemode: int) -> str:  # noqa: ANN001
    kind, value = cell.ctype, cell.value
    return {2: lambda: number_text(value), 3: lambda: excel_datetime(value, bool(datemode)), 4: lambda: "TRUE" if value else "FALSE"}.get(kind, lambda: str(value))()


EXTRACTORS = {"pdf": pdf_text, "docx": docx_text, "xls": xls_text, "xlsx": xlsx_text, "csv": csv_text}
