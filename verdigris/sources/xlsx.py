"""Label sheets as XLSX workbooks, by the standard library: one sheet, text cells, shaded rows, drop-down lists."""

from __future__ import annotations

import datetime
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

#: Fixed values of the file format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_DATE_FORMATS = frozenset(range(14, 23))
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: A list of choices stands in a formula of at most so many characters.
LIST_CHARS = 255


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_xlsx(path: str | Path, columns: list[str], rows: list[list[str]], shaded: set[int] = frozenset(), choices: dict[str, list[str]] | None = None) -> None:
    """Cells as text; ``shaded`` rows have a grey ground, and columns with ``choices`` a drop-down list if it is short enough."""

    def cell(r: int, c: int, value: str, style: int) -> str:
        return f'<c r="{column_name(c)}{r}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(_plain(value))}</t></is></c>'

    lines = [f'<row r="1">{"".join(cell(1, c, v, 1) for c, v in enumerate(columns))}</row>']
    for i, row in enumerate(rows):
        lines.append(f'<row r="{i + 2}">{"".join(cell(i + 2, c, v, 2 if i in shaded else 1) for c, v in enumerate(row))}</row>')
    lists = []
    for name, options in (choices or {}).items():
        formula = '"' + ",".join(options) + '"'
        if len(formula) <= LIST_CHARS and not any("," in o or '"' in o for o in options) and rows:
            at = column_name(columns.index(name))
            lists.append(f'<dataValidation type="list" allowBlank="1" sqref="{at}2:{at}{len(rows) + 1}"><formula1>{escape(formula)}</formula1></dataValidation>')
    validations = f'<dataValidations count="{len(lists)}">{"".join(lists)}</dataValidations>' if lists else ""
    fills = '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFE0E0E0"/></patternFill></fill></fills>'
    formats = "".join(f'<xf numFmtId="{n}" fontId="0" fillId="{f}" borderId="0" applyNumberFormat="1" applyFill="1"/>' for n, f in ((0, 0), (49, 0), (49, 2)))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type={quoteattr(_REL + "/officeDocument")} Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="labels" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type={quoteattr(_REL + "/worksheet")} Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type={quoteattr(_REL + "/styles")} Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts>{fills}<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{formats}</cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData>{validations}</worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, _HEAD + body)


def _plain(value: str) -> str:
    """Without characters that XML has no form for."""
    return re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", value)


def read_xlsx(path: str | Path) -> tuple[list[str], list[list[str]]]:
    """Header and rows of the first sheet as text: yes and no, ISO dates, whole numbers without a point; blank rows at the end go."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        tree = lambda n: ElementTree.fromstring(z.read(n))
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{{{_MAIN}}}t"))
        shared = [text(e) for e in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dated = _date_styles(tree("xl/styles.xml")) if "xl/styles.xml" in names else set()
        first = tree("xl/workbook.xml").find(f".//{{{_MAIN}}}sheet").get(f"{{{_REL}}}id")
        target = next(r.get("Target") for r in tree("xl/_rels/workbook.xml.rels") if r.get("Id") == first)
        sheet = tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    grid: list[list[str]] = []
    for row in sheet.iter(f"{{{_MAIN}}}row"):
        cells: list[str] = []
        for c in row.iter(f"{{{_MAIN}}}c"):
            at = _place(c.get("r"), len(cells))
            cells += [""] * (at + 1 - len(cells))
            cells[at] = _value(c, shared, dated, text)
        at = int(row.get("r") or len(grid) + 1) - 1
        grid += [[]] * (at + 1 - len(grid))
        grid[at] = cells
    while grid and not any(x.strip() for x in grid[-1]):
        grid.pop()
    if not grid:
        return [], []
    head = [h.strip() for h in grid[0]]
    return head, [row[: len(head)] + [""] * (len(head) - len(row)) for row in grid[1:]]


def _place(name: str | None, otherwise: int) -> int:
    letters = re.match(r"[A-Z]+", name or "")
    if not letters:
        return otherwise
    at = 0
    for ch in letters[0]:
        at = at * 26 + ord(ch) - 64
    return at - 1


def _date_styles(styles) -> set[int]:
    own = {int(f.get("numFmtId")) for f in styles.iter(f"{{{_MAIN}}}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or ""), re.I)}
    formats = styles.find(f"{{{_MAIN}}}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId") or 0) in _DATE_FORMATS | own}


def _value(c, shared: list[str], dated: set[int], text) -> str:
    kind, v = c.get("t") or "n", c.find(f"{{{_MAIN}}}v")
    if kind == "inlineStr":
        return text(c).strip()
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)].strip()
    if kind == "b":
        return "yes" if v.text == "1" else "no"
    if kind != "n":
        return v.text.strip()
    number = float(v.text)
    if int(c.get("s") or 0) in dated:
        return (datetime.date(1899, 12, 30) + datetime.timedelta(days=int(number))).isoformat()
    return str(int(number)) if number == int(number) else v.text.strip()
