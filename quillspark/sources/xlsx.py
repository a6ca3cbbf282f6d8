"""Workbooks as tables of cells, and inventories as workbooks. Read and written as zip packages, one workbook a row."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources.docx import in_batches

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"
#: Smaller parts are stored as they are, which is quicker than deflating them; so are pictures, whose formats are compressed.
LEAST_DEFLATED = 2048
#: Fixed value: the row and column of a picture that hangs on no cell.
UNANCHORED = 999999
CELLS = "path string, sheet_no int, sheet string, row_no int, col_no int, value string"
#: The inventory's columns: fixed values. Those from the fourth on are hidden.
HEADERS = ("File Name", "Image", "ALT Text", "Item ID", "Type", "Source Part", "Page", "Original ALT", "Generated ALT")
CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
ROOT_LINKS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
BOOK_LINKS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def cell_rows(content: bytes) -> Iterator[tuple[int, str, int, int, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        shared = ["".join(t.text or "" for t in x.iter(f"{MAIN}t")) for x in ET.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{MAIN}sheet"), 1):
            target = (links.get(sheet.get(LINK)) or "").lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            row_no = 0
            for row in ET.fromstring(archive.read(target)).iter(f"{MAIN}row") if target in names else ():
                row_no, col_no = int(row.get("r") or row_no + 1), 0
                for cell in row.iter(f"{MAIN}c"):
                    letters = re.match("[A-Z]+", cell.get("r") or "")
                    col_no = column_number(letters[0]) if letters else col_no + 1
                    kind, raw = cell.get("t"), cell.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif raw is None or raw.text is None:
                        continue
                    else:
                        value = shared[int(raw.text)] if kind == "s" else raw.text
                    yield number, sheet.get("name"), row_no, col_no, value


def cells(source: DataFrame) -> DataFrame:
    """The filled cells of each workbook: numbers as their text, strings from wherever they are kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *x) for x in cell_rows(bytes(content))], columns=[x.split()[0] for x in CELLS.split(", ")])

    return source.mapInPandas(run, CELLS)


def linked(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The parts that a part links to, by the links' names."""
    folder, _, name = part.rpartition("/")
    links = f"{folder}/_rels/{name}.rels"
    if links not in archive.namelist():
        return {}
    whole = lambda target: target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return {x.get("Id"): whole(x.get("Target") or "") for x in ET.fromstring(archive.read(links))}


def picture_rows(content: bytes) -> Iterator[tuple]:
    """sheet_no, sheet, picture (its place among the sheet's), row, col, part and content of each picture of a sheet's drawings."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        book = linked(archive, "xl/workbook.xml")
        for number, sheet in enumerate(ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{MAIN}sheet"), 1):
            part = book.get(sheet.get(LINK))
            if part not in names:
                continue
            links, picture = linked(archive, part), 0
            if not links:  # no drawings; its cells need not be read
                continue
            for drawing in ET.fromstring(archive.read(part)).iter(f"{MAIN}drawing"):
                drawn = links.get(drawing.get(LINK))
                if drawn not in names:
                    continue
                media = linked(archive, drawn)
                for anchor in ET.fromstring(archive.read(drawn)):
                    start = anchor.find(f"{DRAWING}from")
                    at = [int(start.findtext(f"{DRAWING}{c}") or UNANCHORED) for c in ("row", "col")] if start is not None else [UNANCHORED] * 2
                    for blip in anchor.iter(BLIP):
                        target = media.get(blip.get(EMBED))
                        if target in names:
                            picture += 1
                            yield number, sheet.get("name"), picture, *at, target, archive.read(target)


PICTURES = "path string, sheet_no int, sheet string, picture int, row int, col int, part string, content binary"


def pictures(source: DataFrame) -> DataFrame:
    """The pictures of each workbook with the row and column (from 0) that they hang on; those that hang on none come last, at UNANCHORED. In order: sheet, row, col, picture."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
    schema = pa.schema(list(zip([x.split()[0] for x in PICTURES.split(", ")], kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((path.as_py(), *row) for batch in batches for path, content in zip(batch.column(0), batch.column(1), strict=True) for row in picture_rows(content.as_py()))
        return in_batches(found, schema, content=7)

    return source.select("path", "content").mapInArrow(run, PICTURES)


LAYOUT = "path string, sheet_no int, kind string, top int, left int, bottom int, right int, size double, hidden boolean"


def layout_rows(content: bytes) -> Iterator[tuple]:
    """sheet_no, kind, top, left, bottom, right, size and hidden of merged cells, rows of a height, and spans of columns of a width; what is only hidden, too."""
    place = lambda cell: ((m := re.fullmatch("([A-Z]+)([0-9]+)", cell)) and (int(m[2]), column_number(m[1]))) or (None, None)
    size = lambda x: float(x) if x else None
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names, book = set(archive.namelist()), linked(archive, "xl/workbook.xml")
        for number, sheet in enumerate(ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{MAIN}sheet"), 1):
            if book.get(sheet.get(LINK)) not in names:
                continue
            for x in ET.fromstring(archive.read(book[sheet.get(LINK)])).iter():
                hidden = x.get("hidden") in ("1", "true")
                if x.tag == f"{MAIN}mergeCell":
                    first, _, last = (x.get("ref") or "").partition(":")
                    yield number, "merge", *place(first), *place(last or first), None, False
                elif x.tag == f"{MAIN}col" and (x.get("width") or hidden):
                    yield number, "column", None, int(x.get("min")), None, int(x.get("max")), size(x.get("width")), hidden
                elif x.tag == f"{MAIN}row" and x.get("r") and (x.get("ht") or hidden):
                    yield number, "row", int(x.get("r")), None, int(x.get("r")), None, size(x.get("ht")), hidden


def layout(source: DataFrame) -> DataFrame:
    """How the sheets of workbooks are laid out, as ordered.stacked_layout() takes it."""
    kinds = (pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                if rows := [(path.as_py(), *x) for x in layout_rows(content.as_py())]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in LAYOUT.split(", ")])

    return source.select("path", "content").mapInArrow(run, LAYOUT)


def packed(parts: Iterable[tuple[str, str | bytes]]) -> bytes:
    """A package of the named parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, content in parts:
            raw = content.encode() if isinstance(content, str) else content
            archive.writestr(name, raw, zipfile.ZIP_STORED if len(raw) < LEAST_DEFLATED or name.startswith("xl/media/") else zipfile.ZIP_DEFLATED, 1)
    return out.getvalue()


def with_pictures(book: bytes, placed: list[tuple[int | None, int | None, str, bytes]]) -> bytes:
    """A workbook() with pictures on its sheet: row and column (from 0; None for a place that hangs on no cell), the name of the part, and its content."""
    with zipfile.ZipFile(io.BytesIO(book)) as old:
        return pictured([(name, old.read(name).decode()) for name in old.namelist()], placed)


def pictured(book: Iterable[tuple[str, str]], placed: list[tuple[int | None, int | None, str, bytes]]) -> bytes:
    """with_pictures() of the parts of a workbook."""
    spaces = f'xmlns:xdr="{DRAWING[1:-1]}" xmlns:a="{BLIP[1:].partition("}")[0]}" xmlns:r="{LINK[1:-3]}"'
    start = lambda row, col: f"<xdr:from><xdr:col>{col}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from>"
    shape = lambda k: f'<xdr:ext cx="635000" cy="635000"/><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{k}" name="Picture {k}"/><xdr:cNvPicPr/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="rId{k}"/></xdr:blipFill><xdr:spPr/></xdr:pic><xdr:clientData/>'
    anchors = "".join(f'<xdr:absoluteAnchor><xdr:pos x="0" y="0"/>{shape(k)}</xdr:absoluteAnchor>' if row is None else f"<xdr:oneCellAnchor>{start(row, col)}{shape(k)}</xdr:oneCellAnchor>" for k, (row, col, _, _) in enumerate(placed, 1))
    link = lambda k, kind, target: f'<Relationship Id="rId{k}" Type="{LINK[1:-3]}/{kind}" Target="{target}"/>'
    links = lambda inner: f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'

    def parts() -> Iterator[tuple[str, str | bytes]]:
        for name, text in book:
            if name == "xl/worksheets/sheet1.xml":
                text = text.replace("</worksheet>", f'<drawing xmlns:r="{LINK[1:-3]}" r:id="rId1"/></worksheet>')
            elif name == "[Content_Types].xml":
                text = text.replace("</Types>", '<Default Extension="png" ContentType="image/png"/><Override PartName="/xl/drawings/drawing1.xml" ContentType="application/vnd.openxmlformats-officedocument.drawing+xml"/></Types>')
            yield name, text
        yield "xl/worksheets/_rels/sheet1.xml.rels", links(link(1, "drawing", "../drawings/drawing1.xml"))
        yield "xl/drawings/drawing1.xml", f'<?xml version="1.0" encoding="UTF-8"?><xdr:wsDr {spaces}>{anchors}</xdr:wsDr>'
        yield "xl/drawings/_rels/drawing1.xml.rels", links("".join(link(k, "image", f"../media/{part}") for k, (_, _, part, _) in enumerate(placed, 1)))
        for part, content in {part: content for _, _, part, content in placed}.items():
            yield f"xl/media/{part}", content

    return packed(parts())


def by_header(rows: DataFrame) -> DataFrame:
    """path, row_no and values: a map from each first-row header, lower-cased with single spaces, to the row's value. The first sheet only."""
    first = rows.where("sheet_no = 1")
    headers = first.where("row_no = 1").select("path", "col_no", F.lower(T.collapse("value")).alias("header")).where("header <> ''").groupBy("path", "header").agg(F.max("col_no").alias("col_no"))
    named = first.where("row_no > 1").join(headers, ["path", "col_no"])
    return named.groupBy("path", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("header", "value"))).alias("values"))


def imported_texts(rows: DataFrame) -> DataFrame:
    """path, row_no, item_id, text, file_name: an inventory workbook's rows, as operators.inventory.import_texts() takes them."""
    v = lambda name: F.col("values")[name]
    return by_header(rows).select("path", "row_no", F.trim(v("item id")).try_cast("long").alias("item_id"), T.collapse(F.coalesce(v("alt text"), v("generated alt text"))).alias("text"), F.trim(v("file name")).alias("file_name"))


def workbook(rows: list[tuple], title: str = "ALT Management", hidden_from: int = 4) -> bytes:
    """One sheet of inline strings; columns from `hidden_from` on are hidden."""
    return packed(workbook_parts(rows, title, hidden_from))


def workbook_parts(rows: list[tuple], title: str = "ALT Management", hidden_from: int = 4) -> Iterator[tuple[str, str]]:
    """The names and texts of a workbook()'s parts."""
    width = max(map(len, rows), default=0)
    lines = "".join(f'<row r="{r}">' + "".join(f'<c r="{column_name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for c, v in enumerate(row, 1) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    columns = "".join(f'<col min="{c}" max="{c}" width="30"' + (' hidden="1"' if c >= hidden_from else "") + "/>" for c in range(1, width + 1))
    sheet = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}">' + (f"<cols>{columns}</cols>" if width else "") + f"<sheetData>{lines}</sheetData></worksheet>"
    book = f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="rId1"/></sheets></workbook>'
    for name, text in (("[Content_Types].xml", CONTENT_TYPES), ("_rels/.rels", ROOT_LINKS), ("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", BOOK_LINKS), ("xl/worksheets/sheet1.xml", sheet)):
        yield name, re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)


def inventory_workbooks(items: DataFrame) -> DataFrame:
    """path, content: a workbook of each document's inventory, in order of the items. A document's items meet in one task."""

    def build(mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("id")
        name = mine["path"].iloc[0].rpartition("/")[2]
        rows = [HEADERS, *((name, "", r.alt_text, r.id, r.role, r.source_part, "", r.existing_alt_text, r.generated_alt_text) for r in mine.itertuples())]
        return pd.DataFrame({"path": [mine["path"].iloc[0]], "content": [workbook(rows)]})

    columns = ["path", "id", "role", "source_part", "alt_text", "existing_alt_text", "generated_alt_text"]
    return items.select(*columns).groupBy("path").applyInPandas(build, "path string, content binary")


def concatenated(rows: DataFrame) -> DataFrame:
    """Cells of all sheets of all workbooks below one another: out_row, col_no, value; header rows stay."""
    from quillspark.operators.ordered import union_with_offsets

    return union_with_offsets(sheet_rows(rows), rows.withColumnRenamed("path", "file_no")).select("file_no", "sheet_no", "out_row", "col_no", "value")


def sheet_rows(rows: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """file_no, sheet_no, n_rows of cells(), and of layout() where merged cells go further down."""
    ends = rows.select(F.col("path").alias("file_no"), "sheet_no", F.col("row_no").alias("end"))
    if placed is not None:
        ends = ends.unionByName(placed.where("kind = 'merge'").select(F.col("path").alias("file_no"), "sheet_no", F.col("bottom").alias("end")))
    return ends.groupBy("file_no", "sheet_no").agg(F.max("end").alias("n_rows"))


def concatenated_layout(source: DataFrame) -> DataFrame:
    """The layout of all sheets of all workbooks below one another, pictures included (their rows and columns from 1)."""
    from quillspark.operators.ordered import stacked_layout

    placed = layout(source)
    none = F.lit(None).cast("int")
    at = lambda c: F.when(F.col(c) != UNANCHORED, F.col(c) + 1)
    hung = pictures(source).select("path", "sheet_no", F.lit("picture").alias("kind"), at("row").alias("top"), at("col").alias("left"), at("row").alias("bottom"), at("col").alias("right"), none.cast("double").alias("size"), F.lit(False).alias("hidden"))
    return stacked_layout(sheet_rows(cells(source), placed), placed.unionByName(hung).withColumnRenamed("path", "file_no"))
