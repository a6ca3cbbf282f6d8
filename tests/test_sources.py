"""Packages built with zipfile: read, write, read again."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import inventory
from quillspark.sources import docx, xlsx

W = " ".join(f'xmlns:{k}="{v}"' for k, v in docx.NS.items() if k != "pr")


def drawing(n, text=None):
    said = f' descr="{text}" title="t"' if text is not None else ""
    return f'<w:r><w:drawing><wp:inline><wp:extent cx="1270000" cy="635000"/><wp:docPr id="{n}" name="Picture {n}"{said}/><a:graphic><a:blip r:embed="rId{n}"/></a:graphic></wp:inline></w:drawing></w:r>'


BODY = f"""<?xml version="1.0"?><w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>A title</w:t></w:r></w:p>
<w:p><w:r><w:t xml:space="preserve">Some </w:t><w:tab/><w:t>text</w:t><w:instrText>PAGE</w:instrText></w:r>{drawing(1, "old text")}</w:p>
<w:p>{drawing(2)}</w:p>
<w:p><m:oMath><m:r><m:t>a+b=c</m:t></m:r></m:oMath></w:p>
<w:p><w:r><w:pict><v:shape id="s7" alt="vml"><v:imagedata r:id="rId3"/></v:shape></w:pict></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="4"/></w:numPr></w:pPr><w:r><w:t>listed</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r>{drawing(9)}</w:p></w:tc></w:tr></w:tbl>
<w:sdt><w:sdtContent><w:p><w:r><w:t>controlled</w:t></w:r></w:p></w:sdtContent></w:sdt>
<w:p/></w:body></w:document>"""
RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{n}" Type="http://x/image" Target="media/i{n}.png"/>' for n in (1, 2, 3, 9)) + "</Relationships>"
STYLES = f'<?xml version="1.0"?><w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>'
NUMBERING = f'<?xml version="1.0"?><w:numbering {W}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="lowerRoman"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="4"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="3"/></w:lvlOverride></w:num></w:numbering>'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in {"[Content_Types].xml": "<Types/>", "_rels/.rels": "<Relationships/>", **parts}.items():
            archive.writestr(name, text)
    return out.getvalue()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("docs")
    good = {"word/document.xml": BODY, "word/_rels/document.xml.rels": RELS, "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING}
    for n in range(3):
        (at / f"d{n}.docx").write_bytes(package(**good))
    return docx.packages(spark, str(at))


def test_elements(files):
    rows = files.where("path like '%d0.docx'").transform(docx.elements).orderBy("idx").collect()
    assert [(r["kind"], r["role"]) for r in rows] == [("text", "heading"), ("text", "normal_text"), ("drawing", "image"), ("drawing", "image"), ("formula", "equation"), ("shape", "image"), ("text", "list"), ("table", "table"), ("drawing", "image"), ("text", "normal_text"), ("text", "empty")]
    assert rows[1]["text"] == "Some \ttext" and rows[2]["alt_text"] == "old text" and (rows[2]["width_pt"], rows[2]["height_pt"]) == (100.0, 50.0)
    assert docx.styles(files).first()["outline_level"] == 0
    assert tuple(docx.numbering(files).first())[1:] == ("4", "0", 3, "lowerRoman", "%1.")


def test_inventory_and_writing_back(files):
    items = docx.inventory(files)
    one = {r["docpr_id"]: r for r in items.where("path like '%d1.docx'").collect()}
    assert set(one) == {"1", "2", "9", "s7"} and one["2"]["media_target"] == "media/i2.png" and one["1"]["alt_source"] == "existing"
    assert inventory.summarize(items).first()["without_alt_text"] == 6
    texts = items.select("path", "source_part", "docpr_id", F.when(F.col("docpr_id") == "1", "").otherwise(F.concat(F.lit("new "), "docpr_id")).alias("alt_text"))
    written = docx.with_texts(files, texts)
    assert [r["changed"] for r in written.collect()] == [4, 4, 4]
    again = {r["docpr_id"]: r["alt_text"] for r in docx.inventory(written.select("path", "content")).where("path like '%d2.docx'").collect()}
    assert again == {"1": "", "2": "new 2", "9": "new 9", "s7": "new s7"}
    cleared = docx.without_texts(files)
    assert [r["changed"] for r in cleared.collect()] == [3, 3, 3]
    assert docx.inventory(cleared.select("path", "content")).where("has_alt_text").count() == 0


def test_validation(spark):
    rows = [("a", package(**{"word/document.xml": BODY})), ("b", b"%PDF-1.7"), ("c", b"\xd0\xcf\x11\xe0zz"), ("d", b"nothing"), ("e", package(**{"inner.docx": "x"}))]
    got = {r["path"]: r["error"] for r in docx.validated(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a"] is None and "PDF" in got["b"] and "old" in got["c"] and "ZIP" in got["d"] and "inner.docx" in got["e"]


def test_workbook_round_trip(spark, files):
    items = docx.inventory(files)
    books = xlsx.inventory_workbooks(items)
    cells = xlsx.cells(books)
    assert [r["value"] for r in cells.where("row_no = 1 and path like '%d0.docx'").orderBy("col_no").collect()] == list(xlsx.HEADERS)
    sheet = xlsx.imported_texts(cells).withColumnRenamed("path", "doc_id")
    edited = sheet.withColumn("text", F.concat(F.lit("text of "), F.col("item_id").cast("string")))
    back = inventory.import_texts(items.withColumnRenamed("path", "doc_id").select("doc_id", "id", "role"), edited)
    assert back.where(F.col("alt_text") != F.concat(F.lit("text of "), F.col("id").cast("string"))).count() == 0 and back.count() == 12
    both = xlsx.concatenated(cells)
    assert both.select("out_row").distinct().count() == 15 and both.where("value = 'Item ID'").count() == 3


def test_shared_strings_and_sparse_rows(spark):
    book = f'<workbook xmlns="{xlsx.MAIN[1:-1]}" xmlns:r="{xlsx.LINK[1:-3]}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>'
    sheet = f'<worksheet xmlns="{xlsx.MAIN[1:-1]}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2"><v>7</v></c></row></sheetData></worksheet>'
    shared = f'<sst xmlns="{xlsx.MAIN[1:-1]}"><si><t>x</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>'
    raw = package(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": xlsx.BOOK_LINKS, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": shared})
    rows = xlsx.cells(spark.createDataFrame([("p", raw)], "path string, content binary")).orderBy("col_no").collect()
    assert [(r["row_no"], r["col_no"], r["value"]) for r in rows] == [(2, 2, "ab"), (2, 27, "7")]


def test_pictures_of_workbooks(spark):
    book = xlsx.with_pictures(xlsx.workbook([("a", "b"), ("c", "d")]), [(1, 0, "a.png", b"A"), (None, None, "b.png", b"B"), (0, 2, "a.png", b"A")])
    odd = xlsx.workbook([("no picture",)])
    rows = xlsx.pictures(spark.createDataFrame([("x", bytearray(book)), ("y", bytearray(odd))], "path string, content binary")).orderBy("sheet", "row", "col", "picture").collect()
    assert [(r["path"], r["sheet_no"], r["picture"], r["row"], r["col"], r["part"], bytes(r["content"])) for r in rows] == [
        ("x", 1, 3, 0, 2, "xl/media/a.png", b"A"), ("x", 1, 1, 1, 0, "xl/media/a.png", b"A"), ("x", 1, 2, 999999, 999999, "xl/media/b.png", b"B"),
    ]
    assert [r["value"] for r in xlsx.cells(spark.createDataFrame([("x", bytearray(book))], "path string, content binary")).collect()] == ["a", "b", "c", "d"]


def test_layout_of_workbooks(spark):
    book = f'<workbook xmlns="{xlsx.MAIN[1:-1]}" xmlns:r="{xlsx.LINK[1:-3]}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>'
    sheet = f'<worksheet xmlns="{xlsx.MAIN[1:-1]}"><cols><col min="2" max="3" width="12.5"/><col min="4" max="4" hidden="1"/></cols><sheetData><row r="1" ht="20"><c r="A1"><v>1</v></c></row><row r="3" hidden="1"/></sheetData><mergeCells><mergeCell ref="A2:C4"/></mergeCells></worksheet>'
    raw = package(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": xlsx.BOOK_LINKS, "xl/worksheets/sheet1.xml": sheet})
    other = xlsx.with_pictures(xlsx.workbook([("x", "y")], hidden_from=2), [(0, 1, "a.png", b"A"), (None, None, "b.png", b"B")])
    source = spark.createDataFrame([("a", raw), ("b", bytearray(other))], "path string, content binary")
    got = {tuple(r) for r in xlsx.concatenated_layout(source).collect()}
    assert got == {
        ("merge", 2, 1, 4, 3, None, False), ("row", 1, None, 1, None, 20.0, False), ("row", 3, None, 3, None, None, True), ("picture", 5, 2, 5, 2, None, False), ("picture", None, None, None, None, None, False),
        ("column", None, 1, None, 1, 30.0, False), ("column", None, 2, None, 2, 30.0, True), ("column", None, 3, None, 3, 12.5, False), ("column", None, 4, None, 4, None, True),
    }
