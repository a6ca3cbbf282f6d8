"""Packages whose lists and colours are repaired, read again."""

from pyspark.sql import functions as F
from test_sources import RELS, W, package

from quillspark.functions import colour
from quillspark.plans.document_queries import rendered_lists
from quillspark.sources import docx, docx_repairs as R

TYPED = ["1. one", "2. two", "    (a) below", "    (b)\tbelow too", "3. three", "- bullet", "plain", "4. later", "", "iv. roman", "x"]
THEME = f'<a:theme {W}><a:clrScheme name="x"><a:dk1><a:sysClr val="windowText" lastClr="101010"/></a:dk1><a:accent1><a:srgbClr val="ffee00"/></a:accent1></a:clrScheme></a:theme>'
RUNS = [
    '<w:color w:val="FFFF00"/>', "", '<w:color w:themeColor="accent1" w:themeShade="80"/>', '<w:color w:themeColor="text1"/>', '<w:color w:themeColor="accent6"/>', '<w:color w:val="auto"/><w:highlight w:val="black"/>',
    '<w:rStyle w:val="Pale"/>', '<w:color w:val="FFFFFF"/><w:shd w:fill="000000"/>',
]


def in_package(spark, body, **parts):
    document = f'<w:document {W}><w:body>{body}</w:body></w:document>'
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'
    content = package(**{"[Content_Types].xml": types, "word/document.xml": document, "word/_rels/document.xml.rels": RELS, **parts})
    return spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(package(**{"word/document.xml": f"<w:document {W}><w:body><w:p/></w:body></w:document>"})))], "path string, content binary")


def test_typed_lists(spark):
    files = in_package(spark, "".join(f'<w:p><w:pPr><w:jc w:val="left"/><w:ind w:left="10"/></w:pPr><w:r><w:t>{x[:3]}</w:t></w:r><w:r><w:t>{x[3:]}</w:t></w:r></w:p>' for x in TYPED))
    done = R.with_lists(files, R.typed_lists(R.paragraphs(files))).cache()
    assert sorted((r["path"], r["changed"]) for r in done.collect()) == [("a", 8), ("b", 0)]
    again = done.select("path", "content")
    rows = R.paragraphs(again).where("doc_id = 'a'").orderBy("idx").collect()
    assert [r["text"] for r in rows] == ["one", "two", "below", "below too", "three", "bullet", "plain", "later", "", "roman", "x"]
    assert [r["level"] for r in rows] == [0, 0, 1, 1, 0, 0, None, 0, None, 0, None]
    shown = {r["idx"]: r["prefix"] for r in rendered_lists(R.paragraphs(again), docx.numbering(again)).collect()}
    assert shown == {0: "1.", 1: "2.", 2: "(a)", 3: "(b)", 4: "3.", 5: R.BULLET, 7: "4.", 9: "iv."}
    untouched = {r["path"]: bytes(r["content"]) for r in files.collect()}["b"]
    assert bytes(again.where("path = 'b'").first()["content"]) == untouched
    assert R.typed_lists(R.paragraphs(again)).count() == 0  # what is a list stays as it is


def test_colours_of_runs(spark):
    styles = f'<w:styles {W}><w:style w:styleId="Pale"><w:rPr><w:color w:val="EEEEEE"/></w:rPr></w:style></w:styles>'
    body = "<w:p>" + "".join(f"<w:r><w:rPr>{x}</w:rPr><w:t>t</w:t></w:r>" for x in RUNS) + '</w:p><w:tbl><w:tblPr><w:shd w:fill="222222"/></w:tblPr><w:tr><w:tc><w:p><w:r><w:t>dark</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    files = in_package(spark, body, **{"word/theme/theme1.xml": THEME, "word/styles.xml": styles})
    found = R.runs(files).where("doc_id = 'a'").orderBy("run_no").collect()
    assert [r["color"] for r in found] == ["FFFF00", None, "807700", "101010", "777777", "000000", None, "FFFFFF", None]
    assert [r["shading"] for r in found][7] == "000000" and found[8]["nested_shading"] == "222222" and found[6]["run_style"] == "Pale"
    assert [tuple(r)[1:] for r in R.style_colours(files).collect()] == [("Pale", None, "EEEEEE", None)]
    new = spark.createDataFrame([("a", "word/document.xml", 0, "757500"), ("a", "word/document.xml", 1, "#111111"), ("a", "word/document.xml", 2, None)], "doc_id string, part string, run_no long, new_color string")
    done = R.with_colours(files, new)
    assert sorted((r["path"], r["changed"]) for r in done.collect()) == [("a", 2), ("b", 0)]
    again = R.runs(done.select("path", "content")).where("doc_id = 'a'").orderBy("run_no").collect()
    assert [r["color"] for r in again] == ["757500", "111111", *[r["color"] for r in found][2:]]


def test_tints_are_those_of_columns(spark):
    cases = [("FFEE00", "80", None), ("123456", None, "BF"), ("000000", "7F", "33"), ("ABCDEF", None, None)]
    df = spark.createDataFrame([(*c, R.tinted(*c)) for c in cases], "c string, t string, s string, want string")
    assert df.where(colour.tinted(F.col("c"), F.col("t"), F.col("s")) != F.col("want")).count() == 0
