"""What lists of packages cost as documents grow: packages are made once and dealt anew however their table is cut, read once, and only levels with a part in a number are rows."""

import io
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import functions as F
from test_sources import BODY, W, package

from quillspark.functions import text as T
from quillspark.operators import folds
from quillspark.plans import document_queries
from quillspark.session import heavy_tasks
from quillspark.sources import docx, docx_repairs as R


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_serialized_is_tostring():
    odd = f'<w:document {W} xmlns:q="urn:q" xmlns:dc="http://purl.org/dc/elements/1.1/"><w:body w:x="a&amp;&quot;&#10;&#9;b" q:y="é">&lt;t&gt;<q:z/> tail &amp; <dc:w xml:space="preserve">\U0001f600</dc:w><plain/></w:body></w:document>'
    for raw in (BODY, odd, "<Types/>", "<x a='1'> </x>", "<x><y/>\n</x>"):
        root = ET.fromstring(raw)
        assert docx.serialized(root) == ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    assert docx.serialized(ET.fromstring("<x>1<y/></x>"), "<a/>", "<b/>").endswith(b"<x>1<a/><y /><b/></x>")


def test_packages_are_dealt_anew(spark, sf):
    """A table may be one row group: neither making nor writing packages may be left to its one task."""
    made = document_queries.made_packages(spark, sf, marker=document_queries.typed_marker)
    tasks = heavy_tasks(spark)
    assert made.rdd.getNumPartitions() == tasks
    lists = spark.createDataFrame([("1", 0, 1, 0, "decimal", 1, "%1.", 3)], "doc_id string, idx long, list_id long, level int, kind string, number long, template string, marker int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert plan_of(R.with_lists(made, lists)).count("hashpartitioning(path#") >= 2
        assert R.with_lists(made, lists).rdd.getNumPartitions() == tasks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="1">{''.join(f'<w:lvl w:ilvl="{k}"><w:start w:val="{k + 2}"/><w:numFmt w:val="{"lowerLetter" if k == 3 else "decimal"}"/><w:lvlText w:val="{t}"/></w:lvl>' for k, t in enumerate(("%1.", "%1.%2-%4", "%3", "%4", "%9")))}</w:abstractNum>
<w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="7"/></w:lvlOverride></w:num><w:num w:numId="3"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="4"><w:abstractNumId w:val="9"/></w:num></w:numbering>"""


def in_lists(spark, places):
    said = "".join(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>t{k}</w:t></w:r></w:p>' if n else "<w:p/>" for k, (n, level) in enumerate(places))
    content = package(**{"word/document.xml": f"<w:document {W}><w:body>{said}</w:body></w:document>", "word/numbering.xml": NUMBERING, "word/header1.xml": f"<w:hdr {W}><w:p/></w:hdr>"})
    return spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(package(**{"word/document.xml": f"<w:document {W}><w:body><w:p/></w:body></w:document>"})))], "path string, content binary")


def test_levels_without_a_part_are_no_rows(spark):
    places = [(1, 0), (1, 1), (0, 0), (2, 0), (1, 1), (2, 2), (1, 0), (2, 0), (1, 1), (4, 0), (1, 7)]
    files = in_lists(spark, places)
    items, levels, deepest = R.items_and_levels(files)
    assert sorted((r["num_id"], int(r["ilvl"]), r["start"]) for r in levels.collect()) == [("1", 0, 2), ("1", 1, 3), ("1", 3, 5), ("2", 0, 7), ("2", 2, 4)]
    assert deepest == 4 and items.count() == sum(n > 0 for n, _ in places)
    shown = lambda df: sorted(tuple(r) for r in df.select("path", "idx", "prefix", "numbered", "digest").collect())
    found = shown(document_queries.numbered_items(items, levels, deepest))
    assert found == shown(document_queries.rendered_lists(R.paragraphs(files), docx.numbering(files)))
    assert [x[2] for x in found] == ["2.", "2.3-e", "7.", "2.4-e", "4", "3.", "8.", "3.3-e", "1.", "8."]


def test_no_lists_at_all(spark):
    files = in_lists(spark, [(0, 0)])
    assert document_queries.numbered_items(*R.items_and_levels(files)).count() == 0


def test_packages_are_read_once_for_items_and_levels(spark):
    """The table of items is cut from its packages, so that its readers read none of them again."""
    items, levels, deepest = R.items_and_levels(in_lists(spark, [(1, 0)]))
    assert "MapInArrow" not in plan_of(document_queries.numbered_items(items, levels, deepest))


def test_markers_are_told_from_the_opening(spark):
    rows = ["1. x y", "  (a)\tb c", "- x", "-", "", "   ", "\t", "1.", "word", "word two", "\t    iv. z\n", " x y"]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    for f in (T.list_prefix, T.opens_with_bullet, T.leading_blanks, T.after_first_word, T.first_word, lambda c: F.trim(c) == ""):
        assert df.where(~f(F.col("text")).eqNullSafe(f(T.opening("text")))).count() == 0
    lines = df.select(F.lit("a").alias("doc_id"), F.monotonically_increasing_id().alias("idx"), "text", F.lit(False).alias("numbered"))
    assert plan_of(folds.list_runs(lines)).count("\\S*\\s*, 0) AS text#") == 1


def test_new_parts_are_declared(spark):
    content = package(**{"[Content_Types].xml": f'<Types xmlns="{R.TYPES_NS}"/>', "word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>1. x</w:t></w:r></w:p></w:body></w:document>'})
    files = spark.createDataFrame([("a", bytearray(content))], "path string, content binary")
    done = R.with_lists(files, R.typed_lists(R.paragraphs(files))).first()
    with zipfile.ZipFile(io.BytesIO(bytes(done["content"]))) as archive:
        assert archive.testzip() is None and len(archive.namelist()) == len(set(archive.namelist()))
        assert b"/word/numbering.xml" in archive.read("[Content_Types].xml") and b"numbering.xml" in archive.read("word/_rels/document.xml.rels")
    assert docx.numbering(files).count() == 0 and docx.numbering(spark.createDataFrame([("a", done["content"])], "path string, content binary")).count() == 9
