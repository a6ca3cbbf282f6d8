"""Word-processing packages as tables.

Packages are read as binary files, so any file system that Spark reads will do, one row for each; a task opens each package in memory and gives rows.
Roles, fingerprints and filters are columns over these rows, not part of the reading. A package's bytes are bounded by what Spark's
binary source allows, and documents never meet in a task.

Read as they are in the wild: the body, or headers, body and footers together (style_map), also inside content controls; the first of alternate
contents, no deleted or field text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.visual import is_real_item
from quillspark.session import heavy_tasks

#: Name spaces: fixed values.
NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "m": "http://schemas.openxmlformats.org/officeDocument/2006/math",
    "v": "urn:schemas-microsoft-com:vml",
    "o": "urn:schemas-microsoft-com:office:office",
    "mc": "http://schemas.openxmlformats.org/markup-compatibility/2006",
    "pr": "http://schemas.openxmlformats.org/package/2006/relationships",
}
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
EMU_PER_POINT, TWIPS_PER_POINT = 12_700, 20

ELEMENTS = "path string, idx int, kind string, text string, style string, num_id string, ilvl string, outline_level int, has_math boolean, source_part string, rel_id string, docpr_id string, docpr_name string, alt_text string, width_pt double, height_pt double"
RELATIONS = "path string, part string, rel_id string, target string, type string"
STYLES = "path string, style_id string, name string, based_on string, outline_level int"
LEVELS = "path string, num_id string, ilvl string, start int, num_fmt string, lvl_text string"

for _prefix, _uri in NS.items():
    ET.register_namespace(_prefix, _uri)
#: Prefixes that serialized() gives: those registered here, and what ElementTree knows by itself.
PREFIXES = {uri: prefix for prefix, uri in NS.items()} | {
    "http://www.w3.org/XML/1998/namespace": "xml", "http://www.w3.org/1999/xhtml": "html", "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf", "http://schemas.xmlsoap.org/wsdl/": "wsdl",
    "http://www.w3.org/2001/XMLSchema": "xs", "http://www.w3.org/2001/XMLSchema-instance": "xsi", "http://purl.org/dc/elements/1.1/": "dc",
}


@cache
def tag(name: str) -> str:
    prefix, local = name.split(":")
    return f"{{{NS[prefix]}}}{local}"


@cache
def steps(path: str) -> tuple[str, ...]:
    return tuple(map(tag, path.split("/")))


def value(node: ET.Element | None, path: str, attribute: str = "w:val") -> str | None:
    """The attribute of the first node at the path; steps of full names are taken without Python."""
    if node is None:
        return None
    *outer, last = steps(path)
    nodes = [node]
    for name in outer:
        nodes = [x for n in nodes for x in n.findall(name)]
    for n in nodes:
        if (found := n.find(last)) is not None:
            return found.get(tag(attribute))
    return None


def whole(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isdigit() else None


def packages(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every .docx below the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")


def part(archive: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(archive.read(name)) if name in archive.namelist() else None


#: What a paragraph's children are to its reader; any other one is looked into.
SIGNS = {tag("w:tab"): "\t", tag("w:br"): "\n", tag("w:cr"): "\n"}
SHOWN = {tag("w:drawing"): "drawing", tag("w:pict"): "shape", tag("w:object"): "shape", tag("m:oMath"): "formula", tag("m:oMathPara"): "formula"}
PASSED = frozenset(map(tag, ("w:pPr", "w:rPr", "w:instrText", "w:delText", "w:del")))
TEXT, ALTERNATES = tag("w:t"), tag("mc:AlternateContent")


def fragments(node: ET.Element) -> Iterator[tuple[str, ET.Element | str]]:
    """Of a paragraph, in order: its text, drawings, VML shapes and formulas. Of alternate contents the choice, else the fallback."""
    for child in node:
        name = child.tag
        if name == TEXT:
            yield "text", child.text or ""
        elif name in SIGNS:
            yield "text", SIGNS[name]
        elif name in SHOWN:
            yield SHOWN[name], child
        elif name == ALTERNATES:
            chosen = child.find("mc:Choice", NS)
            yield from fragments(chosen if chosen is not None and len(chosen) else child.find("mc:Fallback", NS) or ET.Element("none"))
        elif name not in PASSED:
            yield from fragments(child)


def visual(kind: str, node: ET.Element) -> dict:
    if kind == "drawing":
        props, size, blip = node.find(".//wp:docPr", NS), node.find(".//wp:extent", NS), node.find(".//a:blip", NS)
        at = props.attrib if props is not None else {}
        points = [int(size.get(c)) / EMU_PER_POINT if size is not None and whole(size.get(c)) is not None else None for c in ("cx", "cy")]
        return {"kind": "drawing", "text": "", "docpr_id": at.get("id"), "docpr_name": at.get("name"), "alt_text": at.get("descr") or at.get("title") or "", "rel_id": blip.get(tag("r:embed")) if blip is not None else None, "width_pt": points[0], "height_pt": points[1]}
    if kind == "shape":
        shape, image, ole = node.find(".//v:shape", NS), node.find(".//v:imagedata", NS), node.find(".//o:OLEObject", NS)
        at = shape.attrib if shape is not None else {}
        return {"kind": "ole" if ole is not None else "shape", "text": "", "docpr_id": at.get("id"), "docpr_name": ole.get("ProgID") if ole is not None else None, "alt_text": at.get("alt") or at.get("title") or "", "rel_id": image.get(tag("r:id")) if image is not None else None}
    return {"kind": "formula", "text": "".join(x.text or "" for x in node.iter(tag("m:t"))), "alt_text": ""}


def paragraph_rows(node: ET.Element, source: str) -> Iterator[dict]:
    found = list(fragments(node))
    props = node.find("w:pPr", NS)
    common = {"style": value(props, "w:pStyle"), "num_id": value(props, "w:numPr/w:numId"), "ilvl": value(props, "w:numPr/w:ilvl"), "outline_level": whole(value(props, "w:outlineLvl")), "source_part": source}
    text = "".join(x for kind, x in found if kind == "text")
    others = [visual(kind, x) for kind, x in found if kind != "text"]
    has_math = any(x["kind"] == "formula" or x["kind"] == "ole" and "equation" in (x["docpr_name"] or "").lower() for x in others)
    if text.strip() or not others:
        yield {"kind": "text", "text": text, "has_math": has_math, "alt_text": None} | common
    for x in others:
        yield {"has_math": x["kind"] == "formula"} | common | x


def element_rows(content: bytes, source: str = "word/document.xml") -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = part(archive, source)
    yield from part_rows(root, source)


def part_rows(root: ET.Element | None, source: str) -> Iterator[dict]:
    body = root.find("w:body", NS) if root is not None else None
    body = root if body is None else body
    for block in blocks(body) if body is not None else ():
        if block.tag == tag("w:p"):
            yield from paragraph_rows(block, source)
        elif block.tag == tag("w:tbl"):
            cells = ["".join(t.text or "" for t in c.iter(tag("w:t"))) for c in block.iter(tag("w:tc"))]
            described = value(block.find("w:tblPr", NS), "w:tblDescription")
            yield {"kind": "table", "text": " ".join(filter(None, cells)), "alt_text": described or "", "has_math": False, "source_part": source}
            for p in block.iter(tag("w:p")):
                yield from (x for x in paragraph_rows(p, source) if x["kind"] != "text")


def blocks(node: ET.Element) -> Iterator[ET.Element]:
    """Paragraphs and tables in order, also those in content controls."""
    for child in node:
        if child.tag == tag("w:sdt"):
            inner = child.find("w:sdtContent", NS)
            yield from blocks(inner) if inner is not None else ()
        else:
            yield child


def map_rows(content: bytes) -> Iterator[dict]:
    """The elements of headers, the body and footers, in this order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        yield from zone_rows(archive)


def zone_rows(archive: zipfile.ZipFile) -> Iterator[dict]:
    names = sorted(archive.namelist())
    heads, feet = ([n for n in names if re.fullmatch(rf"word/{kind}[0-9]*\.xml", n)] for kind in ("header", "footer"))
    for name in [*heads, "word/document.xml", *feet]:
        zone = "header" if name in heads else "footer" if name in feet else "body"
        yield from (x | {"zone": zone} for x in part_rows(part(archive, name), name))


def storage_rows(content: bytes) -> Iterator[dict]:
    """How a package keeps its formulas, for each part: as formulas (whole paragraphs of them only where there are no others) or as objects of a program."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in sorted(archive.namelist()):
            if name.startswith("word/") and name.endswith(".xml"):
                root = part(archive, name)
                formulas = len(list(root.iter(tag("m:oMath")))) or len(list(root.iter(tag("m:oMathPara"))))
                yield {"part": name, "formulas": formulas, "programs": [x.get("ProgID") or "" for x in root.iter(tag("o:OLEObject"))]}


def relation_rows(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        yield from links(archive)


def links(archive: zipfile.ZipFile) -> Iterator[dict]:
    for name in archive.namelist():
        if name.startswith("word/_rels/"):
            for x in ET.fromstring(archive.read(name)):
                yield {"part": "word/" + name.removeprefix("word/_rels/").removesuffix(".rels"), "rel_id": x.get("Id"), "target": x.get("Target"), "type": (x.get("Type") or "").rpartition("/")[2]}


def style_rows(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = part(archive, "word/styles.xml")
    for x in root.iter(tag("w:style")) if root is not None else ():
        yield {"style_id": x.get(tag("w:styleId")), "name": value(x, "w:name"), "based_on": value(x, "w:basedOn"), "outline_level": whole(value(x, "w:pPr/w:outlineLvl"))}


def lists_of(root: ET.Element | None) -> Iterator[tuple[str, dict[str, int], list[ET.Element]]]:
    """Each list of a numbering part: its number, the starts of levels that it overrides, and the levels of its format, which lists share."""
    if root is None:
        return
    formats, none = {x.get(tag("w:abstractNumId")): x.findall(tag("w:lvl")) for x in root.iter(tag("w:abstractNum"))}, []
    for num in root.findall(tag("w:num")):
        starts = {x.get(tag("w:ilvl")): n for x in num.findall(tag("w:lvlOverride")) if (n := whole(value(x, "w:startOverride"))) is not None}
        yield num.get(tag("w:numId")), starts, formats.get(value(num, "w:abstractNumId"), none)


def level_of(x: ET.Element) -> tuple[str | None, int, str, str | None]:
    """ilvl, start, num_fmt, lvl_text"""
    first = whole(value(x, "w:start"))
    return x.get(tag("w:ilvl")), 1 if first is None else first, value(x, "w:numFmt") or "decimal", value(x, "w:lvlText")


def level_rows(content: bytes) -> Iterator[tuple]:
    """The levels of each list, starts overridden where the list says so."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = part(archive, "word/numbering.xml")
    for num_id, starts, levels in lists_of(root):
        for k, start, *shown in map(level_of, levels):
            yield num_id, k, starts.get(k, start), *shown


ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
#: Rows that a task gives at a time.
OUT_ROWS = 5000


def _table(source: DataFrame, rows: Callable[[bytes], Iterator[dict]], schema: str, counted: bool = False, only: Callable[[dict], bool] = lambda x: True) -> DataFrame:
    """rows() of every package, with its path and, if counted, their number; `only` leaves out some without changing the others' numbers."""
    names = [x.split()[0] for x in schema.split(", ")][1:]

    def tuples(content: bytes) -> Iterator[tuple]:
        for k, x in enumerate(rows(content)):
            if only(x):
                x = x | {"idx": k} if counted else x
                yield tuple(map(x.get, names))

    return package_rows(source, tuples, schema)


def package_rows(source: DataFrame, rows: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """rows() of every package behind its path, which comes first in the schema. One package is held at a time, and OUT_ROWS rows of any."""
    out_schema = pa.schema([(name, ARROW[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((path, x) for given in batches for path, content in zip(given.column(0).to_pylist(), given.column(1), strict=True) for x in rows(content.as_py()))
        while out := list(islice(found, OUT_ROWS)):
            paths, own = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((paths, *zip(*own, strict=True)), out_schema, strict=True)], schema=out_schema)

    return source.select("path", "content").mapInArrow(run, schema)


def _judged(rows: DataFrame) -> DataFrame:
    equation = F.col("kind").isin("formula") | F.lower(F.coalesce("docpr_name", F.lit(""))).contains("equation")
    paragraph = T.paragraph_role("text", "style", "num_id", F.col("has_math"), T.is_equation_like("text"), F.col("outline_level"))
    role = F.when(F.col("kind") == "text", paragraph).when(F.col("kind") == "table", "table").when(equation, "equation").otherwise("image")
    return rows.withColumns({"role": role, "fingerprint": T.fingerprint("text"), "has_alt_text": ~T.is_effectively_empty("alt_text")})


def elements(source: DataFrame, source_part: str = "word/document.xml") -> DataFrame:
    """Text, tables, drawings, shapes and formulas of each package in order, with role and fingerprint."""
    return _judged(_table(source, lambda content: element_rows(content, source_part), ELEMENTS, counted=True))


def style_map(source: DataFrame) -> DataFrame:
    """elements() of headers, body and footers together, numbered through, with their zone."""
    return _judged(_table(source, map_rows, ELEMENTS + ", zone string", counted=True))


def formula_storage(source: DataFrame) -> DataFrame:
    """path, formulas, objects, and programs: the distinct programs of objects that a package holds, sorted."""
    rows = _table(source, storage_rows, "path string, part string, formulas long, programs array<string>")
    programs = F.flatten(F.collect_list("programs"))
    return rows.groupBy("path").agg(F.sum("formulas").alias("formulas"), F.sum(F.size("programs")).alias("objects"), F.array_sort(F.array_distinct(F.filter(programs, lambda x: x != ""))).alias("programs"))


def relations(source: DataFrame) -> DataFrame:
    return _table(source, relation_rows, RELATIONS)


def styles(source: DataFrame) -> DataFrame:
    return _table(source, style_rows, STYLES)


def numbering(source: DataFrame) -> DataFrame:
    return package_rows(source, level_rows, LEVELS)


#: Elements that can be items of the inventory: a formula of its own has no visual node, and text no sign of a picture.
CARRIERS = ("drawing", "shape", "ole")


def item_rows(content: bytes) -> Iterator[dict]:
    """map_rows() with what their relations refer to."""
    targets: dict[tuple, str | None] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for x in links(archive):
            targets.setdefault((x["part"], x["rel_id"]), x["target"])
        yield from (x | {"media_target": targets.get((x["source_part"], x.get("rel_id")))} for x in zone_rows(archive))


def inventory(source: DataFrame) -> DataFrame:
    """The visual items of each package, headers and footers included: images and formulas that can carry a text and are no remains, with their target. Each package is read once."""
    items = _table(source, item_rows, ELEMENTS + ", media_target string", counted=True, only=lambda x: x["kind"] in CARRIERS)
    equation = F.lower(F.coalesce("docpr_name", F.lit(""))).contains("equation")
    items = items.withColumns({"role": F.when(equation, "equation").otherwise("image"), "has_alt_text": ~T.is_effectively_empty("alt_text")})
    target = F.when(F.col("media_target").startswith("/"), F.ltrim("media_target", F.lit("/"))).otherwise(F.concat(F.lit("word/"), "media_target"))
    none = F.lit(None).cast("string")
    program = F.when(F.col("kind") == "ole", F.col("docpr_name"))
    known = {"target": target, "image_target": target, "ole_target": none, "rel_id": F.col("rel_id"), "docpr_name": F.when(F.col("kind") != "ole", F.col("docpr_name")), "prog_id": program, "math_source": none, "width_pt": F.col("width_pt"), "height_pt": F.col("height_pt")}
    label = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.col("alt_text"))
    items = items.where(is_real_item(F.col("role"), label, F.col("has_alt_text"), known))
    given = T.collapse("alt_text")
    return items.select("path", F.col("idx").alias("id"), "role", "source_part", "docpr_id", "docpr_name", "media_target", "width_pt", "height_pt", "has_alt_text", given.alias("existing_alt_text"), given.alias("alt_text"), F.lit("").alias("generated_alt_text"), F.when(given != "", "existing").otherwise("missing").alias("alt_source"))


def validated(source: DataFrame) -> DataFrame:
    """path and error: null for a package that can be read."""

    def missing(content: pd.Series) -> pd.Series:
        def look(raw: bytes) -> str | None:
            if bytes(raw[:4]) == b"%PDF":
                return "this is a PDF"
            if bytes(raw[:4]) == b"\xd0\xcf\x11\xe0":
                return "this is a binary document of the old kind"
            try:
                names = set(zipfile.ZipFile(io.BytesIO(bytes(raw))).namelist())
            except zipfile.BadZipFile:
                return "this is no ZIP package"
            lost = [x for x in REQUIRED if x not in names]
            nested = [x for x in sorted(names) if x.lower().endswith(".docx")]
            return None if not lost else f"parts are missing: {', '.join(lost)}" + (f"; it holds {nested[0]}" if nested else "")

        return content.map(look)

    return source.select("path", F.pandas_udf(missing, "string")("content").alias("error"))


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def quoted(text: str) -> str:
    return escaped(text).replace('"', "&quot;").replace("\r", "&#13;").replace("\n", "&#10;").replace("\t", "&#09;")


def serialized(root: ET.Element, first: str = "", last: str = "") -> bytes:
    """The bytes of ET.tostring() for a parsed tree, in one pass over it. first and last: XML in the root's own prefixes that is put before and behind its children."""
    prefixes: dict[str, str] = {}
    names: dict[str, str] = {}
    out: list[str] = []

    def named(full: str) -> str:
        if full[:1] == "{":
            uri, _, local = full[1:].rpartition("}")
            if uri not in prefixes:
                prefixes[uri] = PREFIXES.get(uri) or f"ns{len(prefixes)}"
            names[full] = f"{prefixes[uri]}:{local}"
        else:
            names[full] = full
        return names[full]

    def walk(node: ET.Element) -> None:
        name = names.get(node.tag) or named(node.tag)
        given = "".join([f' {names.get(k) or named(k)}="{v if v.isalnum() else quoted(v)}"' for k, v in node.items()])
        text = node.text
        if len(node):
            put(f"<{name}{given}>{escaped(text)}" if text else f"<{name}{given}>")
            for child in node:
                walk(child)
                if child.tail:
                    put(escaped(child.tail))
            put(f"</{name}>")
        else:
            put(f"<{name}{given}>{escaped(text)}</{name}>" if text else f"<{name}{given} />")

    put = out.append
    name = named(root.tag)
    put(f"<{name}" + "".join([f' {named(k)}="{quoted(v)}"' for k, v in root.items()]))
    put(f">{escaped(root.text or '')}{first}")
    for child in root:
        walk(child)
        put(escaped(child.tail or ""))
    if len(root) or root.text or first or last:
        put(f"{last}</{name}>")
    else:
        out[1:] = [" />"]
    out[0] += "".join(f' xmlns:{prefix}="{quoted(uri)}"' for uri, prefix in sorted(prefixes.items(), key=lambda x: x[1]) if prefix != "xml")
    return ("<?xml version='1.0' encoding='UTF-8'?>\n" + "".join(out)).encode()


def rewritten(content: bytes, change: Callable[[str, ET.Element], int], trees: dict[str, ET.Element] | None = None, others: dict[str, bytes] | None = None) -> tuple[bytes, int]:
    """The package with `change` applied to every XML part below word/; parts that don't change stay byte for byte. trees: parts that are parsed already; others: parts that come in place of old ones or are new, as they are."""
    out, total, trees, others = io.BytesIO(), 0, trees or {}, others or {}
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as new:
        for item in old.infolist():
            name = item.filename
            if name in others:
                new.writestr(item, others[name], compresslevel=1)
                continue
            raw = None
            if name.startswith("word/") and name.endswith(".xml"):
                root = trees[name] if name in trees else ET.fromstring(old.read(name))
                if n := change(name, root):
                    raw, total = serialized(root), total + n
            new.writestr(item, old.read(name) if raw is None else raw, compresslevel=1)
        for name in sorted(others.keys() - set(old.namelist())):
            new.writestr(name, others[name])
    return out.getvalue(), total


def put_text(node: ET.Element, main: str, text: str) -> int:
    """Sets or removes the attribute; the title goes."""
    before = dict(node.attrib)
    node.attrib.pop("title", None)
    node.attrib.pop(main, None)
    if text:
        node.set(main, text)
    return int(before != node.attrib)


#: Bytes of packages that a task gives at a time.
OUT_BYTES = 4 << 20


def in_batches(rows: Iterable[tuple], schema: pa.Schema, content: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows of packages, their content second if not said otherwise, in batches of OUT_BYTES or so."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        out.append(row)
        held += len(row[content] or b"")
        if held >= OUT_BYTES or len(out) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


WRITTEN = pa.schema([("path", pa.string()), ("content", pa.binary()), ("changed", pa.int64())])


def each_package(source: DataFrame, repairs: DataFrame, write: Callable[[bytes, list[dict]], tuple[bytes, int]]) -> DataFrame:
    """path, content, changed: write() of every package and the rows of repairs (path, ...) that are its own, in any order. A package meets them as one row, so that many small packages cost no more than their bytes."""
    tasks = heavy_tasks(source.sparkSession)
    own = repairs.repartition(tasks, "path").groupBy("path").agg(F.collect_list(F.struct(*[c for c in repairs.columns if c != "path"])).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[tuple]:
            for given in batches:
                own = given.column(2)
                flat, counts = own.flatten(), pc.fill_null(pc.list_value_length(own), 0).to_pylist()
                rows = (dict(zip(flat.type.names, x, strict=True)) for x in zip(*(c.to_pylist() for c in flat.flatten()), strict=True))
                for path, content, n in zip(given.column(0).to_pylist(), given.column(1), counts, strict=True):
                    yield path, *write(content.as_py(), list(islice(rows, n)))

        return in_batches(done(), WRITTEN)

    dealt = source.select("path", "content").repartition(tasks, "path")  # a package costs much more time than its bytes say
    return dealt.join(own, "path", "left").select("path", "content", "own").mapInArrow(run, "path string, content binary, changed long")


def with_texts(source: DataFrame, texts: DataFrame) -> DataFrame:
    """path, content, changed: packages with the texts (path, source_part, docpr_id, alt_text) written to the matching drawings and shapes. One document at a time."""

    def write(content: bytes, mine: list[dict]) -> tuple[bytes, int]:
        wanted = {(x["source_part"], x["docpr_id"]): x["alt_text"] or "" for x in mine}

        def change(name: str, root: ET.Element) -> int:
            n = 0
            for node in root.iter(tag("wp:docPr")):
                if (name, node.get("id")) in wanted:
                    n += put_text(node, "descr", wanted[name, node.get("id")])
            for node in root.iter(tag("v:shape")):
                if (name, node.get("id")) in wanted:
                    n += put_text(node, "alt", wanted[name, node.get("id")])
            return n

        return rewritten(content, change)

    return each_package(source, texts.select("path", "source_part", "docpr_id", "alt_text"), write)


def without_texts(source: DataFrame) -> DataFrame:
    """path, content, changed: packages without any alternative text; changed counts the attributes that went."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def change(_: str, root: ET.Element) -> int:
            n = 0
            for name, attributes in (("wp:docPr", ("descr", "title")), ("v:shape", ("alt", "title")), ("o:OLEObject", ("title", "descr"))):
                for node in root.iter(tag(name)):
                    n += sum(node.attrib.pop(x, None) is not None for x in attributes)
            return n

        for batch in batches:
            done = [rewritten(bytes(x), change) for x in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "content": [c for c, _ in done], "changed": [n for _, n in done]})

    return source.mapInPandas(run, "path string, content binary, changed long")
