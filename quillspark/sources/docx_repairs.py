"""Colours and typed lists of word-processing packages: read as rows, repaired by columns and folds, and written back.

Reading gives one row for each run or paragraph, with its place in its part, which is what a repair refers to. A package is written in one task, with its own repairs
alone; parts that nothing changes stay byte for byte.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from types import SimpleNamespace
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import folds
from quillspark.operators.numbering import LEVELS
from quillspark.session import cut
from quillspark.sources.docx import NS, SIGNS, TEXT, _table, each_package, level_of, lists_of, package_rows, part, quoted, rewritten, serialized, tag, value, whole

#: The names by which a theme's colours are called, those of its slots, and what a colour is that the theme lacks.
THEME_SLOTS = {"text1": "dk1", "dark1": "dk1", "background1": "lt1", "light1": "lt1", "text2": "dk2", "dark2": "dk2", "background2": "lt2", "light2": "lt2", "hyperlink": "hlink", "followedhyperlink": "folhlink"}
NO_THEME_COLOUR, BLACK = "777777", "000000"
NO_FILL = ("auto", "clear", "nil")
SHADED = {"w:p": "w:pPr", "w:tc": "w:tcPr", "w:tr": "w:trPr", "w:tbl": "w:tblPr"}
RUNS = "path string, part string, run_no long, color string, shading string, nested_shading string, highlight string, run_style string, para_style string, table_style string"
STYLE_COLOURS = "path string, style_id string, based_on string, color string, shading string"
PARAGRAPHS = "path string, part string, idx long, text string, numbered boolean, num_id string, level int, style string, twips int"
ITEMS = "path string, idx long, text string, num_id string, level int, start int, num_fmt string, lvl_text string"
PARAGRAPH, PROPERTIES, RUN, NUMBER = map(tag, ("w:p", "w:pPr", "w:r", "w:numPr"))
#: What stands before the list number among a paragraph's properties: fixed values.
BEFORE_NUMBER = ("pStyle", "keepNext", "keepLines", "pageBreakBefore", "framePr", "widowControl")
INDENTS = ("left", "start", "firstLine", "hanging")
#: Twips of a level's indent: of the first, of the first with letters, each further, and what the number hangs out.
FIRST_INDENT, FIRST_LETTER_INDENT, NEXT_INDENT, HANGING = 720, 1080, 720, 360
BULLET = "•"
EMPTY_NUMBERING = f'<w:numbering xmlns:w="{NS["w"]}"/>'
NUMBERING_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"
TYPES_NS = "http://schemas.openxmlformats.org/package/2006/content-types"
RELATION_TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/numbering"


def content_parts(names: list[str], notes: bool = True) -> list[str]:
    """The document, then headers, footers, and notes and comments if wanted."""
    kinds = ("document", "header", "footer", *(("footnotes", "endnotes", "comments") if notes else ()))
    return [n for kind in kinds for n in sorted(names) if n.startswith(f"word/{kind}") and n.endswith(".xml") and n.count("/") == 1]


def theme(archive: zipfile.ZipFile) -> dict[str, str]:
    root = part(archive, "word/theme/theme1.xml")
    found = {}
    for scheme in root.iter(tag("a:clrScheme")) if root is not None else ():
        for slot in scheme:
            at = next((x.attrib for x in slot), slot.attrib)
            if at.get("lastClr") or at.get("val"):
                found[slot.tag.rpartition("}")[2].lower()] = (at.get("lastClr") or at["val"]).upper()
    return found


def tinted(base: str, tint: str | None, shade: str | None) -> str:
    """functions.colour.tinted() for one colour of a theme."""
    light = [int(base[k : k + 2], 16) for k in (0, 2, 4)]
    if tint:
        light = [round(c + (255 - c) * (int(tint, 16) / 255)) for c in light]
    if shade:
        light = [round(c * (int(shade, 16) / 255)) for c in light]
    return "".join(f"{c:02X}" for c in light)


def named(node: ET.Element, known: dict[str, str], plain: str, themed: str, lacking: str | None) -> str | None:
    """The colour of a node that gives one or calls one of the theme by name, with its tint and shade; None if it does neither."""
    own, name = node.get(tag(f"w:{plain}")), node.get(tag(f"w:{themed}"))
    if own and own.lower() not in NO_FILL:
        return own
    if not name:
        return None
    base, way = known.get(name.lower()) or known.get(THEME_SLOTS.get(name.lower(), "")) or lacking, themed.removesuffix("Color")
    return tinted(base, node.get(tag(f"w:{way}Tint")), node.get(tag(f"w:{way}Shade"))) if base else None


def text_colour(props: ET.Element | None, known: dict[str, str]) -> str | None:
    node = props.find("w:color", NS) if props is not None else None
    return None if node is None else named(node, known, "val", "themeColor", NO_THEME_COLOUR) or BLACK


def fill(props: ET.Element | None, known: dict[str, str]) -> str | None:
    node = props.find("w:shd", NS) if props is not None else None
    return None if node is None else named(node, known, "fill", "themeFill", None)


@dataclass(frozen=True)
class Around:
    """What a run inherits from the paragraph, cells and tables it is in."""

    ground: str | None = None
    para_style: str | None = None
    table_style: str | None = None


def runs_in(node: ET.Element, known: dict[str, str], around: Around = Around()) -> Iterator[tuple[ET.Element, Around]]:
    for child in node:
        inner = around
        for name, props in SHADED.items():
            if child.tag == tag(name):
                own = child.find(props, NS)
                inner = replace(around, ground=fill(own, known) or around.ground)
                if name == "w:p":
                    inner = replace(inner, para_style=value(own, "w:pStyle") or around.para_style)
                elif name == "w:tbl":
                    inner = replace(inner, table_style=value(own, "w:tblStyle") or around.table_style)
        if child.tag == tag("w:r"):
            yield child, inner
        yield from runs_in(child, known, inner)


def run_rows(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        known = theme(archive)
        for name in content_parts(archive.namelist()):
            for n, (run, around) in enumerate(runs_in(part(archive, name), known)):
                props = run.find("w:rPr", NS)
                own = {"color": text_colour(props, known), "shading": fill(props, known), "highlight": value(props, "w:highlight"), "run_style": value(props, "w:rStyle")}
                yield own | {"part": name, "run_no": n, "nested_shading": around.ground, "para_style": around.para_style, "table_style": around.table_style}


def style_rows(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        known, root = theme(archive), part(archive, "word/styles.xml")
    for x in root.iter(tag("w:style")) if root is not None else ():
        ground = next(filter(None, (fill(x.find(props, NS), known) for props in ("w:rPr", "w:pPr", "w:tblPr"))), None)
        yield {"style_id": x.get(tag("w:styleId")), "based_on": value(x, "w:basedOn"), "color": text_colour(x.find("w:rPr", NS), known), "shading": ground}


def runs(source: DataFrame) -> DataFrame:
    """The text runs of packages as contrast.effective() takes them: doc_id is the path; a theme's colours are resolved, with their tints and shades."""
    return _table(source, run_rows, RUNS).withColumnRenamed("path", "doc_id")


def style_colours(source: DataFrame) -> DataFrame:
    return _table(source, style_rows, STYLE_COLOURS).withColumnRenamed("path", "doc_id")


def _child(node: ET.Element, name: str, **attributes: object) -> ET.Element:
    return ET.SubElement(node, tag(name), {tag(f"w:{k}"): str(v) for k, v in attributes.items()})


def _properties(node: ET.Element, name: str) -> ET.Element:
    """The node's properties, made as its first child where there are none."""
    found = node.find(tag(name))
    if found is None:
        found = ET.Element(tag(name))
        node.insert(0, found)
    return found


def with_colours(source: DataFrame, colours: DataFrame) -> DataFrame:
    """path, content, changed: packages with new colours, such as contrast.repaired() gives (doc_id, part, run_no, new_color) of runs; rows without one change nothing."""

    def write(content: bytes, mine: list[dict]) -> tuple[bytes, int]:
        wanted = {(x["part"], x["run_no"]): x["new_color"] for x in mine}

        def change(name: str, root: ET.Element) -> int:
            changed = 0
            for n, (run, _) in enumerate(list(runs_in(root, {}))):
                if new := wanted.get((name, n)):
                    props = _properties(run, "w:rPr")
                    for old in props.findall("w:color", NS):
                        props.remove(old)
                    _child(props, "w:color", val=new.lstrip("#"))
                    changed += 1
            return changed

        return rewritten(content, change)

    mine = colours.where("new_color is not null").select(F.col("doc_id").alias("path"), "part", "run_no", "new_color")
    return each_package(source, mine, write)


def run_text(run: ET.Element) -> list[tuple[ET.Element, str]]:
    return [(x, x.text or "" if x.tag == TEXT else SIGNS[x.tag]) for x in run if x.tag == TEXT or x.tag in SIGNS]


def paragraph_text(p: ET.Element) -> str:
    return "".join([t for run in p.findall(RUN) for _, t in run_text(run)])


def numbered_trees(archive: zipfile.ZipFile) -> Iterator[tuple[int, str, ET.Element]]:
    """The parts with paragraphs, each with the number of its first one; they are numbered through."""
    at = 0
    for name in content_parts(archive.namelist(), notes=False):
        root = part(archive, name)
        yield at, name, root
        at += sum(1 for _ in root.iter(PARAGRAPH))


def paragraph_rows(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        styles = part(archive, "word/styles.xml")
        names = {x.get(tag("w:styleId")): value(x, "w:name") for x in styles.iter(tag("w:style"))} if styles is not None else {}
        for first, name, root in numbered_trees(archive):
            for at, p in enumerate(root.iter(PARAGRAPH), first):
                props, text = p.find(PROPERTIES), paragraph_text(p)
                if props is None:
                    yield name, at, text, False, None, None, None, None
                    continue
                style = value(props, "w:pStyle")
                yield name, at, text, props.find(NUMBER) is not None, value(props, "w:numPr/w:numId"), whole(value(props, "w:numPr/w:ilvl")), names.get(style, style), whole(value(props, "w:ind", "w:left"))


def paragraphs(source: DataFrame) -> DataFrame:
    """The paragraphs of body, headers and footers, numbered through: doc_id is the path."""
    return package_rows(source, paragraph_rows, PARAGRAPHS).withColumnRenamed("path", "doc_id")


def item_rows(content: bytes) -> Iterator[tuple]:
    """The paragraphs that are items of lists, and of each list the levels that its items are on or that these levels' templates read: no other level has a part in any number."""
    used: dict[str, set[int]] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for first, _, root in numbered_trees(archive):
            for at, p in enumerate(root.iter(PARAGRAPH), first):
                props = p.find(PROPERTIES)
                num_id = value(props, "w:numPr/w:numId") if props is not None else None
                if num_id is not None:
                    level = whole(value(props, "w:numPr/w:ilvl"))
                    used.setdefault(num_id, set()).add(level)
                    yield at, paragraph_text(p), num_id, level, None, None, None
        formats: dict[int, dict[int | None, list[tuple]]] = {}  # by the format's levels, which its lists share
        for num_id, starts, levels in lists_of(part(archive, "word/numbering.xml")):
            if own := used.get(num_id):
                if id(levels) not in formats:
                    formats[id(levels)] = by_level = {}
                    for x in map(level_of, levels):
                        by_level.setdefault(whole(x[0]), []).append(x)
                known = formats[id(levels)]
                for level in own.union(*(reads(template) for k in own for *_, template in known.get(k, ()))):
                    yield from ((None, None, num_id, level, starts.get(k, start), kind, template) for k, start, kind, template in known.get(level, ()))


@lru_cache(4096)
def reads(template: str | None) -> frozenset[int]:
    """The levels that a number's template shows."""
    return frozenset(k for k in range(LEVELS) if template and f"%{k + 1}" in template)


def items_and_levels(source: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Items (doc_id, idx, num_id, level, digest: the MD5 of the text), the levels of docx.numbering() that have a part in their numbers, and how many levels there are at most. Each package is read once,
    and what is kept of it, without its texts, is written once for its three readers."""
    found = package_rows(source, item_rows, ITEMS).withColumnRenamed("path", "doc_id").withColumn("text", F.md5(F.col("text").cast("binary"))).withColumnRenamed("text", "digest")
    found = cut(found)
    items, levels = found.where("idx is not null"), found.where("idx is null")
    deepest = F.greatest(F.col("level") + 1, *[F.when(F.col("lvl_text").contains(f"%{k}"), k).otherwise(0) for k in range(1, LEVELS + 1)])
    most = levels.agg(F.max(deepest)).first()[0]
    levels = levels.select(F.col("doc_id").alias("path"), "num_id", F.col("level").cast("string").alias("ilvl"), "start", "num_fmt", "lvl_text")
    return items.select("doc_id", "idx", "num_id", "level", "digest"), levels, min(LEVELS, most or 1)


def typed_lists(lines: DataFrame) -> DataFrame:
    """folds.list_runs() of paragraphs(), with the number's template and how many characters the typed marker takes."""
    return folds.list_runs(lines, marked=True)


def _cut_marker(p: ET.Element, length: int) -> None:
    for run in p.findall(RUN):
        if length <= 0:
            return
        if next(run.iter(tag("w:drawing")), None) is not None or next(run.iter(tag("w:pict")), None) is not None:
            continue
        for node, text in run_text(run):
            if length <= 0:
                return
            if node.tag == TEXT:
                node.text = text[length:]
                node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            else:
                run.remove(node)
            length -= len(text)


def _put_number(p: ET.Element, level: int, num_id: int) -> None:
    props = _properties(p, "w:pPr")
    for old in props.findall(NUMBER):
        props.remove(old)
    number = ET.Element(NUMBER)
    _child(number, "w:ilvl", val=level)
    _child(number, "w:numId", val=num_id)
    props.insert(sum(x.tag.rpartition("}")[2] in BEFORE_NUMBER for x in props), number)
    for indent in props.findall(tag("w:ind")):
        for name in INDENTS:
            indent.attrib.pop(tag(f"w:{name}"), None)
        if not indent.attrib:
            props.remove(indent)


@lru_cache(4096)
def _levels_xml(kind: str, template: str) -> str:
    """The nine levels of a format, which are the same text wherever it is used."""
    first = FIRST_LETTER_INDENT if "Letter" in kind else FIRST_INDENT
    shown = [quoted(template.replace("%1", f"%{k + 1}")) for k in range(9)]
    return '<w:multiLevelType w:val="multilevel" />' + "".join(
        f'<w:lvl w:ilvl="{k}"><w:start w:val="1" /><w:numFmt w:val="{kind}" /><w:lvlText w:val="{shown[k]}" /><w:lvlJc w:val="left" /><w:pPr><w:ind w:left="{first + NEXT_INDENT * k}" w:hanging="{HANGING}" /></w:pPr></w:lvl>' for k in range(9)
    )


def _list_xml(num_id: int, abstract_id: int, start: tuple[int, int] | None) -> str:
    """A list and where it starts: level and number."""
    own = f'<w:lvlOverride w:ilvl="{start[0]}"><w:startOverride w:val="{start[1]}" /></w:lvlOverride>' if start else ""
    return f'<w:num w:numId="{num_id}"><w:abstractNumId w:val="{abstract_id}" />{own}</w:num>'


@lru_cache(256)
def _declared(types: bytes, related: bytes | None) -> tuple[bytes, bytes]:
    """The content types and the document's relations with the numbering part in them."""
    types, related = ET.fromstring(types), ET.fromstring(related or f'<Relationships xmlns="{NS["pr"]}"/>')
    ET.SubElement(types, f"{{{TYPES_NS}}}Override", {"PartName": "/word/numbering.xml", "ContentType": NUMBERING_TYPE})
    taken = {x.get("Id") for x in related}
    free = next(f"rIdN{k}" for k in range(len(taken) + 1) if f"rIdN{k}" not in taken)
    ET.SubElement(related, f"{{{NS['pr']}}}Relationship", {"Id": free, "Type": RELATION_TYPE, "Target": "numbering.xml"})
    return serialized(types), serialized(related)


def _numbering_part(archive: zipfile.ZipFile) -> tuple[ET.Element, dict[str, bytes]]:
    """The numbering part, an empty one where the package has none, and the parts that then must declare and relate it."""
    root, links = part(archive, "word/numbering.xml"), "word/_rels/document.xml.rels"
    if root is not None:
        return root, {}
    types, related = _declared(archive.read("[Content_Types].xml"), archive.read(links) if links in archive.namelist() else None)
    return ET.fromstring(EMPTY_NUMBERING), {"[Content_Types].xml": types, links: related}


def with_lists(source: DataFrame, lists: DataFrame) -> DataFrame:
    """path, content, changed: packages whose typed_lists() are lists of the word processor. Each list gets a number of its own that starts where its first item did; formats of one kind and
    template share their levels; the typed markers and the paragraphs' own indents go. Packages without typed lists stay as they are."""

    def write(content: bytes, mine: list[dict]) -> tuple[bytes, int]:
        items = {x["idx"]: SimpleNamespace(**x) for x in sorted(mine, key=lambda x: x["idx"])}

        def converted(content: bytes) -> tuple[bytes, int]:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                root, others = _numbering_part(archive)
                found = list(numbered_trees(archive))
            first_of, trees = {name: at for at, name, _ in found}, {name: tree for _, name, tree in found}
            above = lambda name, key: max([whole(x.get(tag(key))) or 0 for x in root.iter(tag(name))], default=0)
            last_format, last_list = above("w:abstractNum", "w:abstractNumId"), above("w:num", "w:numId")
            formats: dict[tuple, int] = {}
            numbers: dict[int, int] = {}
            added = []
            for r in items.values():
                style = (r.kind, BULLET if r.kind == "bullet" else r.template)
                if style not in formats:
                    formats[style] = last_format + 1 + len(formats)
                if r.list_id not in numbers:
                    numbers[r.list_id] = last_list + 1 + len(numbers)
                    added.append(_list_xml(numbers[r.list_id], formats[style], None if r.kind == "bullet" else (r.level, int(r.number))))
            new = [f'<w:abstractNum w:abstractNumId="{n}">{_levels_xml(*style)}</w:abstractNum>' for style, n in formats.items()]
            others["word/numbering.xml"] = serialized(root, "".join(reversed(new)), "".join(added))  # definitions come before the lists that use them

            def change(name: str, top: ET.Element) -> int:
                done = 0
                for k, p in enumerate(top.iter(PARAGRAPH), first_of[name]) if name in first_of else ():
                    if r := items.get(k):
                        _put_number(p, r.level, numbers[r.list_id])
                        _cut_marker(p, r.marker)
                        done += 1
                return done

            return rewritten(content, change, trees, others)[0], len(items)

        return converted(content) if items else (content, 0)

    mine = lists.select(F.col("doc_id").alias("path"), "idx", "list_id", "level", "kind", "number", "template", "marker")
    return each_package(source, mine, write)
