"""Content streams of pages: what is painted where, and inside which marked content.

streams: key columns, part (a page's streams in order), content (binary). A page's streams are dealt to one task, sorted, and read one after the other; the state of a page (matrices, open marked
content) goes on from stream to stream, operands don't. Nothing but the state and one stream is held, so a page may have any number of them.

paint_log() gives a row for each thing painted inside marked content: the key, seq (its place on the page), kind, the open content's numbers (mcids, sorted), name (of what `Do` draws) and a box in the page's own
space, y upwards. text: the place where it is shown, a box without size, as glyphs need fonts; image: the unit square under the matrix; paint: the box around the path's points. Boxes of paths and
images without width or height are left out. Only TD sets the leading that T* moves by, and showing text moves nothing. A shading has no box of its own.

Defined results: a null or empty stream paints nothing; what isn't an operator is an operand; an operator with too few numbers does nothing; Q without q goes back to the first matrix; EMC without BDC
does nothing; a string or comment that doesn't end takes the rest of its stream. Rows of a null key are a page of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.spatial import nearest_within
from quillspark.session import cut

# The operators of the format.
SHOWS = ("Tj", "TJ", "'", '"')
PAINTS = ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "sh")
OTHERS = (
    "Do", "BDC", "BMC", "EMC", "BT", "ET", "q", "Q", "cm", "m", "l", "c", "v", "y", "h", "re", "W", "W*", "n", "CS", "cs", "SC", "SCN", "sc", "scn", "G", "g", "RG", "rg", "K", "k", "w", "J", "j", "M",
    "d", "ri", "gs", "Tf", "Tm", "Td", "TD", "T*", "Tc", "Tw", "Tz", "TL", "Tr", "Ts",
)
OPERATORS = frozenset(SHOWS + PAINTS + OTHERS)

#: Comments; where a string begins; hexadecimal strings; brackets; names; and all else up to a blank or a bracket.
LEXEME = re.compile(rb"%[^\r\n]*|(\()|<<|>>|<[^>]*>?|[\[\]{}]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|[^\x00\t\n\f\r ()<>\[\]{}/%]+")
WITHIN = re.compile(rb"\\.?|[()]", re.DOTALL)
STRING, HEX = "(...)", "<...>"

Matrix = tuple[float, float, float, float, float, float]
SAME: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def lexemes(content: bytes) -> Iterator[str]:
    """The stream's tokens. What strings hold isn't told."""
    at = 0
    while found := LEXEME.search(content, at):
        at = found.end()
        if found[1]:
            depth = 1
            while depth and (inner := WITHIN.search(content, at)):
                at = inner.end()
                depth += {b"(": 1, b")": -1}.get(inner[0], 0)
            if depth:
                at = len(content)
            yield STRING
        elif found[0][:1] != b"%":
            yield HEX if found[0][:1] == b"<" and found[0] != b"<<" else found[0].decode("latin-1")


def after(m: Matrix, n: Matrix) -> Matrix:
    """The matrix that applies n first, then m."""
    a, b, c, d, e, f = m
    return (a * n[0] + c * n[1], b * n[0] + d * n[1], a * n[2] + c * n[3], b * n[2] + d * n[3], a * n[4] + c * n[5] + e, b * n[4] + d * n[5] + f)


def numbers(operands: list[str], most: int) -> list[float]:
    """The last `most` numbers among the operands, or none if there are fewer."""
    found = []
    for x in reversed(operands):
        try:
            found.append(float(x))
        except ValueError:
            continue
        if len(found) == most:
            return found[::-1]
    return []


class PageState:
    """Where a page stands: its matrices, its open content, its path."""

    def __init__(self):
        self.matrix, self.saved = SAME, []
        self.line, self.leading, self.in_text = SAME, 0.0, False
        self.content: list[int | None] = []
        self.path: list[tuple[float, float]] = []
        self.seq = 0

    def moved(self, x: float, y: float) -> None:
        self.line = after(self.line, (1.0, 0.0, 0.0, 1.0, x, y))

    def point(self, x: float, y: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.matrix
        return a * x + c * y + e, b * x + d * y + f

    def opened(self, operands: list[str]) -> None:
        for name, value in zip(operands, operands[1:]):
            if name == "/MCID":
                try:
                    self.content.append(int(float(value)))
                    return
                except (ValueError, OverflowError):
                    continue
        self.content.append(None)

    def built(self, operator: str, operands: list[str]) -> None:
        many = {"m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "re": 4}[operator]
        if found := numbers(operands, many):
            if operator == "re":
                x, y, w, h = found
                found = [x, y, x + w, y, x, y + h, x + w, y + h]
            self.path += [self.point(x, y) for x, y in zip(found[::2], found[1::2])]

    def painted(self, kind: str, points: list[tuple[float, float]], name: str | None = None) -> tuple | None:
        """A row of the log, if it is inside content."""
        self.seq += 1
        inside = sorted({x for x in self.content if x is not None})
        if not inside or not points:
            return None
        xs, ys = zip(*points)
        box = min(xs), min(ys), max(xs), max(ys)
        if kind != "text" and not (box[2] > box[0] and box[3] > box[1]):
            return None
        return self.seq, kind, inside, name, *box

    def run(self, operator: str, operands: list[str]) -> tuple | None:
        if operator == "BDC":
            self.opened(operands)
        elif operator == "BMC":
            self.content.append(None)
        elif operator == "EMC":
            del self.content[-1:]
        elif operator == "q":
            self.saved.append(self.matrix)
        elif operator == "Q":
            self.matrix = self.saved.pop() if self.saved else SAME
        elif operator == "cm":
            if found := numbers(operands, 6):
                self.matrix = after(self.matrix, tuple(found))
        elif operator in ("BT", "ET"):
            self.in_text, self.line = operator == "BT", SAME
        elif operator == "Tm":
            if found := numbers(operands, 6):
                self.line = tuple(found)
        elif operator in ("Td", "TD"):
            if self.in_text and (found := numbers(operands, 2)):
                if operator == "TD":
                    self.leading = -found[1]
                self.moved(*found)
        elif operator == "T*":
            if self.in_text:
                self.moved(0.0, -self.leading)
        elif operator in SHOWS:
            if self.in_text:
                return self.painted("text", [self.point(self.line[4], self.line[5])])
        elif operator == "Do":
            if operands:
                return self.painted("image", [self.point(x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)], operands[-1].lstrip("/"))
        elif operator in PAINTS:
            points, self.path = ([], self.path) if operator == "sh" else (self.path, [])
            return self.painted("paint", points)
        elif operator == "n":
            self.path = []
        elif operator in ("m", "l", "c", "v", "y", "re"):
            self.built(operator, operands)
        return None

    def read(self, content: bytes) -> Iterator[tuple]:
        operands: list[str] = []
        for token in lexemes(content):
            if token not in OPERATORS:
                operands.append(token)
                continue
            if row := self.run(token, operands):
                yield row
            operands = []


#: Rows of the log that a task gives at a time.
OUT_ROWS = 10_000


def paint_log(streams: DataFrame, keys: list[str]) -> DataFrame:
    kinds = [streams.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)), "seq long, kind string, mcids array<int>, name string, x0 double, y0 double, x1 double, y1 double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, types = None, PageState(), [], None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys] + [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string(), *[pa.float64()] * 4]
            for *now, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    key, state = now, PageState()
                for row in state.read(content or b""):
                    out.append((*key, *row))
                    if len(out) == OUT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    rows = streams.select(*keys, "part", "content").repartition(*keys).sortWithinPartitions(*keys, "part")
    return rows.select(*keys, "content").mapInArrow(run, schema)


def components(log: DataFrame, keys: list[str], traces: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """keys, mcid, kind, x0, y0, x1, y1: each content's boxes, once (to three decimals), in the log's space. names (keys, name): what `Do` may draw; without it, all. traces: keys, trace, the places x, y of its
    glyphs, and its box; a text is its nearest trace within 2.5 points, or nothing."""
    page = F.to_json(F.struct(*keys))
    log = cut(log.select(*keys, "seq", "kind", F.explode("mcids").alias("mcid"), "name", "x0", "y0", "x1", "y1"))  # else the streams are read again for each of its readers
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    drawn = log.where("kind <> 'text'")
    if names is not None:
        drawn = drawn.alias("l").join(names.alias("n"), [*same("l", "n"), (F.col("l.kind") == "paint") | (F.col("l.name") == F.col("n.name"))], "left_semi")
    rows = drawn.select(*keys, "seq", "kind", "mcid", "x0", "y0", "x1", "y1")
    if traces is not None:
        point = F.to_json(F.struct(page.alias("page"), "seq", "mcid"))
        points = log.where("kind = 'text'").select(*keys, "mcid", "seq", page.alias("__page"), point.alias("point_id"), F.col("x0").alias("__x"), F.col("y0").alias("__y"))
        asked = points.select("point_id", F.col("__page").alias("page"), F.col("__x").alias("x"), F.col("__y").alias("y"))
        near = nearest_within(asked, traces.select(page.alias("page"), F.col("trace").alias("trace_id"), "x", "y")).join(points, "point_id")
        boxes = traces.select(*keys, F.col("trace").alias("trace_id"), "x0", "y0", "x1", "y1").distinct()
        met = near.alias("n").join(boxes.alias("b"), [*same("n", "b"), F.col("n.trace_id") == F.col("b.trace_id")]).where("x1 > x0 and y1 > y0")
        rows = rows.unionByName(met.select(*[F.col(f"n.{k}") for k in keys], F.col("n.seq"), F.lit("text").alias("kind"), F.col("n.mcid"), "b.x0", "b.y0", "b.x1", "b.y1"))
    corners = ["x0", "y0", "x1", "y1"]
    first = Window.partitionBy(*keys, "mcid", "kind", *[F.round(c, 3) for c in corners]).orderBy("seq")
    return rows.withColumn("again", F.row_number().over(first)).where("again = 1").select(*keys, "mcid", "kind", *corners)
