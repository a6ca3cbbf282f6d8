"""WARC archives: written by Spark's text sink, read back by reassembling segments.

Writing. A payload of at least `revisit_bytes` that several pages share is stored once, with the page of the largest id; the
others are `revisit` records that name it. A response's block is an HTTP message with chunked transfer framing. A block of
more than `segment_bytes` is cut: the first segment keeps the record's own header, the following ones are `continuation` records that
name the origin's id and their number, and the last gives the total length. Records go out through the text sink, whose line separator
is the blank lines that end a record, so files are written, committed and retried like any of Spark's, `records_per_file` to a file.

Reading. Files of any name, plain or gzipped, are scanned record by record by their content length. Segments are grouped by the origin's id, ordered
by their number and joined; numbers must run from 1 without gaps and the length must be the total that the last one tells, else
`complete` is false. Then the message's header is cut off and the chunks are joined. Segments that follow each other in a file are joined while it is
scanned, up to HOLD_BYTES of them at a time, and only what is still in parts then is shuffled. A revisit takes its payload's length and digest from the
response that it names. A file is one row of a task, so it may have 2 GB at most (gzipped files are unpacked record by record).

Defined results: a null html is an empty payload. Rows that repeat a page id with an equal payload are one record, and one row. A page
id with several payloads has a record for each. A null page id is written as none and read as null; as the largest id it
comes last. An empty table makes an empty archive. Only the named columns are read. In archives from elsewhere a record without a page id has none,
and records of other types than response and revisit have no payload; a record id that occurs again is read once, as the copy that is complete.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import SLICE_BYTES, broadcast_if_small, cut, text_slices

REVISIT_BYTES, SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 1000, 4096, 1500, 2000
END = "\r\n\r\n"
FIELDS = {"warc-type": "type", "warc-record-id": "record", "warc-segment-origin-id": "origin", "warc-segment-number": "number", "warc-segment-total-length": "total", "warc-refers-to": "refers", "warc-payload-digest": "declared", "x-page-id": "page", "warc-target-uri": "uri"}
#: A row of a scan: a record that is whole has its payload, length and digest, a segment has its block.
SCANNED = "type string, record string, origin string, number int, total long, refers string, declared string, page string, uri string, whole boolean, complete boolean, payload binary, n long, digest string, block binary"
#: Bytes of open segments that a task holds while it scans a file, and of rows that it hands on at a time.
HOLD_BYTES, BATCH_BYTES = 16 << 20, 4 << 20


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"


def framed(payload: bytes, chunk_bytes: int) -> bytes:
    """An HTTP message with the payload in chunks."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    parts = [payload[i : i + chunk_bytes] for i in range(0, len(payload), chunk_bytes)]
    return head + b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def unframed(message: bytes) -> bytes:
    """The payload of an HTTP message, its chunks joined if it is framed so."""
    head, _, body = message.partition(b"\r\n\r\n")
    if not re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head):
        return body
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        if len(out[-1]) < size:
            raise ValueError("a chunk is cut off")
        at = line + 2 + size + 2


def written(page: str, url: str, payload: bytes, digest: str, of: str | None, is_revisit: bool, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of a page, without the blank lines at their ends."""
    own = record_id(page, digest)
    fields = {"WARC-Record-ID": own, "WARC-Date": "2026-01-01T00:00:00Z", "WARC-Target-URI": re.sub(r"\s", "%20", url), "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page}
    if is_revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(of or "", digest)}
    block = b"" if is_revisit else framed(payload, chunk_bytes)
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)] or [b""]
    for number, part in enumerate(cuts, 1):
        if number == 1:
            lines = {"WARC-Type": "revisit" if is_revisit else "response"} | fields | ({"WARC-Segment-Number": "1"} if len(cuts) > 1 else {})
        else:
            lines = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(f"{page} {number}", digest), "WARC-Date": fields["WARC-Date"], "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": str(number)}
            if number == len(cuts):
                lines["WARC-Segment-Total-Length"] = str(len(block))
        lines["Content-Length"] = str(len(part))
        yield "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in lines.items())]).encode() + b"\r\n\r\n" + part


def write_archive(pages: DataFrame, path: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_col).cast("long").alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    latest = rows.where(F.col("n") >= revisit_bytes).groupBy("digest", "n").agg(F.max("page").alias("of"), F.count("*").alias("uses")).where("uses > 1").drop("uses")
    rows = rows.join(broadcast_if_small(cut(latest), 80), ["digest", "n"], "left").withColumn("is_revisit", F.col("of").isNotNull() & ~F.col("page").eqNullSafe(F.col("of")))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, column=2):  # the payload
            out, held = [], 0
            for i in range(piece.num_rows):
                r = {name: piece.column(k)[i].as_py() for k, name in enumerate(piece.schema.names)}
                page = "" if r["page"] is None else str(r["page"])
                of = None if r["of"] is None else str(r["of"])
                for record in written(page, r["url"], r["payload"], r["digest"], of, r["is_revisit"], segment_bytes, chunk_bytes):
                    out.append(record)
                    held += len(record)
                    if held >= SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = rows.select("page", "url", "payload", "digest", "of", "is_revisit").mapInArrow(records, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).mode("overwrite").text(path)


class Unzipped(io.RawIOBase):
    """The bytes of a gzipped file, one member after the other; of a file that is cut off, what there is."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.member = memoryview(raw), 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while self.at < len(self.raw) or self.member.unconsumed_tail:
            given = self.member.unconsumed_tail
            if not given:
                given = self.raw[self.at : self.at + (1 << 16)]
                self.at += len(given)
            out = self.member.decompress(given, len(into))
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
            if out:
                into[: len(out)] = out
                return len(out)
        return 0


def opened(raw: bytes) -> BinaryIO:
    return io.BufferedReader(Unzipped(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)


def parsed(content: BinaryIO) -> Iterator[dict]:
    """The records of a file, one after the other. A file that ends within a record gives what there is of it."""
    while line := content.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := content.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = content.read(int(head.get("content-length", 0)))
        found = {name: head.get(k) for k, name in FIELDS.items()}
        segmented = found["number"] is not None or found["origin"] is not None
        yield found | {"segmented": segmented, "number": int(found["number"] or 1), "total": int(found["total"]) if found["total"] else None, "block": block, "short": len(block) < int(head.get("content-length", 0))}


def hex_digest(declared: str | None) -> str | None:
    """A SHA-1 as a header tells it, in base 16 or 32, as lower-case hex; null for other kinds."""
    kind, _, value = (declared or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()
    except ValueError:
        return value.lower()


def assembled(segments: list[dict]) -> dict:
    """The record that segments, in any order, make up: its payload if it is a response, and whether it is complete."""
    segments = sorted(segments, key=lambda x: x["number"])
    first, block, total = segments[0], b"".join(x["block"] for x in segments), segments[-1]["total"]
    complete = first["type"] not in (None, "continuation") and [x["number"] for x in segments] == list(range(1, len(segments) + 1))
    complete = complete and (len(segments) == 1 if total is None else total == len(block)) and not any(x.get("short") for x in segments)
    payload = None
    if complete and first["type"] == "response":
        try:
            payload = unframed(block)
        except ValueError:
            complete = False
    digest = None if payload is None else hashlib.sha1(payload).hexdigest()
    declared = hex_digest(first["declared"])
    complete = complete and (digest is None or declared is None or declared == digest)
    return first | {"record": first["origin"] or first["record"], "origin": None, "declared": declared, "whole": True, "complete": complete, "payload": payload, "n": None if payload is None else len(payload), "digest": digest, "block": None}


def joined_in_order(records: Iterator[dict]) -> Iterator[dict]:
    """Records of a file; segments whose origin and followers are all at hand are joined, and the others come as they are."""
    held: dict[str, list[dict]] = {}
    size = 0
    part = lambda x: x | {"whole": False, "complete": not x["short"]}
    for r in records:
        if not r["segmented"]:
            yield assembled([r])
            continue
        key = r["origin"] or r["record"] or ""
        mine = held.setdefault(key, [])
        mine.append(r)
        size += len(r["block"])
        if r["total"] is not None and len(mine) == r["number"]:
            whole = assembled(mine)
            if whole["complete"]:
                yield whole
                size -= sum(len(x["block"]) for x in held.pop(key))
        if size > HOLD_BYTES:
            yield from map(part, [x for xs in held.values() for x in xs])
            held, size = {}, 0
    yield from map(part, [x for xs in held.values() for x in xs])


def batches_of(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    size = 0
    for r in records:
        out.append(r)
        size += 300 + len(r["block"] or b"") + len(r["payload"] if r.get("payload") and "payload" in schema.names else b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in schema.names} for x in out], schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in schema.names} for x in out], schema)


def scanned(spark: SparkSession, path: str, payloads: bool = True, glob: str = "*", join: bool = True) -> DataFrame:
    """SCANNED, one row for each record, or for each segment of those that aren't whole in one place; without `payloads` that column is missing."""
    columns = [x.split(" ") for x in SCANNED.split(", ") if payloads or not x.startswith("payload")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in columns])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                records = parsed(opened(content.as_py()))
                yield from batches_of(joined_in_order(records) if join else (x | {"whole": False, "complete": not x["short"]} for x in records), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(scan, ", ".join(" ".join(x) for x in columns))


def read_records(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every record of the archive with its block, segments as they are."""
    return scanned(spark, path, False, glob, join=False).drop("whole", "n", "digest")


def read_archive(spark: SparkSession, path: str, payloads: bool = True, glob: str = "*") -> DataFrame:
    """record, page_id, uri, record_type, refers (a record), digest, payload (null for revisits; only with `payloads`), payload_bytes, refers_to (a page id), complete.

    What the scan finds is written to the checkpoint folder once, since records, segments and revisits' targets are all taken from it."""
    rows = cut(scanned(spark, path, payloads, glob))
    columns = [c for c in rows.columns if c not in ("block", "whole")]
    segment = F.struct("type", "record", "origin", "number", "total", "refers", "declared", "page", "uri", "complete", "block")
    parts = rows.where("not whole").groupBy(F.coalesce("origin", "record").alias("key")).agg(F.collect_set(segment).alias("segments"))
    schema = rows.select(columns).schema
    arrow = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema.fields])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = ([x | {"short": not x["complete"]} for x in segments.as_py()] for segments in batch.column(0))
            yield from batches_of(map(assembled, groups), arrow)

    late = parts.select("segments").mapInArrow(reassemble, schema)
    rest = [c for c in columns if c not in ("record", "complete")]
    best = F.max_by(F.struct(*rest), F.col("complete")).alias("best")
    records = rows.where("whole").select(columns).unionByName(late).groupBy("record").agg(best, F.max("complete").alias("complete")).select("record", "complete", "best.*")
    records = records.withColumn("page", F.when(F.col("page") != "", F.col("page").cast("long")))
    content = ["payload"] if payloads else []
    shown = ["record", F.col("page").alias("page_id"), "uri", F.col("type").alias("record_type"), "refers"]
    own = records.where("type is null or type <> 'revisit'").select(*shown, "digest", *content, F.col("n").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"), "complete")
    targets = records.where("type = 'response'").select(F.col("record").alias("refers"), F.col("n").alias("target_n"), F.col("digest").alias("target_digest"), F.col("page").alias("target_page"))
    revisits = records.where("type = 'revisit'").join(targets, "refers", "left")
    told = F.col("complete") & F.col("target_digest").isNotNull() & F.coalesce(F.col("declared") == F.col("target_digest"), F.lit(True))
    return own.unionByName(revisits.select(*shown, F.col("target_digest").alias("digest"), *content, F.col("target_n").alias("payload_bytes"), F.col("target_page").alias("refers_to"), told.alias("complete")))
