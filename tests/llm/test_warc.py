import hashlib
import tempfile

import pytest
from llm_data import prose

from quillspark.llm import queries, warc


@pytest.fixture(scope="module")
def pages(spark):
    same = prose(1, 300)
    rows = [(1, same), (2, same), (3, same), (4, None), (5, ""), (6, "short"), (7, "short"), (8, "é日🎉" * 20_000), (9, "WARC/1.1\r\n\r\n0\r\n\r\nContent-Length: 3\r\n\r\n" * 60), (None, same), (10, prose(2, 300)), (10, prose(2, 300)), (11, "x" * 999), (12, "x" * 999), (13, "y" * 1000), (14, "y" * 1000)]
    return spark.createDataFrame([(i, f"http://a b/{i}", h, "x", "y", 1) for i, h in rows], "page_id long, url string, html string, type string, payload string, n int"), rows


def brute(rows):
    rows = {(i, h or "") for i, h in rows}
    latest = {}
    for i, h in rows:
        if len(h.encode()) >= 1000 and i is not None:
            latest[h] = max(i, latest.get(h, i))
    return sorted(((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), *(("revisit", latest[h]) if h in latest and latest[h] != i else ("response", None))) for i, h in rows), key=repr)


def collected(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"segment_bytes": 100, "chunk_bytes": 7, "records_per_file": 5}, {"segment_bytes": 1 << 30}])
def test_round_trip(spark, pages, how):
    df, rows = pages
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/a"
    warc.write_archive(df, path, **how)
    read = warc.read_archive(spark, path)
    assert collected(read) == brute(rows)
    assert all(r["complete"] for r in read.collect())
    texts = {(r["page_id"], r["payload"].decode()) for r in read.where("record_type = 'response'").collect()}
    assert texts <= {(i, h or "") for i, h in rows}
    if how.get("segment_bytes") == 100:
        assert warc.read_records(spark, path).where("type = 'continuation'").count() > 100


def test_broken_archives_are_told(spark):
    def records(*blocks):
        path = tempfile.mkdtemp(prefix="spark-warc-")
        with open(f"{path}/part-0.txt", "wb") as f:
            for head, block in blocks:
                f.write(b"WARC/1.1\r\n" + head.encode() + f"\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
        return {r["record"]: r["complete"] for r in warc.read_archive(spark, path).collect()}

    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    digest = "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"abc").hexdigest()
    first = f"WARC-Type: response\r\nWARC-Record-ID: <a>\r\n{digest}\r\nWARC-Segment-Number: 1"
    follow = "WARC-Type: continuation\r\nWARC-Record-ID: <{}>\r\nWARC-Segment-Origin-ID: <a>\r\nWARC-Segment-Number: {}"
    last = follow + "\r\nWARC-Segment-Total-Length: {}"
    n = len(message)
    assert records((last.format("c", 3, n), message[40:]), (first, message[:20]), (follow.format("b", 2), message[20:40])) == {"<a>": True}
    assert records((first, message[:20]), (last.format("c", 3, n), message[40:])) == {"<a>": False}  # a gap
    assert records((first, message[:20]), (last.format("b", 2, n + 1), message[20:])) == {"<a>": False}  # a wrong total
    assert records((follow.format("b", 2), message[20:])) == {"<a>": False}  # no origin
    assert records((first.replace("<a>", "<z>"), message[:-9])) == {"<z>": False}  # a cut-off segment


def test_archives_from_elsewhere(spark):
    """Gzipped a record at a time, of any name, with digests in base 32 and records of other types."""
    import base64
    import gzip

    body = b"<html>" + b"z" * 3000
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    told = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    record = lambda head, block: b"WARC/1.0\r\n" + head.encode() + f"\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    records = [record("WARC-Type: warcinfo\r\nWARC-Record-ID: <i>", b"software: x\r\n"), record(f"WARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Target-URI: http://a/\r\nWARC-Payload-Digest: {told}", message), record(f"WARC-Type: revisit\r\nWARC-Record-ID: <v>\r\nWARC-Refers-To: <r>\r\nWARC-Payload-Digest: {told}", b"")]
    path = tempfile.mkdtemp(prefix="spark-warc-")
    with open(f"{path}/crawl-0001.warc.gz", "wb") as f:
        f.write(b"".join(map(gzip.compress, records)))
    with open(f"{path}/cut.warc.gz", "wb") as f:
        f.write(gzip.compress(record("WARC-Type: response\r\nWARC-Record-ID: <c>", message))[:-40])
    got = {r["record"]: r for r in warc.read_archive(spark, path).collect()}
    assert {k: r["complete"] for k, r in got.items()} == {"<i>": True, "<r>": True, "<v>": True, "<c>": False}
    assert bytes(got["<r>"]["payload"]) == body and got["<r>"]["uri"] == "http://a/" and got["<v>"]["payload_bytes"] == len(body)
    assert got["<v>"]["digest"] == got["<r>"]["digest"] == hashlib.sha1(body).hexdigest()


def test_a_hot_payload_and_segments_in_many_places(spark, monkeypatch):
    """Most pages revisit one; segments of a record lie in several files, or are more than a task holds."""
    monkeypatch.setattr(warc, "HOLD_BYTES", 3000)
    rows = [(k, prose(1 if k % 3 else 100 + k, 300)) for k in range(90)]
    df = spark.createDataFrame([(i, "http://a/", h) for i, h in rows], "page_id long, url string, html string")
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/a"
    warc.write_archive(df, path, segment_bytes=300, records_per_file=4)
    for payloads in (True, False):
        read = warc.read_archive(spark, path, payloads=payloads)
        assert collected(read) == brute(rows) and ("payload" in read.columns) == payloads


def test_beyond_the_broadcast_bound(spark, pages, monkeypatch):
    monkeypatch.setattr("quillspark.llm.common.BROADCAST_BYTES", 0)
    df, rows = pages
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/a"
    warc.write_archive(df, path)
    assert collected(warc.read_archive(spark, path)) == brute(rows)


def test_empty_table(spark, pages):
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/a"
    warc.write_archive(pages[0].limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_query(spark, sf):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = queries.op9_warc(spark, sf).withColumnRenamed("payload_digest", "digest")
    assert collected(got) == brute(rows)


def test_many_long_pages_in_one_task(spark, tmp_path):
    """Some 40 MB in one Arrow batch; the writer takes them a few at a time."""
    rows = [(i, f"{i} " * 60_000) for i in range(100)]
    df = spark.createDataFrame([(i, "http://a", h) for i, h in rows], "page_id long, url string, html string").repartition(1)
    warc.write_archive(df, f"{tmp_path}/a", segment_bytes=1 << 18)
    assert collected(warc.read_archive(spark, f"{tmp_path}/a", payloads=False)) == brute(rows)
