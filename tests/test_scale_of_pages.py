"""What pages, their texts and pictures cost as tables grow."""

import io
import random
import zipfile

import numpy as np
import pyarrow as pa
from test_regions import BOX, plain

from quillspark.operators import folds, regions
from quillspark.plans import page_queries
from quillspark.sources import docx, xlsx


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_stay_whole_across_batches():
    rng = random.Random(1)
    keys = sorted(rng.choice([1, 2, 2, 2, 3, 5, 8, 9]) for _ in range(60))
    for size in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array([None, *keys][k : k + size], pa.int64())], ["k"]) for k in range(0, 61, size)]
        found = [x.column("k").to_pylist() for x in folds.whole_documents([*batches, batches[0].slice(0, 0)], "k")]
        assert sum(found, []) == [None, *keys] and sum(len(set(x)) for x in found) == len({None, *keys})


def test_regions_are_dealt_twice_and_not_joined(spark):
    """Lines are sorted once for blocks and equations; drawings find the texts in them where they are clustered."""
    frame = spark.createDataFrame
    lines, pictures, paths = frame([(1, 1, 0, 0, (0.1, 0.1, 0.2, 0.12), "x = 2")], f"doc_id long, page int, block int, line int, box {BOX}, text string"), frame([], f"doc_id long, page int, block int, box {BOX}"), frame([], f"doc_id long, page int, n int, box {BOX}")
    plan = plan_of(regions.regions(lines, pictures, paths))
    assert "Join" not in plan and "Window" not in plan and plan.count("Sort [doc_id") == 1
    assert sorted((r["kind"], r["n"], r["text"]) for r in regions.regions(lines, pictures, paths).collect()) == [("equation_line", 0, "x = 2"), ("text", 0, "x = 2")]


def test_crowded_pages_against_loops(spark):
    """Pages of very different numbers of paths, many of which draw clusters together; more than a batch of rows in a document."""
    rng = random.Random(5)
    paths, lines = [], []
    for page, n in enumerate((1, 3, 400, 40, 9)):
        for k in range(n):
            x, y, w, h = rng.random(), rng.random(), rng.random() * 0.06, rng.random() * 0.06
            paths.append((page, k, (x, y, x + w, y + h)))
        for k in range(12):
            x, y = rng.random() * 0.9, rng.random() * 0.9
            lines.append((page, k, 0, (x, y, x + 0.1, y + 0.02), rng.choice(["plain words here", "x = 2", "a", "+"])))
    frame = spark.createDataFrame
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = regions.regions(frame([(1, *r) for r in lines], f"doc_id long, page int, block int, line int, box {BOX}, text string"), frame([], f"doc_id long, page int, block int, box {BOX}"), frame([(1, *r) for r in paths], f"doc_id long, page int, n int, box {BOX}")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rounded = lambda rows: sorted((k, n, p, tuple(round(float(v), 9) for v in b), t or "", x, y) for k, n, p, b, t, x, y in rows)
    assert rounded((r["kind"], r["n"], r["page"], r["box"], r["text"], r["text_blocks"], r["text_chars"]) for r in found) == rounded(plain(lines, [], paths))


def test_texts_are_counted_in_parts(monkeypatch):
    """Pairs of drawings and texts are looked at some at a time, with the same counts."""
    rng = np.random.default_rng(3)
    page, of = np.sort(rng.integers(0, 6, 40)), np.sort(rng.integers(0, 6, 50))
    box, x, y, chars = np.sort(rng.random((4, 40)).reshape(2, 2, 40), axis=0).reshape(4, 40), rng.random(50), rng.random(50), rng.integers(0, 30, 50)
    whole = regions.texts_within(page, box, of, x, y, chars)
    monkeypatch.setattr(regions, "PAIRS", 7)
    parts = regions.texts_within(page, box, of, x, y, chars)
    assert [a.tolist() for a in whole] == [a.tolist() for a in parts] and whole[0].sum() > 0


def test_workbooks_with_pictures_are_written_once(spark, sf):
    """The same pictures as of a workbook that is written and rewritten; pictures and small parts are stored, large ones deflated. Documents are dealt to all cores."""
    rows, placed = [(k, "line " * 30) for k in range(40)], [(1, 0, "a.png", b"A" * 5000), (None, None, "b.png", b"B"), (0, 2, "a.png", b"A" * 5000)]
    book = xlsx.pictured(xlsx.workbook_parts(rows), placed)
    assert list(xlsx.picture_rows(book)) == list(xlsx.picture_rows(xlsx.with_pictures(xlsx.workbook(rows), placed)))
    assert list(xlsx.cell_rows(book)) == list(xlsx.cell_rows(xlsx.workbook(rows)))
    with zipfile.ZipFile(io.BytesIO(book)) as archive:
        kinds = {x.filename: x.compress_type for x in archive.infolist()}
    assert kinds["xl/media/a.png"] == kinds["_rels/.rels"] == zipfile.ZIP_STORED and kinds["xl/worksheets/sheet1.xml"] == zipfile.ZIP_DEFLATED
    assert "hashpartitioning(path" in plan_of(page_queries.picture_books(spark, sf))


def test_pictures_leave_in_batches_bounded_by_bytes():
    schema = pa.schema([*((f"c{k}", pa.int32()) for k in range(7)), ("content", pa.binary())])
    assert [b.num_rows for b in docx.in_batches([(*range(7), b"x")] * 100, schema, content=7)] == [100]
    assert max(b.num_rows for b in docx.in_batches([(*range(7), b"x" * (1 << 20))] * 20, schema, content=7)) == docx.OUT_BYTES >> 20


def test_streams_are_read_once(spark, sf):
    """What reads the log several times reads rows that are there, not the streams again."""
    assert "MapInArrow" not in plan_of(page_queries.page_content(spark, sf))
