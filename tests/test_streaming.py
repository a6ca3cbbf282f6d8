"""The streams, run until their input is used up."""

from pyspark.sql import functions as F

from quillspark.streaming import edits


def test_last_write_wins_over_repeated_deliveries(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("item_id"), F.col("props").alias("text"))
    events.unionByName(events.where("event_id % 2 = 0")).repartition(3).write.parquet(str(tmp_path / "log"))
    stream = edits.read(spark, str(tmp_path / "log"), events.schema.simpleString()[7:-1].replace(":", " "))
    query = edits.last_texts(edits.unique(stream, "400 days")).writeStream.format("memory").queryName("last_texts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    expected = events.groupBy("item_id").agg(F.max("event_id").alias("seq"), F.max_by("text", "event_id").alias("text"))
    assert sorted(map(tuple, spark.table("last_texts").collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_autosaves_are_debounced(spark, tmp_path):
    rows = [(1, 0, 5), (2, 10, 5), (3, 100, 5), (4, 5, 6), (9, 100_000, 9)]
    df = spark.createDataFrame(rows, "event_id long, minute long, item_id long").select("event_id", F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "item_id")
    df.write.parquet(str(tmp_path / "log"))
    stream = edits.read(spark, str(tmp_path / "log"), "event_id long, ts timestamp, item_id long")
    query = edits.autosaves(stream, "30 minutes", "0 seconds").writeStream.format("memory").queryName("autosaves").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {(r["item_id"], r["last_event"], r["n"]) for r in spark.table("autosaves").collect()}
    assert {(5, 2, 2), (5, 3, 1), (6, 4, 1)} <= got
