"""Polled sources: offsets, the overlap, a run that dies, and moments that go back."""

import pytest
from pyspark.sql import functions as F

from tidewatch.sources.polled import BEGINNING, PolledReader, polled
from tidewatch.streaming import streams as ST

SCHEMA = "id long, value string, ts timestamp"
MINUTE = 60_000_000


def put(spark, path, rows):
    """Rows (id, value, minute) as a file."""
    frame = spark.createDataFrame(rows, "id long, value string, minute long")
    frame.select("id", "value", F.timestamp_micros(F.col("minute") * MINUTE).alias("ts"), F.lit("x").alias("more")).coalesce(1).write.mode("append").parquet(path)


def poll(spark, base, minute, overlap=7):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = polled(spark, f"{base}/feed", schema, "ts", overlap * 60, minute * MINUTE)
    ST.sync_each_batch(stream, ["id"], "ts", f"{base}/table", f"{base}/log", merge_every=2).awaitTermination()
    return {(r.id, r.value) for r in ST.synced(spark, f"{base}/table", ["id"]).collect()}


def test_late_rows_come_once_and_the_newest_stays(spark, tmp_path):
    base = str(tmp_path)
    put(spark, f"{base}/feed", [(1, "a", 1), (2, "b", 9), (3, "not yet", 11), (9, "no time", None)])
    assert poll(spark, base, 10) == {(1, "a"), (2, "b")}
    put(spark, f"{base}/feed", [(4, "late", 5), (5, "too late", 2), (1, "a again", 12)])
    assert poll(spark, base, 15) == {(1, "a again"), (2, "b"), (3, "not yet"), (4, "late")}
    assert poll(spark, base, 30) == {(1, "a again"), (2, "b"), (3, "not yet"), (4, "late")}
    out = ST.synced(spark, f"{base}/table", ["id"])
    assert out.count() == 4 and out.columns == ["id", "value", "ts"]


def test_a_run_that_dies_is_read_again(spark, tmp_path):
    base = str(tmp_path)
    put(spark, f"{base}/feed", [(i, "a", i) for i in range(20)])
    poll(spark, base, 9)
    schema = spark.createDataFrame([], SCHEMA).schema

    def dies(batch, number):
        batch.filter("id < 12").write.mode("overwrite").parquet(f"{base}/table/new/batch={number}")
        raise RuntimeError("lost")

    stream = polled(spark, f"{base}/feed", schema, "ts", 420, 15 * MINUTE)
    with pytest.raises(Exception, match="lost"):
        stream.writeStream.foreachBatch(dies).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    assert poll(spark, base, 19) >= {(i, "a") for i in range(16)}  # the begun poll, with its bounds of before
    assert poll(spark, base, 19) == {(i, "a") for i in range(20)}
    assert ST.synced(spark, f"{base}/table", ["id"]).count() == 20


def test_bounds_of_a_poll(tmp_path):
    reader = PolledReader({"path": str(tmp_path), "time": "ts", "overlap": "60", "as_of": "5"}, "{}")
    assert reader.initialOffset() == {"until": BEGINNING} and reader.latestOffset() == {"until": 5}
    assert [p.files for p in reader.partitions({"until": 0}, {"until": 9})] == [()]  # an empty folder
    for i in range(9):
        (tmp_path / f"part-{i}.parquet").touch()
    (tmp_path / "_begun.parquet").touch()
    parts = reader.partitions({"until": 100 * MINUTE}, {"until": 105 * MINUTE})
    assert [len(p.files) for p in parts] == [8, 1] and {(p.after, p.until) for p in parts} == {(99 * MINUTE, 105 * MINUTE)}
    assert [p.files for p in reader.partitions({"until": 9}, {"until": 5})] == [()]  # back in time
    first = reader.partitions({"until": BEGINNING}, {"until": 5})
    assert {p.after for p in first} == {BEGINNING}
