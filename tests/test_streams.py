"""Streams against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from skein.plans import catalog
from tests.conftest import DATA


def batch(events):
    days = events.groupBy(F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("start_ms"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return {(r.start_ms, r.event_type): r.n for r in days.collect()}


def windows(spark, folder):
    rows = catalog.QUERIES["stream_event_windows"](spark, folder).collect()
    got = {(r.start_ms, r.event_type): r.n for r in rows}
    assert len(got) == len(rows)
    return got


def test_event_windows_equal_batch(spark):
    assert windows(spark, DATA) == batch(spark.read.parquet(f"{DATA}/events.parquet"))


def test_event_windows_of_files_out_of_order(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(hours=7 * i), "view" if i % 3 else "click") for i in range(40)]
    for k in (5, 0, 7, 2, 6, 1, 4, 3, 9, 8):  # ten files are three micro-batches, not ordered in time
        spark.createDataFrame(rows[4 * k : 4 * k + 4], "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    want = batch(spark.read.parquet(str(tmp_path / "events.parquet")))
    assert sum(want.values()) == 40 and windows(spark, str(tmp_path)) == want
