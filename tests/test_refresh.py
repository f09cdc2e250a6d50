"""Stream bars against batch bars, and the merge of a batch into stored bars."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from barwright.config import ExperimentConfig
from barwright.sources.bars import read_bars, upsert_bars, with_storage_columns
from barwright.sources.ticks import bars_from_ticks
from barwright.streaming.bars import stream_bars


def test_stream_and_batch_bars_agree_on_missing_prices_and_equal_times(spark):
    at = datetime(2024, 5, 14, 15, 0, 10)
    rows = [("A", at, float("nan"), 1.0, 0), ("A", at, 10.0, 1.0, 2), ("A", at, 12.0, 1.0, 1), ("A", at, float("inf"), 1.0, 5), ("A", at, None, 1.0, 9)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double, n int")
    got = stream_bars(ticks, ExperimentConfig(), tie="n").collect()
    want = bars_from_ticks(ticks, symbol="symbol", ts="ts", price="price", size="size", tie="n").collect()
    assert got == want and (got[0].open, got[0].high, got[0].close) == (12.0, 12.0, 10.0)


def test_merge_rewrites_only_the_dates_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "bars")

    def bars(day: int, close: float):
        rows = [("A", datetime(2024, 5, day, 15, m), close, close, close, close, 1.0) for m in range(3)]
        d = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
        return with_storage_columns(d, "1min", "America/New_York")

    for day in (13, 14):
        upsert_bars(spark, bars(day, 1.0), path)
    before = {f for f in read_bars(spark, path).inputFiles() if "session_date=2024-05-13" in f}
    upsert_bars(spark, bars(14, 2.0).where("minute(ts) < 2"), path)
    stored = read_bars(spark, path)
    assert before == {f for f in stored.inputFiles() if "session_date=2024-05-13" in f}
    got = {(r.session_date, r.close): r.n for r in stored.groupBy("session_date", "close").agg(F.count("*").alias("n")).collect()}
    assert got == {(date(2024, 5, 13), 1.0): 3, (date(2024, 5, 14), 2.0): 2, (date(2024, 5, 14), 1.0): 1}
