"""The store job: which series and dates are wanted, what is missing, and vendor rows into the bar table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.config import ExperimentConfig
from barwright.sources.bars import (
    bar_table, calendar_chunks, fetch_plan, normalize_bars, replace_bars, upsert_bars, with_storage_columns,
)


@dataclass(frozen=True)
class StoreResult:
    version: int
    windows: int


def wanted_series(spark: SparkSession, cfg: ExperimentConfig, symbols: list[str] | None = None) -> DataFrame:
    """(symbol, interval): the main symbol or the given ones at one minute, and every context series of the settings."""
    main = symbols or ([cfg.symbol] if cfg.symbol else [])
    rows = {(s.strip().upper(), "1min") for s in main} | {(c.symbol.strip().upper(), c.interval) for c in cfg.context_symbols}
    return spark.createDataFrame(sorted(rows), "symbol string, interval string")


def requested(raw: DataFrame, windows: DataFrame, date: Column) -> DataFrame:
    """Vendor rows of a requested (symbol, interval) and window; a window is at most a month of dates, so dates are keys."""
    days = windows.select(
        "symbol", "interval", F.explode(F.sequence("chunk_start", "chunk_end")).alias("_day")
    ).distinct()
    return raw.withColumn("_day", date).join(days, ["symbol", "interval", "_day"], "left_semi").drop("_day")


def run_store(
    spark: SparkSession,
    raw: DataFrame,
    wanted: DataFrame,
    cfg: ExperimentConfig,
    path: str,
    *,
    arrival: str,
    time: str = "datetime",
    force: bool = False,
) -> StoreResult:
    """Bring the wanted series up to the data range: gaps in calendar windows, their vendor rows, one new version.

    `raw` are landed vendor rows with symbol, interval, wall times and an arrival order. Without `force` only missing
    ranges are requested and merged; with it the whole range is requested and replaces what is stored. Nothing missing,
    or nothing landed for it, leaves the table as it is.
    """
    if cfg.data_start is None or cfg.data_end is None:
        raise ValueError("data_start and data_end must be set")
    table = bar_table(spark, path)
    if force:
        whole = wanted.withColumns({"range_start": F.lit(cfg.data_start), "range_end": F.lit(cfg.data_end)})
        windows = calendar_chunks(whole, cfg.ingest_chunk_calendar_days)
    else:
        windows = fetch_plan(table.read(), wanted, cfg)
    count = windows.count()
    if count == 0:
        return StoreResult(table.version(), 0)
    day = F.col(time).try_cast("timestamp_ntz").cast("date")
    rows = requested(raw, windows, day)
    fresh = []
    for interval in sorted(r.interval for r in wanted.select("interval").distinct().collect()):
        bars = normalize_bars(rows.where(F.col("interval") == interval), time=time, arrival=arrival, tz=cfg.exchange_timezone)
        fresh.append(with_storage_columns(bars, interval, cfg.exchange_timezone))
    new = fresh[0]
    for d in fresh[1:]:
        new = new.unionByName(d)
    if force:
        return StoreResult(replace_bars(spark, new, wanted, path, cfg.data_start, cfg.data_end), count)
    upsert_bars(spark, new, path)
    return StoreResult(table.version(), count)
