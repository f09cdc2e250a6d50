"""OHLCV bars from a table of ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.expr import col, finite


def bars_from_ticks(
    ticks: DataFrame,
    *,
    symbol: Column | str,
    ts: Column | str,
    price: Column | str,
    size: Column | str | None = None,
    tie: Column | str | None = None,
    seconds: int = 60,
) -> DataFrame:
    """One bar per symbol and interval: first, max, min, last price; volume = size or tick count.

    Only mergeable aggregates are used, so a symbol or bar that holds a large share of the
    ticks is combined on the map side before the shuffle.
    """
    order = F.struct(col(ts), col(tie)) if tie is not None else col(ts)
    t = ticks.select(
        col(symbol).alias("symbol"),
        F.timestamp_seconds(F.floor(F.unix_seconds(col(ts)) / seconds) * seconds).alias("bar_ts"),
        order.alias("o"),
        finite(col(price).cast("double")).alias("p"),
        (col(size).cast("double") if size is not None else F.lit(1.0)).alias("q"),
    ).where(F.col("p").isNotNull())
    return t.groupBy("symbol", F.col("bar_ts").alias("ts")).agg(
        F.min_by("p", "o").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "o").alias("close"),
        F.sum("q").alias("volume"),
    )
