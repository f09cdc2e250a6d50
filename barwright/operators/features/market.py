"""Index return and volatility-proxy change at the entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.config import FeatureConfig
from barwright.functions.expr import EPS, clip_lower, ln_ratio, ratio
from barwright.operators.features.group import Group, back
from barwright.operators.positions import drop_halo, with_halo, with_positions


def index_returns(index_bars: DataFrame, bars_back: int) -> DataFrame:
    """(ts, spy_pos, spy_ret_{k}m) of one index series of session-dated bars."""
    name = f"spy_ret_{bars_back}m"
    d = with_halo(with_positions(index_bars), bars_back).withColumn("_then", back("close", bars_back))
    return drop_halo(d).select(
        "ts", F.col("pos").alias("spy_pos"), ln_ratio("close", clip_lower("_then", EPS)).alias(name)
    )


def proxy_change(proxy_daily: DataFrame) -> DataFrame:
    """(session_date, vix_chg_1d): the previous session's change, from daily closes of one proxy."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    change = ratio(F.lag("close", 1).over(w), F.lag("close", 2).over(w)) - 1.0
    return proxy_daily.select("session_date", change.alias("vix_chg_1d"))


def market_context(fc: FeatureConfig) -> Group:
    name = f"spy_ret_{fc.market_spy_return_bars}m"
    return Group({name: F.col(name), "vix_chg_1d": F.col("vix_chg_1d")}, warmup=fc.market_spy_return_bars)


def with_market_context(
    rows: DataFrame, index_bars: DataFrame, proxy_daily: DataFrame, fc: FeatureConfig
) -> DataFrame:
    """Add both columns to rows with ts and session_date; null where the index has no bar at that time or too few before it.

    Meant for narrow rows, bars as they are stored or entries alone: one row for each time and date meets many symbols,
    and what is shuffled for that should be small.
    """
    k = fc.market_spy_return_bars
    idx = index_returns(index_bars, k).where(F.col("spy_pos") >= k).drop("spy_pos")
    return rows.join(idx, "ts", "left").join(proxy_change(proxy_daily), "session_date", "left")


def market_columns(fc: FeatureConfig) -> list[str]:
    return list(market_context(fc).final)
