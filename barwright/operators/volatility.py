"""Daily volatility that never sees its own day, and its alignment to bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barwright.functions.expr import ln_ratio, trailing
from barwright.operators.positions import session_table, slot_table

TRADING_DAYS_PER_YEAR = 252


def daily_last_close(bars: DataFrame) -> DataFrame:
    """Last non-null close per (symbol, session_date)."""
    return bars.groupBy("symbol", "session_date").agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close")
    )


def with_daily_returns(daily: DataFrame) -> DataFrame:
    """Add `log_ret`, the log return over the symbol's previous session row."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    return daily.withColumn("log_ret", ln_ratio("close", F.lag("close").over(w)))


def with_rolling_vol(
    daily: DataFrame,
    lookback: int,
    *,
    annualize: bool = True,
    trading_days_per_year: int = TRADING_DAYS_PER_YEAR,
) -> DataFrame:
    """Add `sigma_daily_{N}d` and `vol_{N}d_ann` to a daily table with `log_ret`.

    The frame ends one session before the current one, which is the trailing deviation
    shifted by one session.
    """
    if lookback < 2:
        raise ValueError("lookback must be at least 2")
    w = trailing(["symbol"], "session_date", lookback, end=-1)
    sigma = F.when(F.count("log_ret").over(w) == lookback, F.stddev_samp("log_ret").over(w))
    out = daily.withColumn(f"sigma_daily_{lookback}d", sigma)
    if annualize:
        out = out.withColumn(
            f"vol_{lookback}d_ann",
            F.col(f"sigma_daily_{lookback}d") * F.lit(math.sqrt(float(trading_days_per_year))),
        )
    return out


def daily_volatility(bars: DataFrame, lookback: int, *, slots: DataFrame | None = None) -> DataFrame:
    """The per-session table with returns and both volatility columns."""
    days = session_table(slot_table(bars) if slots is None else slots)
    return with_rolling_vol(with_daily_returns(days), lookback)


def add_volatility(bars: DataFrame, lookback: int) -> DataFrame:
    """Every bar of a session gets that session's volatility (null where undefined)."""
    vol = daily_volatility(bars, lookback).select(
        "symbol", "session_date", f"sigma_daily_{lookback}d", f"vol_{lookback}d_ann"
    )
    return bars.join(vol, ["symbol", "session_date"], "left")


def reference_stat(vol_col: str, method: str = "median", over: WindowSpec | None = None) -> Column:
    """Median or mean over all *bars* with a finite volatility, from the session table.

    All bars of a session share one value, so the bar-level statistic is the session-level one
    weighted by the session's bar count; the bars themselves are not read again. With `over` it
    is a window expression, else an aggregate.
    """

    def agg(c: Column) -> Column:
        return c if over is None else c.over(over)

    v, n = F.col(vol_col), F.col("session_bars")
    if method == "median":
        return agg(F.percentile(v, F.lit(0.5), n))
    if method == "mean":
        return agg(F.sum(v * n)) / agg(F.sum(F.when(v.isNotNull(), n)))
    raise ValueError(f"unknown sigma reference method {method!r}")


def sigma_reference(days: DataFrame, vol_col: str, method: str = "median") -> DataFrame:
    """`sigma_ref` per symbol; symbols without any finite volatility are absent."""
    known = days.where(F.col(vol_col).isNotNull())
    return known.groupBy("symbol").agg(reference_stat(vol_col, method).alias("sigma_ref"))


def volatility_summary(days: DataFrame, vol_col: str) -> DataFrame:
    """Bar-weighted summary of the daily volatility per symbol."""
    v, n = F.col(vol_col), F.col("session_bars")
    known = days.where(v.isNotNull())
    mean = F.sum(v * n) / F.sum(n)
    quart = [F.percentile(vol_col, F.lit(q), n).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    centred = known.join(known.groupBy("symbol").agg(mean.alias("_m")), "symbol")
    return centred.groupBy("symbol").agg(
        F.sum(n).alias("count"),
        F.first("_m").alias("mean"),
        F.sqrt(F.try_divide(F.sum(n * F.pow(v - F.col("_m"), 2)), F.sum(n) - 1)).alias("std"),
        F.min(v).alias("min"),
        *quart,
        F.max(v).alias("max"),
    )


def last_rows(bars: DataFrame, rows: int = 8) -> DataFrame:
    """The last bars of each symbol by time, with their place counted from the end; a rank limit applies before the shuffle."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return bars.withColumn("from_end", place).where(F.col("from_end") <= rows)
