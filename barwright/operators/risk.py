"""Rolling day-trade cap.

Deciding event by event in time order equals a recurrence over days: with c candidates on a
weekday and u acceptances in the previous N-1 business days, the first min(c, max - u) by time
are accepted. Weekend dates look at the window ending on the Friday before and never enter a
window themselves. The recurrence runs over per-day counts, so its input is one number per day
and group however many events there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.calendar import business_day_index, is_weekend, trailing_weekdays


def _fold_days(days: Column, max_events: int, window_days: int) -> Column:
    """array<struct<session_date, n, allowed>> from date-ordered array<struct<session_date, bd, weekend, n>>."""
    empty = F.struct(
        F.array().cast("array<struct<bd:bigint,a:bigint>>").alias("recent"),
        F.array().cast("array<struct<session_date:date,n:bigint,allowed:bigint>>").alias("out"),
    )

    def step(acc: Column, d: Column) -> Column:
        live = F.filter(acc["recent"], lambda r: r["bd"] > d["bd"] - window_days)
        used = F.aggregate(live, F.lit(0).cast("bigint"), lambda s, r: s + r["a"])
        room = F.greatest(F.lit(max_events) - used, F.lit(0).cast("bigint"))
        weekend_all = F.when(room > 0, d["n"]).otherwise(F.lit(0).cast("bigint"))
        a = F.when(d["weekend"], weekend_all).otherwise(F.least(d["n"], room))
        entered = F.concat(live, F.array(F.struct(d["bd"].alias("bd"), a.alias("a"))))
        return F.struct(
            F.when(d["weekend"], live).otherwise(entered).alias("recent"),
            F.concat(
                acc["out"], F.array(F.struct(d["session_date"].alias("session_date"), d["n"].alias("n"), a.alias("allowed")))
            ).alias("out"),
        )

    return F.aggregate(days, empty, step, lambda acc: acc["out"])


def daily_allowance(events: DataFrame, by: list[str], max_events: int, window_days: int) -> DataFrame:
    """(by..., session_date, n, allowed) for one row per candidate event."""
    counts = events.groupBy(*by, "session_date").agg(F.count(F.lit(1)).alias("n"))
    return allowance_of_counts(counts, by, max_events, window_days)


def allowance_of_counts(counts: DataFrame, by: list[str], max_events: int, window_days: int) -> DataFrame:
    """(by..., session_date, n, allowed) from the candidates `n` of each session."""
    if max_events < 1 or window_days < 1:
        raise ValueError("max_events and window_days must be >= 1")
    day = F.struct(
        "session_date",
        business_day_index("session_date").alias("bd"),
        is_weekend("session_date").alias("weekend"),
        "n",
    )
    folded = counts.groupBy(*by).agg(F.sort_array(F.collect_list(day)).alias("days"))
    return folded.select(
        *by, F.explode(_fold_days(F.col("days"), max_events, window_days)).alias("d")
    ).select(*by, "d.session_date", "d.n", "d.allowed")


def with_cap_decision(
    events: DataFrame, by: list[str], max_events: int, window_days: int, *, candidate: Column, order: str
) -> DataFrame:
    """Add boolean `over_cap`: a candidate event refused by the rolling cap.

    Rows where `candidate` is false neither use nor are limited by the cap. `order`, with the symbol where
    there is one, must be unique within a group and session: an account over several symbols has equal times. A session accepts at most `max_events` candidates or all
    of them, so only its first `max_events` are ranked (a rank limit, applied before the
    shuffle); the last accepted one is the session's cutoff.
    """
    place = F.struct(order, "symbol") if "symbol" in events.columns and order != "symbol" else F.col(order)
    flagged = events.withColumn("_cand", F.coalesce(candidate, F.lit(False)))
    cands = flagged.where("_cand")
    allowed = daily_allowance(cands, by, max_events, window_days)
    keys = [*by, "session_date"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))
    first = cands.select(*keys, place.alias("_o")).withColumn("_rank", rank).where(F.col("_rank") <= max_events)
    cutoff = (
        first.join(allowed, keys)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("_rank") <= F.col("allowed"), F.col("_o"))).alias("_cut"),
            F.max(F.col("allowed") < F.col("n")).alias("_limited"),
        )
    )
    beyond = F.col("_cut").isNull() | (place > F.col("_cut"))
    return (
        flagged.join(cutoff, keys, "left")
        .withColumn("over_cap", F.col("_cand") & F.col("_limited") & beyond)
        .drop("_cand", "_cut", "_limited")
    )


def window_counts(events: DataFrame, as_of: DataFrame, by: list[str], max_events: int, window_days: int) -> DataFrame:
    """Events in the rolling weekday window at each `as_of` date, and whether one more fits.

    `events` and `as_of` carry `by`; dates are `session_date` and `as_of`. Each as-of date names
    its weekdays, so the window lookup is an equi-join.
    """
    per_day = events.groupBy(*by, "session_date").agg(F.count(F.lit(1)).alias("n"))
    days = as_of.select(*by, "as_of", F.explode(trailing_weekdays("as_of", window_days)).alias("session_date"))
    return (
        days.join(per_day, [*by, "session_date"], "left")
        .groupBy(*by, "as_of")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_in_window"))
        .withColumn("can_add", F.col("n_in_window") < max_events)
    )


def history_dates(text: Column) -> Column:
    """Array of dates from comma-separated ISO text."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: p.cast("date"))
