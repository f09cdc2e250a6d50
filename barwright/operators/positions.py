"""Session dates, bar positions and the per-session table.

A bar's position is its row number within its symbol over the whole series. It is built from
counts per (symbol, session, clock hour), so no task ever orders a whole symbol:

    pos = bars in earlier slots of the symbol + row number inside the slot

The slot table is one partial aggregation over the bars and about 1/60 of a 1-minute series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.calendar import session_date

SLOT_SECONDS = 3600
SLOT_KEYS = ["symbol", "session_date", "slot"]


def with_session(bars: DataFrame, tz: str) -> DataFrame:
    """Add `session_date` (local date) and `slot` (clock-hour number)."""
    return bars.withColumn("session_date", session_date("ts", tz)).withColumn(
        "slot", F.floor(F.unix_seconds("ts") / SLOT_SECONDS)
    )


def slot_table(bars: DataFrame) -> DataFrame:
    """One row per (symbol, session, slot): counts, bounds, last close and volume totals."""
    has_close = F.col("close").isNotNull()
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    slots = bars.groupBy(*SLOT_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max(F.when(has_close, F.col("ts"))).alias("close_ts"),
        F.max_by("close", F.when(has_close, F.col("ts"))).alias("last_close"),
        F.max_by("close", "ts").alias("end_close"),
        F.sum(typical * F.col("volume")).alias("pv"),
        F.sum("volume").alias("vol"),
    )
    by_slot = Window.partitionBy("symbol").orderBy("session_date", "slot")
    by_day = Window.partitionBy("symbol").orderBy("session_date")
    in_session = Window.partitionBy("symbol", "session_date").orderBy("slot")
    session = Window.partitionBy("symbol", "session_date")
    before = (Window.unboundedPreceding, -1)
    return slots.withColumns(
        {
            "pos0": F.coalesce(F.sum("n").over(by_slot.rowsBetween(*before)), F.lit(0)),
            "day_rank": F.dense_rank().over(by_day) - 1,
            "n_bars": F.sum("n").over(Window.partitionBy("symbol")),
            "pv0": F.coalesce(F.sum("pv").over(in_session.rowsBetween(*before)), F.lit(0.0)),
            "vol0": F.coalesce(F.sum("vol").over(in_session.rowsBetween(*before)), F.lit(0.0)),
            "slot_prev_close": F.lag("end_close").over(by_slot),
            "open_ts": F.min("first_ts").over(session),
            "end_ts": F.max("last_ts").over(session),
        }
    )


def session_table(slots: DataFrame) -> DataFrame:
    """One row per (symbol, session) with rank, positions, bounds and last close."""
    return slots.groupBy("symbol", "session_date").agg(
        F.min("day_rank").alias("day_rank"),
        F.min("pos0").alias("first_pos"),
        F.sum("n").alias("session_bars"),
        F.min("n_bars").alias("n_bars"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max_by("last_close", "close_ts").alias("close"),
    )


def with_positions(bars: DataFrame, slots: DataFrame | None = None, *extra: str) -> DataFrame:
    """Add `pos`, `day_rank`, `n_bars` and any `extra` slot columns to session-dated bars."""
    slots = slot_table(bars) if slots is None else slots
    in_slot = Window.partitionBy(*SLOT_KEYS).orderBy("ts")
    return (
        bars.join(slots.select(*SLOT_KEYS, "pos0", "day_rank", "n_bars", *extra), SLOT_KEYS)
        .withColumn("pos", F.col("pos0") + F.row_number().over(in_slot) - 1)
        .drop("pos0")
    )


def with_prev_close(positioned: DataFrame) -> DataFrame:
    """Add `prev_close`, the close one bar earlier, from the slot the bar is in or the slot before.

    Needs the slot table's `slot_prev_close`; uses the ordering `with_positions` already made.
    """
    in_slot = Window.partitionBy(*SLOT_KEYS).orderBy("ts")
    return positioned.withColumn(
        "prev_close",
        F.when(F.row_number().over(in_slot) == 1, F.col("slot_prev_close")).otherwise(F.lag("close").over(in_slot)),
    )


def chunk_size(reach: int, chunk_rows: int) -> int:
    """Rows of a chunk: enough that the rows it shares with the next are an eighth of it at most."""
    return max(chunk_rows, 8 * reach)


def with_halo(df: DataFrame, reach: int, *, pos: str = "pos", chunk_rows: int = 16384) -> DataFrame:
    """Split each symbol into `chunk`s of rows, each led by the `reach` rows before it.

    Trailing frames that look back at most `reach` rows can then be partitioned by
    (symbol, chunk): one symbol is spread over many tasks. Rows flagged `halo` only feed the
    frames and are removed by `drop_halo`. The overhead is reach / chunk_rows.
    """
    size = chunk_size(reach, chunk_rows)
    own = F.floor(F.col(pos) / size)
    feeds_next = F.pmod(F.col(pos), F.lit(size)) >= size - reach
    chunks = F.when(feeds_next, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("chunk", F.explode(chunks)).withColumn("halo", F.col("chunk") != own)


def drop_halo(df: DataFrame) -> DataFrame:
    return own_rows(df).drop("chunk")


def own_rows(df: DataFrame) -> DataFrame:
    """The rows that belong to their chunk, which stays as a column."""
    return df.where(~F.col("halo")).drop("halo")


def running_sums(
    df: DataFrame,
    by: list[str],
    order: str,
    sums: dict[str, str],
    *,
    chunk_rows: int = 65536,
) -> DataFrame:
    """Inclusive running sums of `sums` (input column -> output column) along an integer `order`.

    Sums run inside fixed ranges of `order`; range totals are accumulated on a small table and
    added back, so no task has to hold a whole key.
    """
    d = df.withColumn("_c", F.floor(F.col(order) / chunk_rows))
    totals = d.groupBy(*by, "_c").agg(*[F.sum(i).alias(f"_t_{o}") for i, o in sums.items()])
    w = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by, "_c", *[F.coalesce(F.sum(f"_t_{o}").over(w), F.lit(0)).alias(f"_t_{o}") for o in sums.values()]
    )
    inside = Window.partitionBy(*by, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(totals, [*by, "_c"])
    for i, o in sums.items():
        d = d.withColumn(o, F.col(f"_t_{o}") + F.coalesce(F.sum(i).over(inside), F.lit(0)))
    return d.drop("_c", *[f"_t_{o}" for o in sums.values()])
