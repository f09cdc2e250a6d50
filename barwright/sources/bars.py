"""The bar table: cleaning, merging, gap detection, reading and writing.

Layout: partitioned by interval and session_date, rows ordered by (symbol, ts) inside files, so
a date range prunes directories and a symbol filter prunes row groups. A symbol is no directory
level because a universe times its dates would be millions of small files. A table that is merged
into is a `SnapshotTable`: each merge is a new version, and readers see one version.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.config import ContextSymbol, ExperimentConfig, validate_proxy_symbol
from barwright.functions.calendar import session_date, wall_time_to_instant
from barwright.functions.expr import col, to_double
from barwright.sources.snapshots import Partition, SnapshotTable

PRICES = ("open", "high", "low", "close", "volume")
BOUNDS_TOLERANCE_DAYS = 4

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in PRICES],
        T.StructField("interval", T.StringType()),
        T.StructField("session_date", T.DateType()),
    ]
)


def keep_last(bars: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row by `order` for each key; combined on the map side, so copies never pile up."""
    rest = [c for c in bars.columns if c not in keys]
    kept = bars.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return kept.select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*bars.columns)


def normalize_bars(
    raw: DataFrame,
    *,
    symbol: Column | str = "symbol",
    time: Column | str = "datetime",
    arrival: Column | str,
    tz: str,
) -> DataFrame:
    """Vendor rows to bars: wall times to instants, numbers coerced, last arrival kept per time."""
    t = col(time).try_cast("timestamp_ntz")
    cols = [to_double(c).alias(c) if c in raw.columns else F.lit(None).cast("double").alias(c) for c in PRICES]
    parsed = raw.select(
        col(symbol).cast("string").alias("symbol"),
        wall_time_to_instant(t, tz).alias("ts"),
        *cols,
        col(arrival).alias("_arrival"),
    ).where(F.col("ts").isNotNull())
    return keep_last(parsed, ["symbol", "ts"], F.col("_arrival")).drop("_arrival")


def merge_bars(existing: DataFrame | None, *new: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Union of stored and new bars; the later argument wins at equal keys."""
    parts = [d for d in (existing, *new) if d is not None]
    if not parts:
        raise ValueError("nothing to merge")
    tagged = [d.withColumn("_source", F.lit(i)) for i, d in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_last(union, list(keys), F.col("_source")).drop("_source")


def replace_window(existing: DataFrame, new: DataFrame, start: date, end: date) -> DataFrame:
    """Forced refresh: drop stored bars inside the session-date window, then merge the new ones."""
    outside = existing.where(~F.col("session_date").between(F.lit(start), F.lit(end)))
    return merge_bars(outside, new)


def stored_bounds(bars: DataFrame) -> DataFrame:
    by = [c for c in ("symbol", "interval") if c in bars.columns]
    return bars.groupBy(*by).agg(
        F.min("session_date").alias("stored_start"), F.max("session_date").alias("stored_end")
    )


def missing_ranges(bounds: DataFrame, start: Column | date, end: Column | date) -> DataFrame:
    """Head and tail date ranges a series still lacks: one row per (series, range).

    `bounds` has stored_start and stored_end, null for a series with nothing stored. A gap of up
    to four calendar days at either end is tolerated.
    """
    a = start if isinstance(start, Column) else F.lit(start)
    b = end if isinstance(end, Column) else F.lit(end)
    s, e = F.col("stored_start"), F.col("stored_end")
    days = BOUNDS_TOLERANCE_DAYS

    def piece(cond: Column, lo: Column, hi: Column) -> Column:
        return F.when(cond, F.struct(lo.alias("range_start"), hi.alias("range_end")))

    nothing = s.isNull() | e.isNull()
    ranges = F.array_compact(
        F.array(
            piece(nothing, a, b),
            piece(~nothing & (s > F.date_add(a, days)), a, F.date_sub(s, 1)),
            piece(~nothing & (F.date_add(e, days) < b), F.date_add(e, 1), b),
        )
    )
    kept = [c for c in bounds.columns if c not in ("stored_start", "stored_end")]
    return bounds.select(*kept, F.explode(ranges).alias("r")).select(*kept, "r.*")


def calendar_chunks(ranges: DataFrame, days: int) -> DataFrame:
    """Split each [range_start, range_end] into inclusive windows of at most `days` days."""
    if days < 1:
        raise ValueError("days must be >= 1")
    a, b = F.col("range_start"), F.col("range_end")
    step = F.make_dt_interval(F.lit(days))
    starts = F.when(b >= a, F.sequence(a, b, step)).otherwise(F.array().cast("array<date>"))
    return ranges.withColumn("chunk_start", F.explode(starts)).withColumn(
        "chunk_end", F.least(b, F.date_add("chunk_start", days - 1))
    )


def fetch_plan(stored: DataFrame, wanted: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Windows to request for every wanted (symbol, interval): missing ranges in calendar chunks."""
    bounds = wanted.join(stored_bounds(stored), ["symbol", "interval"], "left")
    gaps = missing_ranges(bounds, cfg.data_start, cfg.data_end)
    return calendar_chunks(gaps, cfg.ingest_chunk_calendar_days)


PARTITIONS = ("interval", "session_date")
ORDER = ("symbol", "ts")


def bar_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, BAR_SCHEMA, PARTITIONS)


def read_bars(
    spark: SparkSession,
    path: str,
    *,
    symbols: Iterable[str] | None = None,
    interval: str = "1min",
    start: date | None = None,
    end: date | None = None,
    recent: str | None = None,
) -> DataFrame:
    """Stored bars of an interval, pruned to the inclusive session-date range and symbols.

    `path` is a versioned table or a plain one; bars of a `recent` table beside it win at equal times.
    """
    if recent is not None:
        kept = {"symbols": None if symbols is None else list(symbols), "interval": interval, "start": start, "end": end}
        main = read_bars(spark, path, **kept)
        return merge_bars(main, read_bars(spark, recent, **kept), keys=("symbol", "interval", "ts"))
    table = bar_table(spark, path)
    if table.exists():
        lo, hi = str(start or date.min), str(end or date.max)
        d = table.read(wanted=lambda p: p[0] == interval and lo <= p[1] <= hi)
    else:
        d = spark.read.schema(BAR_SCHEMA).parquet(path)
    d = d.where(F.col("interval") == interval)
    if start is not None:
        d = d.where(F.col("session_date") >= F.lit(start))
    if end is not None:
        d = d.where(F.col("session_date") <= F.lit(end))
    if symbols is not None:
        d = d.where(F.col("symbol").isin(*symbols))
    return d


def read_configured(spark: SparkSession, path: str, cfg: ExperimentConfig) -> DataFrame:
    """The main symbol's 1-minute bars (all symbols when none is named) in the data range."""
    names = None if cfg.symbol is None else [cfg.symbol.upper()]
    return read_bars(spark, path, symbols=names, start=cfg.data_start, end=cfg.data_end)


def read_context(spark: SparkSession, path: str, cfg: ExperimentConfig) -> tuple[DataFrame, DataFrame]:
    """(index series 1-minute bars, daily bars of the volatility proxy)."""
    proxy: ContextSymbol | None = cfg.volatility_proxy
    index = next((c for c in cfg.context_symbols if c.symbol.upper() == "SPY"), None)
    if index is None or proxy is None:
        raise ValueError("market context needs SPY and a daily volatility proxy among context_symbols")
    span = {"start": cfg.data_start, "end": cfg.data_end}
    return (
        read_bars(spark, path, symbols=[index.symbol.upper()], interval=index.interval, **span),
        read_bars(spark, path, symbols=[validate_proxy_symbol(proxy.symbol)], interval=proxy.interval, **span),
    )


def write_bars(bars: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write session-dated bars; with `overwrite` only the dates present are replaced."""
    (
        bars.repartitionByRange("interval", "session_date", "symbol", "ts")
        .sortWithinPartitions("interval", "session_date", "symbol", "ts")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("interval", "session_date")
        .parquet(path)
    )


def touched_partitions(rows: DataFrame) -> set[Partition]:
    """The (interval, date) pairs of a batch, as text: at most one for each day of its look-back."""
    found = rows.select(*[F.col(c).cast("string") for c in PARTITIONS]).distinct().collect()
    return {tuple(r) for r in found}


def upsert_bars(spark: SparkSession, new: DataFrame, path: str) -> bool:
    """Merge new bars into the stored table as its next version, rewriting only the dates they touch.

    Returns False, leaving the table alone, when there is nothing new. A repeated batch gives the same rows.
    """
    touched = touched_partitions(new)
    if not touched:
        return False
    table = bar_table(spark, path)
    now = table.version()
    same_days = table.read(now, touched.__contains__)
    table.commit(merge_bars(same_days, new, keys=("symbol", "interval", "ts")), ORDER, after=now)
    return True


def replace_bars(spark: SparkSession, new: DataFrame, series: DataFrame, path: str, start: date, end: date) -> int:
    """Forced refresh of the `series` (symbol, interval) in a session-date window, as the table's next version.

    Their stored bars inside the window go, whether or not a new bar takes their place; other series and dates stay.
    """
    table = bar_table(spark, path)
    now = table.version()
    inside = {p for p in table.manifest(now) if str(start) <= p[1] <= str(end)}
    named = series.select("symbol", "interval").distinct()
    stored = table.read(now, inside.__contains__).join(named, ["symbol", "interval"], "left_anti")
    rest = table.read(now, (touched_partitions(new) - inside).__contains__)
    merged = merge_bars(stored.unionByName(rest), new, keys=("symbol", "interval", "ts"))
    return table.commit(merged, ORDER, after=now, dropped=inside)


def with_storage_columns(bars: DataFrame, interval: str, tz: str) -> DataFrame:
    """Add `interval` and the partition date to bars about to be stored."""
    return bars.withColumn("interval", F.lit(interval)).withColumn("session_date", session_date("ts", tz))
