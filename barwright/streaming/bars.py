"""Bars from a tick stream, merged into the bar table batch by batch, and live scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barwright.config import ExperimentConfig
from barwright.functions.calendar import in_local_window
from barwright.functions.expr import finite
from barwright.operators.features import feature_matrix, warmup_bars
from barwright.operators.labels import entry_geometry
from barwright.operators.positions import with_session
from barwright.plans.training import Model
from barwright.sources.bars import upsert_bars, with_storage_columns

RECENT_SUFFIX = "_recent"

TICK_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
    ]
)


def tick_stream(spark: SparkSession, path: str, schema: T.StructType = TICK_SCHEMA, *, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_bars(ticks: DataFrame, cfg: ExperimentConfig, *, seconds: int = 60, tie: str | None = None) -> DataFrame:
    """Tumbling bars of (symbol, ts, price, size) ticks; `tie` orders ticks of one time, as in `bars_from_ticks`.

    The watermark is the configured look-back, so later ticks are late data and state stays
    bounded; ticks outside the local session window are dropped.
    """
    live = cfg.live
    open_now = in_local_window("ts", cfg.exchange_timezone, live.session_start_local, live.session_end_local)
    late = f"{live.refresh_lookback_calendar_days} days"
    order = F.struct("ts", tie) if tie is not None else F.col("ts")
    grouped = (
        ticks.withColumn("price", finite("price")).where(open_now & F.col("price").isNotNull())
        .withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w"))
    )
    bars = grouped.agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def target_path(path: str, cfg: ExperimentConfig) -> str:
    """The main table, or a table of recent bars beside it."""
    return path if cfg.live.merge_strategy == "merge_into_main" else path.rstrip("/") + RECENT_SUFFIX


def start_refresh(
    bars: DataFrame, cfg: ExperimentConfig, path: str, checkpoint: str,
    *, interval: str = "1min", once: bool = False, on_batch: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Merge changed bars into the table every poll interval (or until the input is drained).

    A bar that changes is written again and replaces its earlier version, and a repeated batch
    gives the same table. An empty batch leaves the table alone.
    """
    where = target_path(path, cfg)

    def merge(batch: DataFrame, _: int) -> None:
        stored = with_storage_columns(batch, interval, cfg.exchange_timezone).persist()
        try:
            if upsert_bars(batch.sparkSession, stored, where) and on_batch is not None:
                on_batch(stored)
        finally:
            stored.unpersist()

    w = bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge)
    poll = f"{int(cfg.live.poll_interval_seconds)} seconds"
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=poll)).start()


def score_new_bars(
    history: DataFrame, new: DataFrame, cfg: ExperimentConfig, model: Model,
    *, index_bars: DataFrame | None = None, proxy_daily: DataFrame | None = None,
) -> DataFrame:
    """Score the new bars with a saved model.

    `history` is a trailing slice of the table that includes the new bars and at least the
    feature warm-up (`warmup_bars`) and volatility look-back before them. Session-end features
    see the session only as far as it has come.
    """
    dated = with_session(history, cfg.exchange_timezone)
    entries = entry_geometry(dated, cfg).join(
        new.select("symbol", F.col("ts").alias("entry_time")), ["symbol", "entry_time"], "left_semi"
    )
    rows = feature_matrix(entries, dated, cfg, index_bars=index_bars, proxy_daily=proxy_daily)
    return model.score(rows.withColumn("split", F.lit("live")))


__all__ = [
    "TICK_SCHEMA", "score_new_bars", "start_refresh", "stream_bars", "target_path", "tick_stream", "warmup_bars",
]
