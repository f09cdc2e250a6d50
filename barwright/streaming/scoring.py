"""Scores of new bars from a state that each batch carries on; no batch reads the bar history.

What the features of the next bars need of the past is small and kept per symbol:

* `slice`: the bars of the last sessions, as many as the longest trailing frame reaches back, and the open session;
* `days`: close and number of bars of each session before those;
* `averages`: the states of the exponential averages after the first bar of the slice.

A batch joins its bars to the slice, scores them, and writes the next state under its own number. A batch that is run
again starts from the state before it and writes the same; a state whose last table is not complete is not read.
Bars older than the slice are late and left out; a bar inside it may still change.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barwright.config import ExperimentConfig
from barwright.operators.features import feature_matrix, warmup_bars
from barwright.operators.features.matrix import CHUNK_ROWS, position_closes
from barwright.operators.features.registry import groups
from barwright.operators.features.technical import technical_state
from barwright.operators.labels import barrier_geometry
from barwright.operators.positions import session_table, slot_table, with_session
from barwright.operators.volatility import reference_stat, with_daily_returns, with_rolling_vol
from barwright.sources.bars import merge_bars

BARS = ["symbol", "ts", "open", "high", "low", "close", "volume"]
PARTS = ("slice", "days", "averages")  # the last one written makes a state complete
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class LiveState:
    """`averages` is None without the technical group; all are None before the first batch."""

    slice: DataFrame | None = None
    days: DataFrame | None = None
    averages: DataFrame | None = None


def bars_needed(cfg: ExperimentConfig) -> int:
    """Bars before a new one that its features can reach, one more to lead the averages, and the warm-up."""
    return max([warmup_bars(cfg.features), *[g.reach for g in groups(cfg.features).values()]]) + 1


def _geometry(new: DataFrame, days: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Entries of the new bars with the barrier geometry of their session, outcome unknown."""
    vol = f"vol_{cfg.vol_lookback_trading_days}d_ann"
    known = with_rolling_vol(with_daily_returns(days), cfg.vol_lookback_trading_days).select(
        "symbol", "session_date", F.col(vol).alias("sigma_ann_at_entry"),
        reference_stat(vol, cfg.vol_ref_method, Window.partitionBy("symbol")).alias("sigma_ref"),
    )
    d = new.join(known, ["symbol", "session_date"]).where(F.col("close").isNotNull() & F.col("sigma_ann_at_entry").isNotNull())
    named = d.select("symbol", F.col("ts").alias("entry_time"), F.col("close").alias("entry_close"), "sigma_ann_at_entry", "sigma_ref")
    return barrier_geometry(named, cfg).withColumn("barrier_outcome", F.lit(None).cast("string"))


def live_features(
    state: LiveState, new: DataFrame, cfg: ExperimentConfig, *, index_bars: DataFrame | None = None, proxy_daily: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(feature rows of the new bars, bars of the slice with the new ones, sessions so far)."""
    new = new.select(*BARS)
    if state.slice is not None:
        first = state.slice.groupBy("symbol").agg(F.min("ts").alias("_first"))
        new = new.join(first, "symbol", "left").where("_first IS NULL OR ts >= _first").drop("_first")
    bars = merge_bars(state.slice, new)
    dated = with_session(bars, cfg.exchange_timezone)
    own = session_table(slot_table(dated)).select("symbol", "session_date", "close", "session_bars")
    days = own if state.days is None else own.unionByName(state.days)
    entries = _geometry(with_session(new, cfg.exchange_timezone), days, cfg)
    rows = feature_matrix(entries, dated, cfg, index_bars=index_bars, proxy_daily=proxy_daily, begun=state.averages)
    return rows, dated, days


def next_state(state: LiveState, dated: DataFrame, days: DataFrame, cfg: ExperimentConfig) -> LiveState:
    """The state after a batch: whole sessions leave the slice when the later ones hold enough bars."""
    slots = slot_table(dated)
    later = Window.partitionBy("symbol").orderBy(F.desc("session_date")).rowsBetween(Window.unboundedPreceding, -1)
    sessions = session_table(slots).withColumn("after", F.coalesce(F.sum("session_bars").over(later), F.lit(0)))
    starts = sessions.where(F.col("after") < bars_needed(cfg)).groupBy("symbol").agg(
        F.min("session_date").alias("first_date"), F.min("first_pos").alias("first_pos")
    )
    kept = dated.join(starts, "symbol").where(F.col("session_date") >= F.col("first_date")).select(*BARS)
    closed = days.join(starts, "symbol").where(F.col("session_date") < F.col("first_date"))
    closed = closed.select("symbol", "session_date", "close", "session_bars")
    if not cfg.features.technical_indicators:
        return LiveState(kept, closed)
    closes = position_closes(dated, slots).join(starts, "symbol").where(F.col("pos") <= F.col("first_pos"))
    return LiveState(kept, closed, technical_state(closes, cfg.features, CHUNK_ROWS, state.averages))


# ---- stored states


def _folder(path: str, batch: int, part: str) -> str:
    return f"{path}/batch={batch:012d}/{part}"


def read_state(spark: SparkSession, path: str, before: int | None = None) -> LiveState:
    """The newest complete state, of a batch below `before` if given; an empty one if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    numbers = sorted((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), reverse=True)
    for n in numbers:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{_folder(path, n, PARTS[-1])}/_SUCCESS")
        if (before is None or n < before) and fs.exists(done):
            parts = {p: spark.read.parquet(_folder(path, n, p)) for p in PARTS}
            return LiveState(**{k: d if "symbol" in d.columns else None for k, d in parts.items()})
    return LiveState()


def write_state(state: LiveState, spark: SparkSession, path: str, batch: int) -> None:
    none = spark.createDataFrame([(0,)], "nothing int")
    for p in PARTS:
        d = getattr(state, p)
        (none if d is None else d).write.mode("overwrite").parquet(_folder(path, batch, p))


def advance(
    spark: SparkSession, path: str, batch: int, new: DataFrame, cfg: ExperimentConfig, scorer: Scorer, out: str,
    *, index_bars: DataFrame | None = None, proxy_daily: DataFrame | None = None,
) -> None:
    """Score a batch of bars into `out` and carry the state on; both under the batch's number."""
    state = read_state(spark, path, before=batch)
    rows, dated, days = live_features(state, new, cfg, index_bars=index_bars, proxy_daily=proxy_daily)
    scorer(rows.withColumn("split", F.lit("live"))).write.mode("overwrite").parquet(f"{out}/batch={batch:012d}")
    write_state(next_state(state, dated, days, cfg), spark, path, batch)


def start_scoring(
    bars: DataFrame, cfg: ExperimentConfig, scorer: Scorer, path: str, out: str, checkpoint: str, *, once: bool = False
) -> StreamingQuery:
    """Score every batch of a bar stream (symbol, ts, prices, volume), with `Model.score` for instance."""

    def on_batch(batch: DataFrame, number: int) -> None:
        stored = batch.select(*BARS).persist()
        try:
            if not stored.isEmpty():
                advance(batch.sparkSession, path, number, stored, cfg, scorer, out)
        finally:
            stored.unpersist()

    w = bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{int(cfg.live.poll_interval_seconds)} seconds")).start()
