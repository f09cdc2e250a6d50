"""Named queries over the driver's tables.

The tables hold ticks (`events`), so event types stand for symbols, `value` for price and the
tick count for volume; bars are five minutes long, in UTC, and cover all days that have ticks.
Bars and labels are stored tables in a deployment; here they are built once per input folder and
kept (`stage`). The day-of-week group is defined for weekdays only, so its query reads those.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.config import FEATURE_GROUPS, ExperimentConfig, FeatureConfig, LiveConfig
from barwright.functions import calendar as cal
from barwright.functions.expr import EPS, clip_lower
from barwright.operators import backtest as bt
from barwright.operators import evaluation, journal, report, risk, volatility, weights
from barwright.operators.features import feature_columns, feature_matrix, feature_table, split_by_session
from barwright.operators.labels import label_bars, label_issues, outcome_counts
from barwright.operators.positions import slot_table, with_positions, with_session
from barwright.plans import grid, jobs, meta, store, training
from barwright.sources import bars as bar_store
from barwright.sources import runlog, tables
from barwright.sources.journal import normalize_journal
from barwright.sources.ticks import bars_from_ticks
from barwright.streaming import scoring
from barwright.streaming.bars import RECENT_SUFFIX, start_refresh, stream_bars, target_path

Query = Callable[[SparkSession, str], DataFrame]

TZ = "UTC"
BAR_SECONDS = 300
FEATURES = FeatureConfig(
    **{g: True for g in FEATURE_GROUPS},
    returns_horizons_bars=(5, 15),
    realized_vol_windows_bars=(10, 30),
    range_vol_window_bars=10,
    volume_median_window_bars=12,
    market_spy_return_bars=5,
    ema_windows_bars=(9, 21),
    roll_window_bars=10,
    amihud_window_bars=10,
)
#: every group that is defined on all days
ALL_DAYS = replace(FEATURES, session_day_of_week=False)
CFG = ExperimentConfig(
    exchange_timezone=TZ,
    profit_barrier_base=1.0,
    stop_loss_base=0.9,
    vol_lookback_trading_days=5,
    vertical_max_trading_days=2,
    label_entry_stride=2,
    max_day_trades=3,
    train_start=date(2024, 1, 8),
    train_end=date(2024, 1, 22),
    val_start=date(2024, 1, 23),
    val_end=date(2024, 1, 31),
    features=ALL_DAYS,
)
INDEX_SYMBOL, PROXY_SYMBOL = "view", "signup"
SPLIT_COLUMNS = ["symbol", "entry_time", "session_date", "split", "y_true", "y_pred"]

HALF_SHIFT = 3.7e-9

_STAGED: dict[tuple[str, str, str], DataFrame] = {}
_PATHS: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared checkpoint folder; a temporary one in local mode, where there is one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/barwright-{training.new_run_id()}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="barwright-")


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build an upstream table once: written to shared storage if there is any, else persisted."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        d = build()
        if spark.conf.get("spark.checkpoint.dir", None):
            path = f"{scratch(spark)}/{name}"
            d.write.parquet(path)
            _STAGED[key] = spark.read.schema(d.schema).parquet(path)
        else:
            _STAGED[key] = d.persist()
    return _STAGED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def build_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = bars_from_ticks(events(spark, sf_dir), symbol="event_type", ts="ts", price="value", tie="event_id", seconds=BAR_SECONDS)
    return with_session(raw, TZ)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "bars", lambda: build_bars(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "labels", lambda: label_bars(bars(spark, sf_dir), CFG))


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(bars(spark, sf_dir))


def context(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    b = bars(spark, sf_dir)
    return {
        "index_bars": b.where(F.col("symbol") == INDEX_SYMBOL),
        "proxy_daily": volatility.daily_last_close(b.where(F.col("symbol") == PROXY_SYMBOL)),
    }


def matrix(spark: SparkSession, sf_dir: str, cfg: ExperimentConfig = CFG) -> DataFrame:
    extra = context(spark, sf_dir) if cfg.features.market_context else {}
    return feature_matrix(labels(spark, sf_dir), bars(spark, sf_dir), cfg, **extra)


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a fixed arithmetic score in place of a fitted model, so results are exact."""
    p = F.col("entry_pos")
    a, b, c = (p * 53 % 97 + 1, p * 37 % 101 + 1, p * 29 % 89 + 1)
    total = (a + b + c).cast("double")
    d = labels(spark, sf_dir).withColumns(
        {"proba_stop_loss": a / total, "proba_take_profit": b / total, "proba_vertical": c / total}
    )
    s, t, v = (F.col(x) for x in ("proba_stop_loss", "proba_take_profit", "proba_vertical"))
    y = F.when((s >= t) & (s >= v), "stop_loss").when(t >= v, "take_profit").otherwise("vertical")
    return split_by_session(
        d.withColumns(
            {
                "max_proba": F.greatest(s, t, v),
                "y_pred": y,
                "y_true": F.col("barrier_outcome"),
                "meta_proba": (p * 41 % 83 + 1) / F.lit(83.0),
            }
        ),
        CFG,
    )


def predictions(spark: SparkSession, sf_dir: str, split: str | None = "val") -> DataFrame:
    d = scored_labels(spark, sf_dir).select(
        *SPLIT_COLUMNS, "proba_stop_loss", "proba_take_profit", "proba_vertical", "max_proba", "meta_proba"
    )
    return d if split is None else d.where(F.col("split") == split)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.with_trade_facts(predictions(spark, sf_dir), labels(spark, sf_dir), positioned(spark, sf_dir))


def r6(c: Column | str) -> Column:
    """Six digits, with one zero: sums differ in their last bits between engines.

    Prices have two digits, so ratios often end in a half of the sixth; the shift keeps last bits from deciding those.
    """
    c = F.round((F.col(c) if isinstance(c, str) else c) + HALF_SHIFT, 6)
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def show(df: DataFrame) -> DataFrame:
    """Rounded doubles, zone-less times, ISO dates and one integer type, for comparison with SQL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "double":
            c = r6(c)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind == "date":
            c = c.cast("string")
        elif kind == "integer":
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- sources ---------------------------------------------------------------------------------


def q_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(build_bars(spark, sf_dir).drop("slot"))


def raw_vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as vendor text rows: hourly times with repeats, and prices that are not numbers."""
    v = F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"),
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        *[v.alias(c) for c in ("open", "high", "low", "close")],
        F.col("user_id").cast("string").alias("volume"),
        "event_id",
    )


def q_normalized_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(bar_store.normalize_bars(raw_vendor_rows(spark, sf_dir), arrival="event_id", tz=TZ))


def _stored_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = bars(spark, sf_dir).drop("slot")
    stored = b.where(F.col("session_date") <= F.lit(date(2024, 1, 19)))
    new = b.where(F.col("session_date") >= F.lit(date(2024, 1, 15))).withColumn("close", F.col("close") + 1.0)
    return stored, new


def q_merged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(bar_store.merge_bars(*_stored_and_new(spark, sf_dir)))


def q_refreshed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _stored_and_new(spark, sf_dir)
    return show(bar_store.replace_window(stored, new, date(2024, 1, 15), date(2024, 1, 31)))


def stored_bars(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the bars as a stored table, written once per input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "bar table")
    if key not in _PATHS:
        path = f"{scratch(spark)}/bar_table"
        bar_store.upsert_bars(spark, bar_store.with_storage_columns(bars(spark, sf_dir).drop("slot"), "1min", TZ), path)
        _PATHS[key] = path
    return _PATHS[key]


def q_bars_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = {"start": date(2024, 1, 10), "end": date(2024, 1, 17)}
    return show(bar_store.read_bars(spark, stored_bars(spark, sf_dir), symbols=["click", "view"], **span).drop("interval"))


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many thin series: one per user."""
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("symbol"), F.lit("1min").alias("interval"), cal.session_date("ts", TZ).alias("session_date")
    )


def user_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_store.stored_bounds(user_series(spark, sf_dir))


def q_stored_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(user_bounds(spark, sf_dir))


WANTED = (date(2023, 12, 20), date(2024, 2, 10))


def q_missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(bar_store.missing_ranges(user_bounds(spark, sf_dir), *WANTED))


def q_calendar_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = bar_store.missing_ranges(user_bounds(spark, sf_dir), *WANTED)
    return show(bar_store.calendar_chunks(gaps, 7))


def q_exchange_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times read as New York wall time: instants, session dates and a session gate."""
    ny = "America/New_York"
    t = table(spark, sf_dir, "events").select(
        "event_type", cal.wall_time_to_instant("ts", ny).alias("t")
    )
    gate = cal.in_local_window("t", ny, "09:30", "16:00")
    return show(
        t.groupBy("event_type", cal.session_date("t", ny).alias("session_date")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(gate).alias("n_in_session"),
            F.min("t").alias("first_utc"), F.max("t").alias("last_utc"),
        )
    )


def q_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor rows through the store job: a first load, the gap after it, recent bars beside the table, both read as one."""
    raw = raw_vendor_rows(spark, sf_dir).withColumn("interval", F.lit("1min"))
    series = raw.select("symbol", "interval").distinct()
    path = f"{scratch(spark)}/store"
    first = replace(CFG, data_start=date(2024, 1, 1), data_end=date(2024, 1, 12), ingest_chunk_calendar_days=5)
    store.run_store(spark, raw, series, first, path, arrival="event_id")
    store.run_store(spark, raw, series, replace(first, data_end=date(2024, 2, 5)), path, arrival="event_id")
    late = bar_store.normalize_bars(raw, arrival="event_id", tz=TZ).withColumn("close", F.col("close") + 1.0)
    late = bar_store.with_storage_columns(late, "1min", TZ).where(F.col("session_date") >= F.lit(date(2024, 1, 25)))
    bar_store.upsert_bars(spark, late, path + RECENT_SUFFIX)
    both = bar_store.read_bars(spark, path, start=date(2024, 1, 2), end=date(2024, 1, 30), recent=path + RECENT_SUFFIX)
    return show(both.drop("interval"))


# --- volatility and labels ---------------------------------------------------------------------


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.daily_volatility(bars(spark, sf_dir), CFG.vol_lookback_trading_days)


def q_daily_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(volatility.daily_last_close(bars(spark, sf_dir)))


def q_daily_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(_daily(spark, sf_dir).select("symbol", "session_date", "close", "log_ret", "sigma_daily_5d", "vol_5d_ann"))


def q_bar_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = volatility.add_volatility(bars(spark, sf_dir), CFG.vol_lookback_trading_days)
    return show(d.select("symbol", "ts", "sigma_daily_5d", "vol_5d_ann"))


def q_trading_day_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(positioned(spark, sf_dir).select("symbol", "ts", "session_date", "day_rank", "pos", "n_bars"))


def q_sigma_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    a = volatility.sigma_reference(d, "vol_5d_ann", "median").withColumnRenamed("sigma_ref", "sigma_ref_median")
    b = volatility.sigma_reference(d, "vol_5d_ann", "mean").withColumnRenamed("sigma_ref", "sigma_ref_mean")
    return show(a.join(b, "symbol"))


def q_vol_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(volatility.volatility_summary(_daily(spark, sf_dir), "vol_5d_ann"))


def q_vol_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = volatility.add_volatility(bars(spark, sf_dir), CFG.vol_lookback_trading_days)
    return show(volatility.last_rows(d.select("symbol", "ts", "close", "sigma_daily_5d", "vol_5d_ann")))


def q_triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(label_bars(bars(spark, sf_dir), CFG))


def q_triple_barrier_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from ticks in one plan, mean reference, one-day horizon, every bar an entry."""
    raw = bars_from_ticks(events(spark, sf_dir), symbol="event_type", ts="ts", price="value", tie="event_id", seconds=3600)
    cfg = replace(CFG, vol_ref_method="mean", vertical_max_trading_days=1, label_entry_stride=1)
    return show(label_bars(with_session(raw, TZ), cfg))


def q_label_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome_counts(labels(spark, sf_dir))


def q_label_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user bars: users with too few bars or too few sessions for a volatility."""
    raw = bars_from_ticks(events(spark, sf_dir), symbol=F.col("user_id").cast("string"), ts="ts", price="value", tie="event_id", seconds=BAR_SECONDS)
    cfg = replace(CFG, vol_lookback_trading_days=20)
    return label_issues(with_session(raw, TZ), cfg)


# --- features ----------------------------------------------------------------------------------


def _only(group: str) -> FeatureConfig:
    return replace(FEATURES, **{g: g == group for g in FEATURE_GROUPS})


def feature_query(group: str) -> Query:
    """A group on every bar; the two groups that need labels or entries use the matrix."""
    fc = _only(group)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if group == "session_day_of_week":
            weekdays = bars(spark, sf_dir).where(F.weekday("session_date") < 5)
            d = feature_table(weekdays, fc)
        elif group == "label_geometry":
            d = matrix(spark, sf_dir, replace(CFG, features=fc)).withColumnRenamed("entry_time", "ts")
        else:
            extra = context(spark, sf_dir) if group == "market_context" else {}
            d = feature_table(bars(spark, sf_dir), fc, **extra)
        return show(d.select("symbol", "ts", *feature_columns(fc)))

    return run


def q_feat_long_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing frames of 30 to 120 bars."""
    fc = replace(
        FEATURES, **{g: g in ("realized_vol_multi", "range_vol_multi", "order_flow_proxies") for g in FEATURE_GROUPS},
        realized_vol_windows_bars=(30, 120), range_vol_window_bars=60, roll_window_bars=50, amihud_window_bars=40,
    )
    return show(feature_table(bars(spark, sf_dir), fc).select("symbol", "ts", *feature_columns(fc)))


def gappy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose close is missing three times in eleven, at fixed times of the day."""
    gap = F.pmod(F.floor(F.unix_seconds("ts") / BAR_SECONDS), F.lit(11)).isin(0, 3, 4)
    return bars(spark, sf_dir).withColumn("close", F.when(~gap, F.col("close")))


def q_feat_technical_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages over series with missing closes."""
    fc = _only("technical_indicators")
    return show(feature_table(gappy_bars(spark, sf_dir), fc).select("symbol", "ts", *feature_columns(fc)))


def q_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(matrix(spark, sf_dir).drop("bars_forward"))


def q_split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_balance(split_by_session(matrix(spark, sf_dir), CFG), ["symbol", "split"])


def q_known_class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows whose class occurs in the train range, which ends before end_of_data."""
    d = split_by_session(labels(spark, sf_dir).withColumnRenamed("barrier_outcome", "y"), CFG)
    return evaluation.class_balance(training.known_class_rows(d), ["split"])


# --- weights -----------------------------------------------------------------------------------


def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = split_by_session(labels(spark, sf_dir), CFG).where(F.col("split") == "train")
    return d.withColumnRenamed("barrier_outcome", "y")


def q_uniqueness_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = weights.uniqueness_weights(train_labels(spark, sf_dir))
    return show(d.select("symbol", "entry_time", "uniqueness"))


def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(weights.balanced_class_weights(train_labels(spark, sf_dir), by=["symbol"]))


def q_fit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = weights.with_fit_weights(train_labels(spark, sf_dir), method="uniqueness", class_weight="balanced")
    return show(d.select("symbol", "entry_time", "uniqueness", "class_weight", "fit_weight"))


def q_weight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cw = {"take_profit": 2.0, "stop_loss": 0.5}
    d = weights.with_fit_weights(train_labels(spark, sf_dir), method="uniqueness", class_weight=cw)
    return show(weights.weight_summary(d, ["symbol"]))


# --- risk and backtests ------------------------------------------------------------------------


def q_daytrade_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: events in the five weekdays ending at each date the user was active on."""
    e = events(spark, sf_dir).select("user_id", cal.session_date("ts", TZ).alias("session_date"))
    as_of = e.select("user_id", F.col("session_date").alias("as_of")).distinct()
    return show(risk.window_counts(e, as_of, ["user_id"], 10, 5))


def q_daytrade_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a user as a candidate day trade, weekends included; at most 5 in 5 days."""
    e = events(spark, sf_dir).select("user_id", "event_id", "ts", cal.session_date("ts", TZ).alias("session_date"))
    order = F.struct("ts", "event_id")
    d = risk.with_cap_decision(
        e.withColumn("o", order), ["user_id"], 5, 5, candidate=F.lit(True), order="o"
    )
    return show(d.select("user_id", "event_id", "session_date", "over_cap"))


def q_weekday_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).select(cal.session_date("ts", TZ).alias("d"), "user_id").groupBy("d").agg(
        F.count_distinct("user_id").alias("n_users")
    )
    w = cal.trailing_weekdays("d", 5)
    return show(
        d.select(
            "d", "n_users", cal.anchor_weekday("d").alias("anchor"), w[0].alias("window_start"),
            cal.business_day_index("d").alias("bd"),
        )
    )


def q_history_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated ISO dates per user, parsed back and counted in the window ending at the last one."""
    e = events(spark, sf_dir).select("user_id", cal.session_date("ts", TZ).alias("d"))
    text = e.groupBy("user_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set("d")), lambda x: x.cast("string")), ", ").alias("history"),
        F.max("d").alias("as_of"),
    )
    parsed = text.select("user_id", F.explode(risk.history_dates(F.col("history"))).alias("session_date"))
    return show(risk.window_counts(parsed, text.select("user_id", "as_of"), ["user_id"], 3, 5))


def q_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = facts(spark, sf_dir).where(bt.is_signal(bt.POLICY_ARGMAX))
    return show(bt.trades(signals, CFG, ["symbol"]))


def portfolio_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction in the account of all symbols, and those of two symbols in an account of their own too."""
    own = F.when(F.col("symbol").isin("click", "view"), F.array(F.lit("all"), F.lit("two"))).otherwise(F.array(F.lit("all")))
    return facts(spark, sf_dir).withColumn("account", F.explode(own))


def q_portfolio_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap of an account over many symbols, whose signals share bar times."""
    signals = portfolio_facts(spark, sf_dir).where(bt.is_signal(bt.POLICY_ARGMAX))
    d = bt.trades(signals, CFG, ["account"])
    return show(d.select("account", "symbol", "entry_time", "session_date", "taken", "blocked_reason"))


def q_portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same accounts' economics, from the one-pass summary of the entry policies."""
    d = bt.compare_policies(portfolio_facts(spark, sf_dir).drop("meta_proba"), CFG, base=["account"])
    argmax = d.where(F.col("policy") == bt.POLICY_ARGMAX)
    return show(argmax.select(
        "account", "n_signals", "n_trades_taken", "n_trades_blocked_day_trade_cap", "gross_return_sum", "max_drawdown_cumulative_sum"
    ))


def q_trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, _ = jobs.backtest(facts(spark, sf_dir), CFG, threshold=0.4)
    return show(summary)


def q_signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return show(bt.signal_metrics(p, p.where(bt.is_signal(bt.POLICY_ARGMAX)), ["symbol"], ["symbol"]))


def q_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(bt.threshold_sweep(facts(spark, sf_dir), CFG))


def q_suggested_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(bt.suggest_threshold(bt.threshold_sweep(facts(spark, sf_dir), CFG)))


def q_policy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(bt.compare_policies(facts(spark, sf_dir), CFG, threshold=0.35, act=0.5))


# --- evaluation, journal, run log --------------------------------------------------------------


def q_confusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = ["stop_loss", "take_profit", "vertical"]
    p = predictions(spark, sf_dir).where(F.col("y_true") != "end_of_data")
    return show(evaluation.classification_report(p, ["symbol"], classes=classes))


def q_f1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(evaluation.f1_scores(predictions(spark, sf_dir, None), ["symbol", "split"]))


def q_meta_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = meta.with_meta_features(predictions(spark, sf_dir, None).drop("proba_vertical"))
    return show(meta.gated_metrics(p, 0.35, ["symbol", "split"]))


def q_leaked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated rows of both splits that are no primary-training rows, per split."""
    p = predictions(spark, sf_dir, None)
    gated = p.where(F.col("proba_take_profit") >= 0.35)
    return meta.leaked_rows(gated, p.where(F.col("split") == "train")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def q_session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(journal.session_rollup(predictions(spark, sf_dir), by=["symbol"]))


def raw_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    blank = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit(" Click "))
    return e.where(F.col("event_type") == "purchase").select(
        F.date_format("ts", "yyyy-MM-dd").alias("Open Date"),
        F.when(F.col("event_id") % 5 == 0, F.lit("other")).otherwise(blank).alias("Ticker"),
        "event_id",
    )


def q_journal_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as a journal with free header names, against the predictions of one symbol."""
    j = normalize_journal(raw_journal(spark, sf_dir), "click").select("entry_date", "event_id")
    p = predictions(spark, sf_dir).where(F.col("symbol") == "click")
    return show(journal.compare_journal(j, p).fillna(0, ["pred_n"]))


def q_journal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.match_counts(q_journal_compare(spark, sf_dir))


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run-log records with nested settings."""
    score = F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") / 1000.0, 6))
    return events(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("logged_at_utc"),
        F.format_string("r%09d", "event_id").alias("run_id"),
        F.upper("event_type").alias("symbol"),
        score.alias("val_f1_macro"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("train_accuracy"),
        F.struct(
            F.from_json("props", "struct<k:bigint>").alias("props"),
            F.array(F.col("user_id"), F.col("event_id")).alias("ids"),
            F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("note"),
        ).alias("experiment_config"),
    )


def q_runlog_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(runlog.order_columns(runlog.flatten(run_rows(spark, sf_dir))))


def q_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = report.leaderboard(run_rows(spark, sf_dir), by=["symbol"])
    return show(d.select("rank", "run_id", "symbol", "val_f1_macro"))


def q_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(report.best_run(run_rows(spark, sf_dir).select("symbol", "run_id", "val_f1_macro"), ["symbol"]))


def q_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = report.log_tail(run_rows(spark, sf_dir), "click")
    return show(d.select("logged_at_utc", "run_id", "symbol", "val_f1_macro"))


def q_backfilled_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_rows(spark, sf_dir).select("logged_at_utc", "run_id", "train_accuracy")
    stored = events(spark, sf_dir).select(
        F.format_string("r%09d", "event_id").alias("run_id"), (F.col("value") * 2).alias("train_accuracy")
    )
    return show(report.backfilled_trials(log, stored))


def q_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of the report of each symbol's latest of many runs (one per session of predictions)."""
    p = predictions(spark, sf_dir).withColumn("run_id", F.date_format("session_date", "yyyyMMdd"))
    keys = ["symbol", "run_id"]
    classes = evaluation.per_class(evaluation.confusion(p, keys), keys).drop("tp")
    metrics = evaluation.f1_scores(p, keys)
    parts = report.run_report(metrics.withColumn("logged_at_utc", F.col("run_id")), metrics, classes)

    def part(name: str, label: Column, a: str, b: str, c: str, n: str) -> DataFrame:
        return parts[name].select(
            F.lit(name).alias("part"), *keys, label.alias("class"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"), F.col(n).alias("n")
        )

    quality = ("accuracy", "f1_macro", "f1_weighted", "n")
    return show(
        part("per_class", F.col("class"), "precision", "recall", "f1", "support")
        .unionByName(part("metrics", F.lit(""), *quality)).unionByName(part("log_tail", F.lit(""), *quality))
    )


# --- stored runs -------------------------------------------------------------------------------


def q_run_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with different classes in one table: each read with its own columns, both read as one."""
    p, path = predictions(spark, sf_dir, None), f"{scratch(spark)}/predictions"
    tables.write_predictions(p.drop("proba_take_profit"), path, "r1", "all")
    tables.write_predictions(p.drop("proba_vertical"), path, "r2", "all")
    latest = tables.read_predictions(spark, path, split="all").withColumn("run_id", F.lit("latest"))
    both = tables.read_runs(spark, path).unionByName(latest, allowMissingColumns=True)
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("proba_stop_loss", "proba_take_profit", "proba_vertical")]
    return show(both.groupBy("run_id", "symbol", "split").agg(F.count(F.lit(1)).alias("n"), *sums))


def stored_run(spark: SparkSession, sf_dir: str) -> jobs.Stored:
    """Bars, labels and one run of predictions on storage, written once per input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "run")
    if key not in _PATHS:
        path = scratch(spark)
        tables.write_labels(labels(spark, sf_dir), f"{path}/labels")
        tables.write_predictions(predictions(spark, sf_dir, None), f"{path}/predictions", "r1", "all")
        _PATHS[key] = path
    path = _PATHS[key]
    return jobs.Stored(spark, CFG, stored_bars(spark, sf_dir), f"{path}/labels", path)


def q_stored_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(jobs.run_backtest(stored_run(spark, sf_dir), threshold=0.4))


def q_stored_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = stored_run(spark, sf_dir)
    jobs.run_backtest(at)
    return show(tables.read_run(spark, f"{at.out}/trades", "r1").drop("run_id"))


def q_stored_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(jobs.run_sweep(stored_run(spark, sf_dir))[0])


def q_stored_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchases of `journal_compare` as a CSV file, beside the stored run."""
    at = stored_run(spark, sf_dir)
    path = f"{scratch(spark)}/journal"
    raw_journal(spark, sf_dir).write.option("header", True).csv(path)
    rows, _ = jobs.run_journal(replace(at, cfg=replace(CFG, symbol="click")), path)
    return show(rows.select("entry_date", F.col("event_id").cast("bigint").alias("event_id"), "session_date", "pred_n", "y_true_first", "y_pred_mode", "max_proba_mean", "model_matched").fillna(0, ["pred_n"]))


# --- models ------------------------------------------------------------------------------------


def full_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "matrix", lambda: matrix(spark, sf_dir))


def _supports(scored: DataFrame, classes: list[str]) -> DataFrame:
    """For each split and class its rows, all rows, and the sum of all probabilities, which is the number of rows."""
    total = sum((F.col(training.proba_column(c)) for c in classes), F.lit(0.0))
    counts = scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(total).alias("proba_total"), *[F.count_if(F.col("y_true") == c).alias(f"s{i}") for i, c in enumerate(classes)]
    )
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"s{i}").alias("support")) for i, c in enumerate(classes)]))
    return counts.select("split", "n", "proba_total", each.alias("e")).select("split", "e.*", "n", "proba_total")


def q_train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features, standard scaling, balanced classes and uniqueness; is the fit at the optimum of its loss?"""
    cfg = replace(
        CFG, scaler="standard", model=replace(CFG.model, class_weight="balanced"), train=replace(CFG.train, sample_weight_method="uniqueness")
    )
    data = training.prepare(full_matrix(spark, sf_dir), cfg)
    result = training.train(full_matrix(spark, sf_dir), cfg, data=data)
    steepest = training.logistic_gradient(result.model, data, cfg)
    return show(_supports(result.predictions, data.classes).withColumn("at_optimum", F.lit(steepest < 1e-3)))


def q_train_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features and the default settings of the boosted trees."""
    cfg = replace(CFG, scaler="robust", model=replace(CFG.model, type="boosted_trees"))
    result = training.train(full_matrix(spark, sf_dir), cfg)
    return show(_supports(result.predictions, result.model.classes))


def q_meta_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary and meta model as one pipeline, stored and loaded: does it give every row the same meta_proba?"""
    cfg = replace(CFG, scaler="standard")
    data = training.prepare(full_matrix(spark, sf_dir), cfg)
    primary = training.fit(data, cfg)
    scored = primary.predictions(data.rows).persist()
    on_train = scored.where(F.col("split") == "train")
    second = meta.train_meta(on_train, on_train, cfg, threshold=0.05)
    path = f"{scratch(spark)}/both"
    second.after(primary).save(path)
    keys = ["symbol", "entry_time", "split"]
    loaded = PipelineModel.load(path).transform(data.rows).select(*keys, F.col("meta_proba").alias("loaded"))
    both = second.score(scored).join(loaded, keys)
    same = F.abs(F.col("meta_proba") - F.col("loaded")) < 1e-12
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_same"))


GRID_PARAMS = {"model.logistic_c": [0.1, 1.0], "train.min_val_rows": [1, 10**9]}


def q_grid_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = grid.build_configs(CFG, GRID_PARAMS, prefix="g")
    return show(grid.dry_run(spark, pairs, lambda cfg: full_matrix(spark, sf_dir))).drop("error")


def q_grid_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination on all features, one stored matrix for all."""
    params = {"model.logistic_c": [0.1, 1.0], "scaler": ["standard", "robust"]}
    pairs = grid.build_configs(CFG, params, prefix="g")
    done = grid.train_all(spark, pairs, lambda cfg: full_matrix(spark, sf_dir))
    return done.select("`grid.model.logistic_c`", "`grid.scaler`", "ok", "experiment_name", "train_n", "val_n", "error", "sample_weight_method")


# --- streaming ---------------------------------------------------------------------------------


def q_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick files as a stream, merged into a bar table until the input is drained."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ticks = raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"), F.lit(1.0).alias("size"),
    )
    cfg = replace(CFG, live=LiveConfig(refresh_lookback_calendar_days=2))
    where = scratch(spark)
    path = f"{where}/bars"
    query = start_refresh(
        stream_bars(ticks, cfg, seconds=BAR_SECONDS), cfg, path, f"{where}/progress", interval="5min", once=True
    )
    query.awaitTermination()
    out = bar_store.read_bars(spark, target_path(path, cfg), interval="5min")
    return show(out.drop("interval").select("symbol", "ts", "open", "high", "low", "close", "volume", "session_date"))


LIVE_GROUPS = ("returns_multi_horizon", "realized_vol_multi", "range_vol_multi", "vwap_distance", "technical_indicators")


def q_stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of every new bar over three batches, each from the state the batch before left."""
    fc = replace(FEATURES, **{g: g in LIVE_GROUPS for g in FEATURE_GROUPS})
    cfg, b, where = replace(CFG, features=fc), bars(spark, sf_dir), scratch(spark)
    limits = [date(2024, 1, 1), date(2024, 1, 12), date(2024, 1, 22), date(2025, 1, 1)]
    for n, (start, end) in enumerate(zip(limits, limits[1:])):
        new = b.where((F.col("session_date") >= F.lit(start)) & (F.col("session_date") < F.lit(end)))
        scoring.advance(spark, f"{where}/state", n, new, cfg, lambda rows: rows, f"{where}/scores")
    scores = spark.read.parquet(*[f"{where}/scores/batch={n:012d}" for n in range(3)])
    return show(scores.select("symbol", "entry_time", *feature_columns(fc)))


QUERIES: dict[str, Query] = {
    **{n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")},
    **{f"feat_{g}": feature_query(g) for g in FEATURE_GROUPS},
}
