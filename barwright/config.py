"""Experiment settings as frozen dataclasses with range checks; unknown keys are refused."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date
from typing import Any

CLOCK = re.compile(r"([01]\d|2[0-3]):[0-5]\d")
SPOT_INDEX_NAMES = ("VIX",)


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _ranges(obj: Any, **limits: tuple[float | None, float | None, bool]) -> None:
    """(low, high, low_is_open) per field; None leaves a side open."""
    for name, (lo, hi, open_lo) in limits.items():
        v = getattr(obj, name)
        if v is None:
            continue
        if lo is not None:
            _check(v > lo if open_lo else v >= lo, f"{name}={v} is below its minimum {lo}")
        if hi is not None:
            _check(v <= hi, f"{name}={v} is above its maximum {hi}")


def _choice(obj: Any, name: str, *allowed: Any) -> None:
    v = getattr(obj, name)
    _check(v in allowed, f"{name}={v!r}; expected one of {allowed}")


@dataclass(frozen=True)
class ModelConfig:
    type: str = "logistic_regression"
    random_seed: int = 42
    logistic_c: float = 1.0
    max_iter: int = 2000
    tol: float = 1e-4
    class_weight: str | Mapping[str, float] | None = None
    #: a logistic model weighs the loss by class twice: as a class-weighted estimator and by
    #: class-based sample weights
    double_class_weight: bool = True
    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 1.0
    colsample: float = 1.0
    min_child_weight: float = 1.0

    def __post_init__(self) -> None:
        _choice(self, "type", "logistic_regression", "boosted_trees")
        _ranges(
            self,
            random_seed=(0, None, False),
            logistic_c=(0, None, True),
            max_iter=(100, 100_000, False),
            tol=(0, 1.0, True),
            n_estimators=(1, 50_000, False),
            max_depth=(1, 30, False),
            learning_rate=(0, 1.0, True),
            subsample=(0, 1.0, True),
            colsample=(0, 1.0, True),
            min_child_weight=(0, None, False),
        )
        cw = self.class_weight
        _check(
            cw is None or cw == "balanced" or isinstance(cw, Mapping),
            "class_weight must be None, 'balanced' or a mapping of class to weight",
        )


@dataclass(frozen=True)
class FeatureConfig:
    log_entry_close: bool = True
    label_geometry: bool = True
    intraday_range_pct: bool = True
    log1p_volume: bool = True
    returns_multi_horizon: bool = False
    returns_horizons_bars: tuple[int, ...] = (5, 15, 30, 60)
    realized_vol_multi: bool = False
    realized_vol_windows_bars: tuple[int, ...] = (30, 120)
    realized_vol_include_ratio: bool = True
    range_vol_multi: bool = False
    range_vol_window_bars: int = 30
    range_vol_include_atr_norm: bool = True
    session_time: bool = False
    session_day_of_week: bool = False
    volume_context: bool = False
    volume_median_window_bars: int = 60
    vwap_distance: bool = False
    bar_microstructure: bool = False
    market_context: bool = False
    market_spy_return_bars: int = 15
    technical_indicators: bool = False
    ema_windows_bars: tuple[int, ...] = (9, 21, 50)
    rsi_window_bars: int = 14
    macd_fast_bars: int = 12
    macd_slow_bars: int = 26
    macd_signal_bars: int = 9
    order_flow_proxies: bool = False
    roll_window_bars: int = 20
    amihud_window_bars: int = 20

    def __post_init__(self) -> None:
        least = {"returns_horizons_bars": 1, "realized_vol_windows_bars": 2, "ema_windows_bars": 2}
        for name, lo in least.items():
            v = tuple(sorted(set(getattr(self, name))))
            _check(bool(v), f"features.{name} must not be empty")
            _check(v[0] >= lo, f"features.{name}: each value must be >= {lo}")
            object.__setattr__(self, name, v)
        _ranges(
            self,
            range_vol_window_bars=(2, None, False),
            volume_median_window_bars=(2, None, False),
            market_spy_return_bars=(1, None, False),
            rsi_window_bars=(2, None, False),
            macd_fast_bars=(2, None, False),
            macd_slow_bars=(3, None, False),
            macd_signal_bars=(2, None, False),
            roll_window_bars=(2, None, False),
            amihud_window_bars=(2, None, False),
        )
        _check(self.macd_fast_bars < self.macd_slow_bars, "features.macd_fast_bars must be < macd_slow_bars")
        _check(bool(self.enabled()), "features: enable at least one feature group")

    def enabled(self) -> list[str]:
        return [g for g in FEATURE_GROUPS if getattr(self, g)]


#: Feature groups in output column order (fixed values).
FEATURE_GROUPS = (
    "log_entry_close",
    "label_geometry",
    "intraday_range_pct",
    "log1p_volume",
    "returns_multi_horizon",
    "realized_vol_multi",
    "range_vol_multi",
    "session_time",
    "session_day_of_week",
    "volume_context",
    "vwap_distance",
    "bar_microstructure",
    "market_context",
    "technical_indicators",
    "order_flow_proxies",
)


@dataclass(frozen=True)
class ContextSymbol:
    symbol: str
    interval: str = "1min"

    def __post_init__(self) -> None:
        _check(bool(self.symbol), "context symbol must not be empty")
        _choice(self, "interval", "1min", "1day")
        validate_proxy_symbol(self.symbol)


def validate_proxy_symbol(symbol: str) -> str:
    """A spot volatility index has no bars of its own; a listed proxy must be named instead."""
    plain = symbol.strip().upper().removeprefix("^")
    _check(plain not in SPOT_INDEX_NAMES, f"{symbol!r} has no bars; name a listed volatility proxy")
    return symbol.strip().upper()


@dataclass(frozen=True)
class TrainConfig:
    min_train_rows: int = 1
    min_val_rows: int = 1
    drop_val_unseen_classes: bool = True
    experiment_name: str | None = None
    notes: str | None = None
    export_predictions: str = "val"
    entry_threshold_take_profit: float | None = None
    meta_label_primary_threshold: float | None = None
    meta_label_act_threshold: float = 0.5
    sample_weight_method: str = "none"

    def __post_init__(self) -> None:
        _choice(self, "export_predictions", "none", "val", "all")
        _choice(self, "sample_weight_method", "none", "uniqueness")
        _ranges(
            self,
            min_train_rows=(1, None, False),
            min_val_rows=(1, None, False),
            entry_threshold_take_profit=(0, 1.0, True),
            meta_label_primary_threshold=(0, 1.0, True),
            meta_label_act_threshold=(0, 1.0, True),
        )


@dataclass(frozen=True)
class LiveConfig:
    enabled: bool = False
    poll_interval_seconds: float = 120.0
    refresh_lookback_calendar_days: int = 2
    merge_strategy: str = "separate_recent"
    include_extended_hours: bool = False
    session_start_local: str | None = None
    session_end_local: str | None = None

    def __post_init__(self) -> None:
        _choice(self, "merge_strategy", "separate_recent", "merge_into_main")
        _ranges(
            self,
            poll_interval_seconds=(60.0, 86_400.0, False),
            refresh_lookback_calendar_days=(1, 31, False),
        )
        for name in ("session_start_local", "session_end_local"):
            if getattr(self, name) == "":
                object.__setattr__(self, name, None)
        a, b = self.session_start_local, self.session_end_local
        _check((a is None) == (b is None), "set both session limits or neither")
        for v in (a, b):
            _check(v is None or CLOCK.fullmatch(v) is not None, f"session limit {v!r} is not HH:MM")
        # Zero-padded HH:MM sorts like the time it names.
        _check(a is None or a < b, "session end must be after its start on the same day")


@dataclass(frozen=True)
class ExperimentConfig:
    symbol: str | None = None
    exchange_timezone: str = "America/New_York"
    data_start: date | None = None
    data_end: date | None = None
    profit_barrier_base: float = 0.15
    stop_loss_base: float = 0.05
    min_profit_per_trade_pct: float = 0.02
    vol_lookback_trading_days: int = 20
    vertical_max_trading_days: int = 10
    vol_ref_method: str = "median"
    barrier_vol_scale_min: float = 0.25
    barrier_vol_scale_max: float = 4.0
    label_entry_stride: int = 390
    max_day_trades: int = 10
    rolling_business_days: int = 5
    ingest_chunk_calendar_days: int = 10
    train_start: date | None = None
    train_end: date | None = None
    val_start: date | None = None
    val_end: date | None = None
    context_symbols: tuple[ContextSymbol, ...] = ()
    model: ModelConfig = field(default_factory=ModelConfig)
    scaler: str = "none"
    train: TrainConfig = field(default_factory=TrainConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    live: LiveConfig = field(default_factory=LiveConfig)

    def __post_init__(self) -> None:
        _choice(self, "vol_ref_method", "median", "mean")
        _choice(self, "scaler", "none", "standard", "robust")
        _ranges(
            self,
            profit_barrier_base=(0, 1.0, True),
            stop_loss_base=(0, 1.0, True),
            min_profit_per_trade_pct=(0, 1.0, False),
            vol_lookback_trading_days=(2, None, False),
            vertical_max_trading_days=(1, None, False),
            barrier_vol_scale_min=(0, 1.0, True),
            barrier_vol_scale_max=(1.0, 20.0, False),
            label_entry_stride=(1, None, False),
            max_day_trades=(1, 100, False),
            rolling_business_days=(1, None, False),
            ingest_chunk_calendar_days=(1, 31, False),
        )
        for a, b in (("data_start", "data_end"), ("train_start", "train_end"), ("val_start", "val_end")):
            lo, hi = getattr(self, a), getattr(self, b)
            _check(lo is None or hi is None or hi >= lo, f"{b} must be on or after {a}")

    @property
    def volatility_proxy(self) -> ContextSymbol | None:
        """The first daily context symbol that is not the index series."""
        return next((c for c in self.context_symbols if c.interval == "1day" and c.symbol.upper() != "SPY"), None)

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> ExperimentConfig:
        return _build(cls, raw, "")

    def with_overrides(self, overrides: Mapping[str, Any]) -> ExperimentConfig:
        """A copy with dotted-path settings replaced, e.g. `{"model.max_depth": 4}`."""
        cfg: Any = self
        for path, value in overrides.items():
            cfg = _replace(cfg, path.split("."), value, path)
        return cfg


_PARTS: dict[str, type] = {
    "model": ModelConfig,
    "train": TrainConfig,
    "features": FeatureConfig,
    "live": LiveConfig,
}


def _build(cls: type, raw: Mapping[str, Any], where: str) -> Any:
    known = {f.name for f in dataclasses.fields(cls)}
    extra = sorted(set(raw) - known)
    _check(not extra, f"unknown settings: {[where + k for k in extra]}")
    values: dict[str, Any] = {}
    for k, v in raw.items():
        if cls is ExperimentConfig and k in _PARTS and isinstance(v, Mapping):
            v = _build(_PARTS[k], v, f"{k}.")
        elif k == "context_symbols":
            v = tuple(_build(ContextSymbol, c, f"{k}.") if isinstance(c, Mapping) else c for c in v)
        elif isinstance(v, list):
            v = tuple(v)
        elif isinstance(v, str) and k.endswith(("_start", "_end")):
            v = date.fromisoformat(v)
        values[k] = v
    return cls(**values)


def _replace(obj: Any, path: list[str], value: Any, full: str) -> Any:
    names = {f.name for f in dataclasses.fields(obj)}
    _check(path[0] in names, f"unknown setting {full!r}")
    if len(path) == 1:
        return dataclasses.replace(obj, **{path[0]: tuple(value) if isinstance(value, list) else value})
    inner = getattr(obj, path[0])
    _check(dataclasses.is_dataclass(inner), f"{path[0]!r} in {full!r} has no settings below it")
    return dataclasses.replace(obj, **{path[0]: _replace(inner, path[1:], value, full)})
