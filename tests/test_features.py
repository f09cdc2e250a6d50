from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.config import FEATURE_GROUPS, ExperimentConfig, FeatureConfig
from barwright.operators import scan
from barwright.operators.features import feature_columns, feature_matrix, feature_table, matrix, split_by_session
from barwright.operators.positions import with_positions
from barwright.operators.volatility import daily_last_close
from tests.helpers import bars_of, frame, session_times, walk

OFF = {g: False for g in FEATURE_GROUPS}


def only(*groups, **settings) -> FeatureConfig:
    return FeatureConfig(**{**OFF, **{g: True for g in groups}}, **settings)


def table(spark, pdf, fc):
    return feature_table(bars_of(spark, pdf), fc).orderBy("symbol", "pos").toPandas()


def all_labels(spark, pdf):
    lab = pdf[["symbol", "ts", "close"]].rename(columns={"ts": "entry_time", "close": "entry_close"})
    lab = lab.assign(entry_time=lab["entry_time"].dt.tz_localize(None), barrier_outcome="vertical", bars_forward=1)
    for c in ("sigma_ann_at_entry", "vol_scale_ratio", "tp_move_effective", "sl_move"):
        lab[c] = 0.1
    return spark.createDataFrame(lab)


def test_long_frames_match_pandas(spark, monkeypatch):
    """Windows above the sliding limit, with chunks shorter than the series."""
    monkeypatch.setattr(matrix, "CHUNK_ROWS", 300)
    pdf = walk(10, 150, 3)
    fc = only(
        "realized_vol_multi", "range_vol_multi", "volume_context", "order_flow_proxies", "returns_multi_horizon",
        realized_vol_windows_bars=(30, 120), range_vol_window_bars=60, volume_median_window_bars=60,
        roll_window_bars=50, amihud_window_bars=40,
    )
    got = table(spark, pdf, fc)
    c, h, l, v = (pdf[k] for k in ("close", "high", "low", "volume"))
    r = np.log(c / c.shift(1))
    tr = pd.concat([h - l, (h - c.shift(1)).abs(), (l - c.shift(1)).abs()], axis=1).max(axis=1)
    prod = (r * r.shift(1)).rolling(50).mean() - r.rolling(50).mean() * r.shift(1).rolling(50).mean()
    sq = np.log(h / l) ** 2
    beta = sq.rolling(2).sum().rolling(50).mean()
    gamma = np.log(h.rolling(2).max() / l.rolling(2).min()) ** 2
    k = 3 - 2 * math.sqrt(2)
    alpha = ((np.sqrt(2 * beta) - np.sqrt(beta)) / k - np.sqrt(gamma / k)).clip(lower=0)
    want = {
        "rv_30m": r.rolling(30).std(),
        "rv_120m": r.rolling(120).std(),
        "rv_ratio_30_120m": r.rolling(30).std() / r.rolling(120).std(),
        "parkinson_60m": np.sqrt((np.log(h / l) ** 2 / (4 * math.log(2))).rolling(60).mean()),
        "atr_norm_60m": tr.rolling(60).mean() / c,
        "rel_volume": v / v.rolling(60).median(),
        "corwin_schultz_spread": 2 * (np.exp(alpha) - 1) / (1 + np.exp(alpha)),
        "roll_implied_spread": 2 * np.sqrt((-prod).clip(lower=0)),
        "amihud_illiq": (r.abs() / (c * v)).rolling(40).mean(),
        "ret_60m": np.log(c / c.shift(60)),
    }
    for name, w in want.items():
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), w.to_numpy(), rtol=1e-8, atol=1e-12, err_msg=name)


def test_five_bar_return(spark):
    pdf = frame(session_times(1, 120), 100 + 0.01 * np.arange(120))
    got = table(spark, pdf, only("returns_multi_horizon", returns_horizons_bars=(5,)))
    assert math.isclose(got["ret_5m"][60], math.log(pdf["close"][60] / pdf["close"][55]))


def pandas_averages(c: pd.Series) -> dict[str, pd.Series]:
    ema = {n: c.ewm(span=n, adjust=False, min_periods=n).mean() for n in (9, 12, 21, 26, 50)}
    move = c.diff()
    up, down = (m.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for m in (move, -move))
    line = ema[12] - ema[26]
    signal = line.ewm(span=9, adjust=False, min_periods=9).mean()
    want = {f"ema_dist_{n}m": (c - ema[n]) / ema[n] for n in (9, 21, 50)}
    return want | {"rsi_14m": 1 - 1 / (1 + up / down.clip(lower=1e-12)), "macd_line": line, "macd_signal": signal, "macd_hist": line - signal}


@pytest.mark.parametrize("rows", [4096, 16])
def test_averages_match_pandas(spark, monkeypatch, rows):
    """The smaller number makes many blocks, so states travel far."""
    monkeypatch.setattr(matrix, "CHUNK_ROWS", rows)
    pdf = pd.concat([walk(4, 100, 1, "AAA"), walk(2, 100, 2, "BBB"), walk(1, 1, 3, "CCC")])
    got = table(spark, pdf, only("technical_indicators"))
    for sym, g in pdf.groupby("symbol"):
        mine = got[got["symbol"] == sym].reset_index(drop=True)
        for name, w in pandas_averages(g["close"].reset_index(drop=True)).items():
            np.testing.assert_allclose(mine[name].to_numpy(dtype=float), w.to_numpy(), rtol=1e-9, atol=1e-11, err_msg=f"{sym} {name}")


def test_averages_over_missing_closes_match_pandas(spark, monkeypatch):
    """Single gaps, gaps longer than a block, a missing first close, no close at all, and a bad print long ago."""
    monkeypatch.setattr(matrix, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(5)
    frames = [walk(3, 150, k, name) for k, name in enumerate(("AAA", "BBB", "CCC", "DDD"))]
    frames[0].loc[rng.choice(450, 120, replace=False), "close"] = np.nan
    frames[0].loc[0, "close"] = 1e9
    frames[1].loc[:70, "close"] = np.nan
    frames[1].loc[200:290, "close"] = np.nan
    frames[2]["close"] = np.nan
    frames[3].loc[1:448, "close"] = np.nan
    got = table(spark, pd.concat(frames), only("technical_indicators"))
    for g in frames:
        sym = g["symbol"].iloc[0]
        mine = got[got["symbol"] == sym].reset_index(drop=True)
        for name, w in pandas_averages(g["close"].reset_index(drop=True)).items():
            np.testing.assert_allclose(mine[name].to_numpy(dtype=float), w.to_numpy(), rtol=1e-8, atol=1e-10, err_msg=f"{sym} {name}")


def test_averages_of_any_column(spark):
    pdf = walk(3, 100, 9)
    pdf.loc[[0, 3, 4, 250], "volume"] = np.nan
    d = with_positions(bars_of(spark, pdf).withColumn("volume", F.nanvl("volume", F.lit(None))))
    wanted = [scan.Average("e", "close", scan.span_alpha(2), 2), scan.Average("v", "volume", 0.01, 3), scan.Average("one", "close", 1.0, 1)]
    got = scan.with_averages(d, wanted, size=32).orderBy("pos").toPandas()
    for name, x, alpha, least in (("e", "close", 2 / 3, 2), ("v", "volume", 0.01, 3), ("one", "close", 1.0, 1)):
        want = pdf[x].ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-12, err_msg=name)


def test_maps_of_runs_give_the_state_after_them():
    """However a series is cut, its runs' maps applied in order end in the average of the whole."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=60)
    x[rng.choice(60, 25, replace=False)] = np.nan
    x[40:50] = np.nan
    want = pd.Series(x).ewm(alpha=0.3, adjust=False).mean()
    for cuts in ([0, 60], [0, 7, 8, 20, 40, 50, 60], list(range(61))):
        now = np.zeros((3, 1))
        for a, b in zip(cuts, cuts[1:]):
            got = scan.run_values(x[a:b], a, scan.Average("e", "x", 0.3, 1), now[:, 0])
            np.testing.assert_allclose(got, want[a:b], rtol=1e-12)
            now = scan.advanced(now, np.array([scan.run_map(x[a:b], a, 0.3)]).T, np.array([0.3]))
        np.testing.assert_allclose(now[2], want.iloc[-1], rtol=1e-12)


@pytest.mark.parametrize("w", [2, 10, 33, 120])
def test_a_bad_print_before_the_frame_changes_nothing(spark, monkeypatch, w):
    """One rule for all lengths: quiet prices after a print of 1e6 give their own small deviation."""
    monkeypatch.setattr(matrix, "CHUNK_ROWS", 256)
    pdf = walk(2, 390, 4, scale=1e-8)
    pdf.loc[5, ["open", "high", "low", "close"]] = 1e6
    fc = only("realized_vol_multi", "range_vol_multi", "order_flow_proxies", realized_vol_windows_bars=(w, 2 * w),
              range_vol_window_bars=w, roll_window_bars=max(w, 2), amihud_window_bars=w)
    got = table(spark, pdf, fc)
    r = np.log(pdf["close"] / pdf["close"].shift(1))
    clean = r[7:].rolling(w).std()
    mine = got[f"rv_{w}m"].to_numpy(dtype=float)
    np.testing.assert_allclose(mine[7 + w :], clean.to_numpy()[w:], rtol=1e-6)
    park = (np.log(pdf["high"] / pdf["low"]) ** 2 / (4 * math.log(2)))
    np.testing.assert_allclose(got[f"parkinson_{w}m"].to_numpy(dtype=float)[6 + w :], np.sqrt(park[6:].rolling(w).mean()).to_numpy()[w:], rtol=1e-6)


def test_frames_with_missing_values_are_null(spark, monkeypatch):
    monkeypatch.setattr(matrix, "CHUNK_ROWS", 64)
    pdf = walk(1, 300, 8)
    pdf.loc[[40, 41, 130], "close"] = np.nan
    got = table(spark, pdf, only("realized_vol_multi", realized_vol_windows_bars=(7, 50)))
    r = np.log(pdf["close"] / pdf["close"].shift(1))
    for w in (7, 50):
        np.testing.assert_allclose(got[f"rv_{w}m"].to_numpy(dtype=float), r.rolling(w).std().to_numpy(), rtol=1e-9)


def test_session_clock(spark):
    got = table(spark, frame(session_times(1, 120), np.full(120, 10.0)), only("session_time"))
    assert (got["minutes_since_open"][0], got["minutes_to_close"][0]) == (0.0, 119.0)
    assert got["minutes_since_open"][60] == 60.0
    assert math.isclose(got["sin_time"][60], math.sin(2 * math.pi * 60 / 119))


def test_vwap_restarts_each_session_and_spans_hours(spark):
    pdf = walk(2, 150, 7)
    got = table(spark, pdf, only("vwap_distance"))
    pv = (pdf["high"] + pdf["low"] + pdf["close"]) / 3 * pdf["volume"]
    day = pdf["ts"].dt.date
    vwap = pv.groupby(day).cumsum() / pdf["volume"].groupby(day).cumsum()
    np.testing.assert_allclose(got["vwap_session_dist_pct"], (pdf["close"] - vwap) / vwap, rtol=1e-9)


def test_wicks_and_zero_volume(spark):
    n = 40
    pdf = frame(session_times(1, n), np.full(n, 100.8), open_=np.full(n, 100.0), high=np.full(n, 101.0), low=np.full(n, 99.0))
    pdf.loc[n - 1, "volume"] = 0.0
    got = table(spark, pdf, only("order_flow_proxies", roll_window_bars=5, amihud_window_bars=5)).iloc[-1]
    assert math.isclose(got["upper_wick_pct"], 0.1) and math.isclose(got["lower_wick_pct"], 0.5)
    assert np.isnan(got["amihud_illiq"])


def test_weekend_entry_is_an_error(spark):
    saturday = session_times(1, 3)[0].replace(day=13)
    pdf = frame([saturday], [1.0])
    with pytest.raises(Exception, match="weekend"):
        feature_table(bars_of(spark, pdf), only("session_day_of_week")).collect()


def test_warm_up_leaves_complete_entries(spark):
    pdf = walk(1, 130, 2)
    cfg = ExperimentConfig(exchange_timezone="UTC", features=only("realized_vol_multi", realized_vol_windows_bars=(30, 120)))
    m = feature_matrix(all_labels(spark, pdf), bars_of(spark, pdf), cfg)
    assert m.count() == 10


def test_roll_spread_needs_one_more_bar_than_the_warm_up(spark):
    pdf = walk(1, 30, 2)
    cfg = ExperimentConfig(exchange_timezone="UTC", features=only("order_flow_proxies", roll_window_bars=20, amihud_window_bars=20))
    m = feature_matrix(all_labels(spark, pdf), bars_of(spark, pdf), cfg)
    assert m.agg(F.min("entry_pos")).first()[0] == 21


def test_unmatched_labels_are_dropped(spark):
    pdf = walk(1, 2, 2)
    labels = all_labels(spark, pdf)
    m = feature_matrix(labels, bars_of(spark, pdf.iloc[:1]), ExperimentConfig(exchange_timezone="UTC"))
    assert m.count() == 1
    assert feature_columns(FeatureConfig()) == [
        "log_entry_close", "sigma_ann_at_entry", "vol_scale_ratio", "tp_move_effective", "sl_move", "intraday_range_pct", "log1p_volume",
    ]


def test_missing_columns_are_named(spark):
    pdf = walk(1, 5, 2)
    with pytest.raises(KeyError, match="sl_move"):
        feature_matrix(all_labels(spark, pdf).drop("sl_move"), bars_of(spark, pdf), ExperimentConfig())


def test_market_context(spark):
    pdf, idx = walk(4, 20, 1), walk(4, 20, 2, "SPY")
    idx = idx.drop(idx.index[45])  # one time missing from the index
    cfg = ExperimentConfig(exchange_timezone="UTC", features=only("market_context", market_spy_return_bars=3))
    proxy = daily_last_close(bars_of(spark, walk(4, 20, 3, "VXX")))
    m = feature_matrix(all_labels(spark, pdf), bars_of(spark, pdf), cfg, index_bars=bars_of(spark, idx), proxy_daily=proxy)
    got = m.orderBy("entry_time").toPandas()
    want = np.log(idx["close"] / idx["close"].shift(3)).to_numpy()
    assert len(got) == 39  # two sessions have a proxy change, one time has no index bar
    assert math.isclose(got["spy_ret_3m"].iloc[0], want[40])


def test_split_by_session(spark):
    from datetime import date

    pdf = walk(4, 5, 1)
    cfg = ExperimentConfig(
        exchange_timezone="UTC", train_start=date(2024, 1, 8), train_end=date(2024, 1, 9),
        val_start=date(2024, 1, 10), val_end=date(2024, 1, 10),
    )
    m = feature_matrix(all_labels(spark, pdf), bars_of(spark, pdf), cfg)
    counts = {r["split"]: r["count"] for r in split_by_session(m, cfg).groupBy("split").count().collect()}
    assert counts == {"train": 10, "val": 5}
    with pytest.raises(ValueError):
        split_by_session(m, replace(cfg, val_end=None))
