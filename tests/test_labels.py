from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.config import ExperimentConfig
from barwright.operators import labels as L
from barwright.operators.positions import slot_table, with_positions
from tests.helpers import bars_of, frame, session_times, walk

CFG = ExperimentConfig(
    exchange_timezone="UTC", vol_lookback_trading_days=2, profit_barrier_base=0.1, stop_loss_base=0.05,
    min_profit_per_trade_pct=0.02, label_entry_stride=1, vertical_max_trading_days=1,
)


def touch(spark, highs, lows, *, days=1, horizon=1):
    """Label bars whose closes are 100, with fixed 10 % / 5 % barriers."""
    n = len(highs)
    times = session_times(days, n // days)
    bars = bars_of(spark, frame(times, [100.0] * n, high=highs, low=lows))
    slots = slot_table(bars)
    per_day = n // days
    d = with_positions(bars, slots).withColumn("is_entry", F.col("pos") < F.col("n_bars") - 1)
    vertical = (F.col("day_rank") + horizon) * per_day
    d = d.withColumn("vertical_pos", F.when(vertical < n, vertical))

    def geometry(e):
        return e.withColumns(
            {"upper_barrier": F.lit(110.0), "lower_barrier": F.lit(95.0), "end_pos": F.coalesce("vertical_pos", "n_bars")}
        )

    out = L.first_touch(L.bar_blocks(d, "vertical_pos", "n_bars"), geometry)
    return {r["entry_pos"]: (r["touch_pos"], r["touched_stop"], r["vertical_pos"]) for r in out.collect()}


def test_same_bar_counts_as_stop(spark):
    got = touch(spark, [100, 120, 100], [100, 94, 100])
    assert got[0][:2] == (1, True) and len(got) == 2


def test_take_profit_and_no_touch(spark):
    assert touch(spark, [100, 112, 100], [100, 99, 100])[0][:2] == (1, False)
    assert touch(spark, [100, 101, 100], [100, 99, 100])[0][0] is None


def test_vertical_is_tested_before_the_bar(spark):
    got = touch(spark, [100, 100, 200, 100], [100, 100, 50, 100], days=2)
    assert got[0] == (None, None, 2)


def brute(pdf: pd.DataFrame, cfg: ExperimentConfig) -> pd.DataFrame:
    out = []
    for sym, g in pdf.sort_values("ts").groupby("symbol"):
        day = g["ts"].dt.date.to_numpy()
        rank = pd.factorize(day)[0]
        daily = g.groupby(day)["close"].last()
        vol = np.log(daily / daily.shift(1)).rolling(cfg.vol_lookback_trading_days).std().shift(1) * np.sqrt(252)
        sig = pd.Series(day).map(vol).to_numpy()
        ref = np.nanmedian(sig) if cfg.vol_ref_method == "median" else np.nanmean(sig)
        hi, lo, c, n = g["high"].to_numpy(), g["low"].to_numpy(), g["close"].to_numpy(), len(g)
        for i in range(0, n - 1, cfg.label_entry_stride):
            if not np.isfinite(sig[i]):
                continue
            ratio = np.clip(sig[i] / ref, cfg.barrier_vol_scale_min, cfg.barrier_vol_scale_max)
            up = c[i] * (1 + max(cfg.min_profit_per_trade_pct, cfg.profit_barrier_base * ratio))
            dn = c[i] * (1 - cfg.stop_loss_base * ratio)
            result = ("end_of_data", n - 1 - i)
            for j in range(i + 1, n):
                if rank[j] - rank[i] >= cfg.vertical_max_trading_days:
                    result = ("vertical", j - i)
                elif lo[j] <= dn:
                    result = ("stop_loss", j - i)
                elif hi[j] >= up:
                    result = ("take_profit", j - i)
                else:
                    continue
                break
            out.append((sym, i, *result))
    return pd.DataFrame(out, columns=["symbol", "entry_pos", "barrier_outcome", "bars_forward"])


@pytest.mark.parametrize(
    "changes",
    [
        {"vertical_max_trading_days": 1, "label_entry_stride": 3},
        {"vertical_max_trading_days": 4, "profit_barrier_base": 0.3, "stop_loss_base": 0.3, "label_entry_stride": 7},
        {"vertical_max_trading_days": 40, "profit_barrier_base": 0.2, "stop_loss_base": 0.15, "vol_ref_method": "mean", "label_entry_stride": 11},
    ],
)
def test_equals_the_bar_by_bar_search(spark, monkeypatch, changes):
    """Small blocks make entries cross many blocks and several supers."""
    monkeypatch.setattr(L, "BLOCK", 8)
    monkeypatch.setattr(L, "SUPER", 8)
    cfg = replace(CFG, **changes)
    pdf = pd.concat([walk(12, 70, 1, "AAA"), walk(9, 50, 2, "BBB", 0.008), walk(6, 90, 3, "CCC", 0.001)])
    got = L.label_bars(bars_of(spark, pdf), cfg).toPandas()
    want = brute(pdf, cfg)
    keys = ["symbol", "entry_pos"]
    got = got.sort_values(keys)[list(want.columns)].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want.sort_values(keys).reset_index(drop=True), check_dtype=False)
    assert want["barrier_outcome"].nunique() >= 3


def test_result_does_not_depend_on_partitions(spark):
    pdf = walk(8, 60, 5)
    a = L.label_bars(bars_of(spark, pdf).repartition(1), CFG).orderBy("entry_pos").collect()
    b = L.label_bars(bars_of(spark, pdf.sample(frac=1, random_state=1)).repartition(7), CFG).orderBy("entry_pos").collect()
    assert a == b


def test_another_symbol_changes_nothing(spark):
    pdf = walk(8, 60, 5)
    a = L.label_bars(bars_of(spark, pdf), CFG).orderBy("entry_pos").collect()
    both = pd.concat([pdf, walk(8, 60, 6, "ZZZ")])
    b = L.label_bars(bars_of(spark, both), CFG).where("symbol = 'AAA'").orderBy("entry_pos").collect()
    assert a == b


def test_label_issues_lists_short_series(spark):
    pdf = pd.concat([walk(8, 20, 1), frame(session_times(1, 2), [1, 2], symbol="TWO"), frame(session_times(1, 9), range(9), symbol="DAY")])
    got = {r["symbol"]: r["issue"] for r in L.label_issues(bars_of(spark, pdf), CFG).collect()}
    assert got == {"TWO": "fewer than 3 bars", "DAY": "no finite volatility"}
