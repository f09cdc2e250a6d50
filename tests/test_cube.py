"""Many signal sets in one pass against one set at a time."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.config import ExperimentConfig
from barwright.operators import backtest as B
from barwright.operators import cube

CFG = ExperimentConfig(exchange_timezone="UTC", max_day_trades=2, rolling_business_days=3)
GRID = [0.1, 0.3, 0.5, 0.9]


@pytest.fixture(scope="module")
def facts(spark):
    """Two symbols in one account and one alone, weekends, equal times, rows without a label or an exit."""
    rng, rows = np.random.default_rng(8), []
    start = datetime(2024, 3, 1, 15)
    for account, symbol, days in (("one", "AAA", 12), ("one", "BBB", 12), ("two", "CCC", 5), ("idle", "DDD", 1)):
        for d in range(days):
            for k in range(int(rng.integers(1, 6))):
                at = start + timedelta(days=d, minutes=10 * k)
                y = str(rng.choice(["take_profit", "stop_loss", "vertical", "end_of_data"]))
                labelled = bool(rng.random() > 0.1)
                missing = labelled and y in ("vertical", "end_of_data") and bool(rng.random() > 0.7)
                exit_date = None if missing or not labelled else (at + timedelta(days=int(y == "vertical"))).date()
                pnl = None if missing or not labelled else round(float(rng.normal(0, 0.05)), 4)
                p = 0.05 if symbol == "DDD" else float(rng.random())
                rows.append((account, symbol, at, at.date(), y, str(rng.choice(["take_profit", "vertical"])), p, float(rng.random()), labelled, missing, pnl, exit_date))
    schema = (
        "account string, symbol string, entry_time timestamp, session_date date, y_true string, y_pred string, proba_take_profit double, "
        "meta_proba double, has_label boolean, missing_exit boolean, pnl double, exit_session_date date"
    )
    return spark.createDataFrame(rows, schema).repartition(3).persist()


def alone(facts, signals, base, cap=True) -> pd.DataFrame:
    rows = B.trades(signals, CFG, base, enforce_day_trade_cap=cap)
    d = B.summarize(facts, signals, rows, base, base, expected=facts.select(*base).distinct())
    return d.toPandas().sort_values(base, ignore_index=True)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(got[want.columns.tolist()], want, check_dtype=False, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize(("base", "cap", "step"), [(["symbol"], True, 1 << 16), (["account"], True, 3), (["account"], False, 2)])
def test_thresholds_equal_one_at_a_time(facts, monkeypatch, base, cap, step):
    """Also with a session cut into pieces of a few rows."""
    monkeypatch.setattr(cube, "STEP", step)
    sweep = B.threshold_sweep(facts, CFG, thresholds=GRID, base=base, enforce_day_trade_cap=cap).toPandas()
    assert len(sweep) == len(GRID) * facts.select(*base).distinct().count()
    for t in GRID:
        got = sweep[sweep["threshold"] == t].sort_values(base, ignore_index=True)
        same(got, alone(facts, facts.where(F.col("proba_take_profit") >= t), base, cap))


def test_policies_equal_one_at_a_time(facts):
    d = B.compare_policies(facts, CFG, threshold=0.3, act=0.5, base=["account"]).toPandas()
    gate = F.col("proba_take_profit") >= 0.3
    for name, signals in ((B.POLICY_ARGMAX, F.col("y_pred") == "take_profit"), (B.POLICY_THRESHOLD, gate), (B.POLICY_META, gate & (F.col("meta_proba") >= 0.5))):
        same(d[d["policy"] == name].sort_values("account", ignore_index=True), alone(facts, facts.where(signals), ["account"]))


def test_more_thresholds_than_bits(facts):
    grid = [k / 100 for k in range(1, 81)]
    sweep = B.threshold_sweep(facts, CFG, thresholds=grid, base=["account"]).toPandas()
    assert sorted(sweep[sweep["account"] == "two"]["threshold"]) == grid
    got = sweep[sweep["threshold"] == 0.7].sort_values("account", ignore_index=True)
    same(got, alone(facts, facts.where("proba_take_profit >= 0.7"), ["account"]))
    with pytest.raises(ValueError):
        cube.summarize_sets(facts, F.lit(0), 63, CFG, ["account"])


def test_no_predictions(facts):
    assert B.threshold_sweep(facts.limit(0), CFG, thresholds=GRID).count() == 0
