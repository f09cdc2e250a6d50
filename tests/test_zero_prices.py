"""Prices of zero: infinities and NaN are values, not gaps."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.config import ExperimentConfig
from barwright.functions.expr import ln_ratio
from barwright.operators import volatility as V
from barwright.operators.features import feature_matrix
from barwright.operators.features.market import proxy_change
from barwright.operators.labels import label_issues
from barwright.plans import catalog
from barwright.plans.stages import FiniteVector
from checks.compare import connect, differences
from checks.oracle_sql import ORACLES
from tests.helpers import bars_of, frame, session_times, walk
from tests.test_features import all_labels, only, table

TABLES = "/root/testdata/sf0.01"


def zeroed(at: int, n: int = 60) -> pd.DataFrame:
    pdf = walk(1, n, 5)
    pdf.loc[at, ["open", "high", "low", "close"]] = 0.0
    return pdf


def same(got, want) -> None:
    np.testing.assert_allclose(np.asarray(got, dtype=float), np.asarray(want, dtype=float), rtol=1e-9)


def test_log_ratio_as_floating_point(spark):
    d = spark.createDataFrame([(0.0, 2.0), (2.0, 0.0), (0.0, 0.0), (-1.0, 2.0), (None, 2.0), (2.0, None), (2.0, 1.0)], "a double, b double")
    got = [r[0] for r in d.select(ln_ratio("a", "b")).collect()]
    assert got[4] is None and got[5] is None and None not in got[:4]
    same(got[:4] + got[6:], [-np.inf, np.inf, np.nan, np.nan, np.log(2.0)])


def test_returns_to_and_from_zero_are_infinite(spark):
    got = table(spark, zeroed(30), only("returns_multi_horizon", returns_horizons_bars=(5,)))["ret_5m"]
    assert got[30] == -np.inf and got[35] == np.inf and np.isfinite(got[31:35]).all()


def test_order_flow_over_a_zero_price(spark):
    pdf = zeroed(30)
    got = table(spark, pdf, only("order_flow_proxies", roll_window_bars=10, amihud_window_bars=10))
    assert np.isposinf(got["amihud_illiq"][40]) and np.isfinite(got["amihud_illiq"][41])
    assert got["roll_implied_spread"][[30, 35, 41]].isna().all() and np.isfinite(got["roll_implied_spread"][42])
    d = feature_matrix(all_labels(spark, pdf), bars_of(spark, pdf), ExperimentConfig(exchange_timezone="UTC", features=only("order_flow_proxies", roll_window_bars=10, amihud_window_bars=10)))
    assert d.where("entry_pos = 40").count() == 1  # infinite, not missing


def test_long_frames_over_a_zero_price(spark):
    got = table(spark, zeroed(25), only("realized_vol_multi", "range_vol_multi", realized_vol_windows_bars=(10, 30), range_vol_window_bars=30))
    assert np.isposinf(got["parkinson_30m"][29:55]).all() and np.isfinite(got["parkinson_30m"][55:]).all()


def test_market_columns_over_a_zero_price(spark):
    proxy = spark.createDataFrame([("V", f"2024-01-0{i}", x) for i, x in enumerate([1.0, 0.0, 3.0, 4.0], 1)], "symbol string, session_date string, close double")
    got = {r[0]: r[1] for r in proxy_change(proxy).collect()}
    assert got["2024-01-03"] == -1.0 and got["2024-01-04"] == np.inf


def test_sessions_that_close_at_zero_have_a_return(spark):
    pdf = frame(session_times(6, 3), np.repeat([10.0, 11.0, 0.0, 12.0, 13.0, 12.0], 3))
    d = V.daily_volatility(bars_of(spark, pdf), 2).orderBy("session_date").collect()
    same([r["log_ret"] for r in d[2:4]], [-np.inf, np.inf])
    assert d[3]["vol_2d_ann"] is not None and np.isnan(d[3]["vol_2d_ann"])
    only_zero = frame(session_times(5, 3), np.repeat([10.0, 0.0, 12.0, 11.0, 12.0], 3))
    assert label_issues(bars_of(spark, only_zero), ExperimentConfig(exchange_timezone="UTC", vol_lookback_trading_days=3)).count() == 0


def test_complete_rows_may_be_infinite(spark):
    pdf = zeroed(30)
    cfg = ExperimentConfig(exchange_timezone="UTC", features=only("returns_multi_horizon", returns_horizons_bars=(5,)))
    m = feature_matrix(all_labels(spark, pdf), bars_of(spark, pdf), cfg)
    assert m.count() == 55 and m.where(F.abs("ret_5m") == float("inf")).count() == 2


def test_vectors_are_finite(spark):
    train = spark.createDataFrame([(1.0, np.inf), (5.0, 2.0), (9.0, np.nan)], "a double, b double")
    stage = FiniteVector.of(train, ["a", "b"], "v")
    rows = spark.createDataFrame([(np.inf, -np.inf), (-np.inf, np.nan), (np.nan, np.inf), (20.0, -3.0)], "a double, b double")
    d = stage.transform(rows)
    assert d.columns == ["a", "b", "v"]
    assert [list(r["v"]) for r in d.collect()] == [[9.0, 2.0], [1.0, 2.0], [5.0, 2.0], [20.0, -3.0]]
    with pytest.raises(Exception, match="(?i)null"):
        stage.transform(spark.createDataFrame([(None, 1.0)], "a double, b double")).collect()


@pytest.fixture(scope="module")
def with_zeros(spark, tmp_path_factory):
    """The small tables with prices of zero, the last one of a user's session among them."""
    path = str(tmp_path_factory.mktemp("zeros"))
    duckdb.sql(
        f"COPY (SELECT * REPLACE (CASE WHEN event_id % 1999 = 7 THEN 0.0 ELSE value END AS value) FROM '{TABLES}/events.parquet') TO '{path}/events.parquet'"
    )
    return path


@pytest.mark.parametrize("name", [
    "feat_order_flow_proxies", "feat_returns_multi_horizon", "feature_matrix", "grid_dry_run", "grid_train", "label_issues", "meta_label",
    "split_balance", "stream_scores", "train_boosted", "train_logistic", "feat_market_context", "daily_vol",
])
def test_queries_agree_with_their_sql(spark, with_zeros, name):
    got, _, _ = differences(spark, connect(with_zeros), with_zeros, catalog.QUERIES[name], ORACLES[name])
    assert got.startswith("ok"), got
