"""Scores from carried state equal scores from the whole history."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.config import FEATURE_GROUPS, ExperimentConfig, FeatureConfig
from barwright.operators.features import feature_columns
from barwright.streaming import bars as ST
from barwright.streaming import scoring as L
from tests.helpers import bars_of, walk

OFF = {g: False for g in FEATURE_GROUPS}
WANTED = ("label_geometry", "returns_multi_horizon", "realized_vol_multi", "technical_indicators", "vwap_distance", "session_time")
CFG = ExperimentConfig(
    exchange_timezone="UTC", vol_lookback_trading_days=2,
    features=FeatureConfig(**{**OFF, **{g: True for g in WANTED}}, returns_horizons_bars=(5,), realized_vol_windows_bars=(10, 30), ema_windows_bars=(9, 21)),
)


class Same:
    """A model that gives the features back."""

    @staticmethod
    def score(rows):
        return rows


@pytest.fixture(scope="module")
def history():
    a, b = walk(7, 40, 21), walk(7, 40, 22, "BBB").iloc[90:]
    a.loc[[30, 31, 110, 111, 112], "close"] = np.nan
    return pd.concat([a, b]).sort_values("ts", ignore_index=True)


def frame_of(df, fc):
    return df.select("symbol", "entry_time", *feature_columns(fc)).toPandas().sort_values(["symbol", "entry_time"], ignore_index=True)


def test_carried_state_equals_whole_history(spark, history, tmp_path):
    days = sorted(history["ts"].dt.date.unique())
    cuts = [history["ts"].dt.date <= days[3], history["ts"].dt.date == days[4], history["ts"] < pd.Timestamp(days[5], tz="UTC") + pd.Timedelta(hours=15)]
    taken = pd.Series(False, index=history.index)
    path, out, seen = str(tmp_path / "state"), str(tmp_path / "scores"), None
    for n, cut in enumerate([*cuts, pd.Series(True, index=history.index)]):
        now = history[cut & ~taken]
        taken |= cut
        new = bars_of(spark, now).select(*L.BARS)
        L.advance(spark, path, n, new, CFG, Same.score, out)
        got = frame_of(spark.read.parquet(f"{out}/batch={n:012d}"), CFG.features)
        want = frame_of(ST.score_new_bars(bars_of(spark, history[taken]).select(*L.BARS), new, CFG, Same), CFG.features)
        assert len(got) == len(want) and (len(got) > 20 or n == 0)
        pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-11)
        seen = got
    # the state holds a few sessions, not the history; a batch run again writes the same
    state = L.read_state(spark, path)
    assert state.slice.count() < len(history) / 2 and state.days.count() > 0
    new = bars_of(spark, history[~(cuts[0] | cuts[1] | cuts[2])]).select(*L.BARS)
    L.advance(spark, path, 3, new, CFG, Same.score, out)
    pd.testing.assert_frame_equal(frame_of(spark.read.parquet(f"{out}/batch={3:012d}"), CFG.features), seen)


def test_a_state_without_its_last_table_is_not_read(spark, history, tmp_path):
    path = str(tmp_path / "state")
    plain = replace(CFG, features=replace(CFG.features, technical_indicators=False))
    new = bars_of(spark, history[history["symbol"] == "AAA"].iloc[:80]).select(*L.BARS)
    L.advance(spark, path, 0, new, plain, Same.score, str(tmp_path / "out"))
    before = L.read_state(spark, path).slice.count()
    new.write.parquet(f"{path}/batch={1:012d}/slice")
    assert L.read_state(spark, path).slice.count() == before and L.read_state(spark, path).averages is None
    assert L.read_state(spark, path, before=0).slice is None


def test_scoring_attached_to_a_stream(spark, history, tmp_path):
    plain = replace(CFG, features=replace(CFG.features, technical_indicators=False))
    mine = history[history["symbol"] == "AAA"]
    for k, part in enumerate((mine.iloc[:200], mine.iloc[200:])):
        bars_of(spark, part).select(*L.BARS).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "bars")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bars"))
    q = L.start_scoring(stream, plain, Same.score, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "progress"), once=True)
    q.awaitTermination()
    scored = spark.read.parquet(str(tmp_path / "out"))
    assert scored.select("batch").distinct().count() == 2
    assert scored.agg(F.max("entry_time")).first()[0] == mine["ts"].max().tz_localize(None).to_pydatetime()
