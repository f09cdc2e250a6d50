from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from barwright.functions.calendar import session_date, wall_time_to_instant
from barwright.operators import volatility as V
from tests.helpers import bars_of, frame, session_times, walk


def test_last_close_of_a_session(spark):
    d = V.daily_last_close(bars_of(spark, frame(session_times(1, 5), [10, 11, 12, 13, 99]))).collect()
    assert [r["close"] for r in d] == [99.0]


def test_last_close_skips_missing_closes(spark):
    d = V.daily_last_close(bars_of(spark, frame(session_times(1, 3), [10, 11, np.nan])).withColumn("close", F.nanvl("close", F.lit(None))))
    assert d.first()["close"] == 11.0


def test_no_session_sees_its_own_close(spark):
    close = np.repeat(100 + np.arange(22) % 2, 3).astype(float)
    pdf = frame(session_times(22, 3), close)
    a = V.add_volatility(bars_of(spark, pdf), 20)
    spiked = pdf.copy()
    spiked.loc[len(pdf) - 1, "close"] = 1000.0
    b = V.add_volatility(bars_of(spark, spiked), 20)
    va = [r["vol_20d_ann"] for r in a.orderBy("ts").collect()]
    vb = [r["vol_20d_ann"] for r in b.orderBy("ts").collect()]
    assert va == vb
    assert sum(v is not None for v in va) == 3  # only the last session's bars


def test_matches_pandas(spark):
    pdf = walk(15, 12, 4)
    daily = pdf.groupby(pdf["ts"].dt.date)["close"].last()
    want = np.log(daily / daily.shift(1)).rolling(5).std().shift(1)
    got = V.daily_volatility(bars_of(spark, pdf), 5).orderBy("session_date").toPandas()["sigma_daily_5d"]
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), rtol=1e-12)


def test_reference_is_over_bars_not_sessions(spark):
    pdf = walk(9, 10, 8)
    pdf = pdf.drop(pdf.index[62:69])  # one session keeps few bars
    days = V.daily_volatility(bars_of(spark, pdf), 2)
    per_bar = V.add_volatility(bars_of(spark, pdf), 2).toPandas()["vol_2d_ann"].astype(float)
    for method, want in (("median", per_bar.median()), ("mean", per_bar.mean())):
        assert np.isclose(V.sigma_reference(days, "vol_2d_ann", method).first()["sigma_ref"], want)
    s = V.volatility_summary(days, "vol_2d_ann").first()
    assert s["count"] == per_bar.count() and np.isclose(s["std"], per_bar.std())
    assert np.isclose(s["p25"], per_bar.quantile(0.25))


def test_wall_time_is_exchange_time(spark):
    d = spark.sql("select timestamp_ntz'2024-07-01 20:30:00' t, timestamp_ntz'2024-01-02 09:30:00' w")
    r = d.select(
        wall_time_to_instant("t", "America/New_York").cast("string").alias("summer"),
        wall_time_to_instant("w", "America/New_York").cast("string").alias("winter"),
        session_date(wall_time_to_instant("t", "America/New_York"), "America/New_York").cast("string").alias("day"),
    ).first()
    assert tuple(r) == ("2024-07-02 00:30:00", "2024-01-02 14:30:00", "2024-07-01")
