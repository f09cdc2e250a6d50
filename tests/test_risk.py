from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import calendar as C
from barwright.operators import risk


def window(d: date, n: int) -> set[date]:
    while d.weekday() > 4:
        d -= timedelta(days=1)
    out = set()
    while len(out) < n:
        if d.weekday() < 5:
            out.add(d)
        d -= timedelta(days=1)
    return out


def walk(days, cap, n):
    taken, out = [], []
    for d in days:
        ok = sum(t in window(d, n) for t in taken) < cap
        if ok:
            taken.append(d)
        out.append(not ok)
    return out


def decide(spark, days, cap, n, by=None):
    rows = [("a", i, d) for i, d in enumerate(days)]
    d = spark.createDataFrame(rows, "k string, entry_time int, session_date date")
    out = risk.with_cap_decision(d, ["k"], cap, n, candidate=F.lit(True), order="entry_time")
    return [r["over_cap"] for r in out.orderBy("entry_time").collect()]


def test_weekday_window(spark):
    d = spark.createDataFrame([(date(2024, 1, 8),), (date(2024, 1, 7),)], "d date")
    got = d.select(C.trailing_weekdays("d", 5).alias("w"), C.anchor_weekday("d").alias("a")).collect()
    assert [x.day for x in got[0]["w"]] == [2, 3, 4, 5, 8]
    assert got[1]["a"] == date(2024, 1, 5) and [x.day for x in got[1]["w"]] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("periods", [1, 3, 5, 6, 11, 250])
def test_long_weekday_windows(spark, periods):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(9)]
    d = spark.createDataFrame([(x,) for x in days], "d date")
    for r in d.select("d", C.trailing_weekdays("d", periods).alias("w")).collect():
        assert set(r["w"]) == window(r["d"], periods)


def test_fourth_event_of_a_day_is_refused(spark):
    assert decide(spark, [date(2024, 1, 8)] * 4, 3, 5) == [False, False, False, True]


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_event_by_event_walk(spark, seed):
    rng = np.random.default_rng(seed)
    offsets = np.sort(rng.integers(0, 40, 60))
    days = [date(2024, 1, 1) + timedelta(days=int(o)) for o in offsets]  # weekends included
    cap, n = int(rng.integers(1, 6)), int(rng.integers(1, 8))
    assert decide(spark, days, cap, n) == walk(days, cap, n)


def test_non_candidates_are_never_limited(spark):
    d = spark.createDataFrame(
        [("a", i, date(2024, 1, 8), i % 2 == 0) for i in range(6)], "k string, entry_time int, session_date date, c boolean"
    )
    out = risk.with_cap_decision(d, ["k"], 1, 5, candidate=F.col("c"), order="entry_time").orderBy("entry_time")
    assert [r["over_cap"] for r in out.collect()] == [False, False, True, False, True, False]


def test_counts_in_window(spark):
    e = spark.createDataFrame([("a", date(2024, 1, d)) for d in (1, 2, 5, 6, 8)], "k string, session_date date")
    a = spark.createDataFrame([("a", date(2024, 1, 8)), ("a", date(2024, 2, 8))], "k string, as_of date")
    got = {r["as_of"].month: (r["n_in_window"], r["can_add"]) for r in risk.window_counts(e, a, ["k"], 3, 5).collect()}
    assert got == {1: (3, False), 2: (0, True)}  # the Saturday event is in no window


def test_history_text(spark):
    d = spark.createDataFrame([("2024-01-02, 2024-01-03,",)], "h string")
    assert d.select(risk.history_dates(F.col("h")).alias("d")).first()["d"] == [date(2024, 1, 2), date(2024, 1, 3)]


def test_business_day_index(spark):
    days = pd.date_range("2023-12-25", periods=30).date
    d = spark.createDataFrame([(x,) for x in days], "d date")
    got = d.select("d", C.business_day_index("d").alias("b")).orderBy("d").collect()
    for x, y in zip(got, got[1:]):
        assert y["b"] - x["b"] == (1 if y["d"].weekday() < 5 else 0)
