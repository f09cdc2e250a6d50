"""The versioned bar table and the store job."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from barwright.config import ContextSymbol, ExperimentConfig
from barwright.plans import store
from barwright.sources import bars as S
from barwright.sources.snapshots import ConflictError, SnapshotTable


def day_bars(spark, day: int, close: float, symbol: str = "A", minutes: int = 3):
    rows = [(symbol, datetime(2024, 5, day, 15, m), close, close, close, close, 1.0) for m in range(minutes)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    return S.with_storage_columns(d, "1min", "UTC")


def content(d):
    return sorted((r.symbol, r.session_date.day, r.ts.minute, r.close) for r in d.collect())


def test_a_killed_merge_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bars")
    S.upsert_bars(spark, day_bars(spark, 13, 1.0), path)
    before = content(S.read_bars(spark, path))

    def killed(*_args, **_more):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            S.upsert_bars(spark, day_bars(spark, 13, 2.0), path)
    assert content(S.read_bars(spark, path)) == before and S.bar_table(spark, path).version() == 1
    S.upsert_bars(spark, day_bars(spark, 13, 2.0), path)
    assert {c for *_, c in content(S.read_bars(spark, path))} == {2.0}


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "bars")
    for close in (1.0, 2.0):
        S.upsert_bars(spark, day_bars(spark, 13, close), path)
    table = S.bar_table(spark, path)
    assert [{c for *_, c in content(table.read(n))} for n in (1, 2)] == [{1.0}, {2.0}]
    assert table.read(0).count() == 0 and table.versions() == [1, 2]


def test_two_writers_from_one_version(spark, tmp_path):
    table = S.bar_table(spark, str(tmp_path / "bars"))
    assert table.commit(day_bars(spark, 13, 1.0), S.ORDER, after=0) == 1
    with pytest.raises(ConflictError):
        table.commit(day_bars(spark, 14, 1.0), S.ORDER, after=0)
    assert table.commit(day_bars(spark, 14, 1.0), S.ORDER, after=1) == 2
    assert len(content(table.read())) == 6


def test_expired_versions_take_their_files_along(spark, tmp_path):
    path = str(tmp_path / "bars")
    for day, close in ((13, 1.0), (14, 1.0), (13, 2.0)):
        S.upsert_bars(spark, day_bars(spark, day, close), path)
    table = S.bar_table(spark, path)
    want = content(table.read())
    gone = table.expire()
    assert len([g for g in gone if g.startswith("data/")]) == 1 and table.versions() == [3]
    assert content(table.read()) == want


def test_forced_refresh_replaces_the_window_of_the_series(spark, tmp_path):
    path = str(tmp_path / "bars")
    for symbol in ("A", "B"):
        for day in (13, 14, 15):
            S.upsert_bars(spark, day_bars(spark, day, 1.0, symbol), path)
    series = spark.createDataFrame([("A", "1min")], "symbol string, interval string")
    S.replace_bars(spark, day_bars(spark, 14, 5.0, "A", minutes=1), series, path, date(2024, 5, 14), date(2024, 5, 15))
    got = content(S.read_bars(spark, path))
    assert [x for x in got if x[0] == "A"] == [("A", 13, m, 1.0) for m in range(3)] + [("A", 14, 0, 5.0)]
    assert len([x for x in got if x[0] == "B"]) == 9


def test_a_window_left_without_bars(spark, tmp_path):
    path = str(tmp_path / "bars")
    S.upsert_bars(spark, day_bars(spark, 13, 1.0), path)
    series = spark.createDataFrame([("A", "1min")], "symbol string, interval string")
    S.replace_bars(spark, day_bars(spark, 13, 1.0).limit(0), series, path, date(2024, 5, 1), date(2024, 5, 30))
    assert S.read_bars(spark, path).count() == 0 and S.bar_table(spark, path).version() == 2


def test_main_and_recent_bars_read_as_one(spark, tmp_path):
    path = str(tmp_path / "bars")
    for day in (13, 14):
        S.upsert_bars(spark, day_bars(spark, day, 1.0), path)
    S.upsert_bars(spark, day_bars(spark, 14, 2.0, minutes=4), path + "_recent")
    got = content(S.read_bars(spark, path, recent=path + "_recent"))
    assert got == [("A", 13, m, 1.0) for m in range(3)] + [("A", 14, m, 2.0) for m in range(4)]


def vendor(spark, symbol, days, interval="1min"):
    rows = [(symbol, f"2024-05-{d:02d} 10:00:00", str(d), 1, interval) for d in days]
    return spark.createDataFrame(rows, "symbol string, datetime string, close string, n int, interval string")


def test_the_store_job_fetches_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "bars")
    cfg = ExperimentConfig(
        symbol="a", exchange_timezone="UTC", data_start=date(2024, 5, 1), data_end=date(2024, 5, 10),
        ingest_chunk_calendar_days=4, context_symbols=(ContextSymbol("SPY"), ContextSymbol("VIXY", "1day")),
    )
    wanted = store.wanted_series(spark, cfg)
    assert sorted(map(tuple, wanted.collect())) == [("A", "1min"), ("SPY", "1min"), ("VIXY", "1day")]
    raw = vendor(spark, "A", range(1, 31)).union(vendor(spark, "SPY", range(3, 31))).union(vendor(spark, "VIXY", [2, 9], "1day")).union(vendor(spark, "ZZZ", [4]))
    one = store.run_store(spark, raw, wanted, cfg, path, arrival="n")
    assert (one.version, one.windows) == (1, 9)
    stored = S.bar_table(spark, path).read()
    assert sorted((r.symbol, r.n) for r in stored.groupBy("symbol").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()) == [("A", 10), ("SPY", 8), ("VIXY", 2)]
    assert store.run_store(spark, raw, wanted, cfg, path, arrival="n") == store.StoreResult(1, 0)
    from dataclasses import replace

    two = store.run_store(spark, raw, wanted, replace(cfg, data_end=date(2024, 5, 20)), path, arrival="n")
    assert two.version == 2 and S.read_bars(spark, path, symbols=["A"]).count() == 20
    short = vendor(spark, "A", [5])
    store.run_store(spark, short, wanted.where("symbol = 'A'"), replace(cfg, data_end=date(2024, 5, 20)), path, arrival="n", force=True)
    assert S.read_bars(spark, path, symbols=["A"]).count() == 1 and S.read_bars(spark, path, symbols=["SPY"]).count() == 18
    with pytest.raises(ValueError):
        store.run_store(spark, raw, wanted, replace(cfg, data_start=None), path, arrival="n")
