"""Sources, sinks, evaluation, journal, run log and reports."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barwright.operators import evaluation as E
from barwright.operators import journal as J
from barwright.operators import report as R
from barwright.sources import bars as S
from barwright.sources import journal as JS
from barwright.sources import runlog, tables
from tests.helpers import bars_of, walk


def bounds(spark, a, b):
    return spark.createDataFrame([("A", a, b)], "symbol string, stored_start date, stored_end date")


@pytest.mark.parametrize(
    ("stored", "want"),
    [
        ((date(2021, 3, 10), date(2021, 8, 2)), [(date(2021, 2, 14), date(2021, 3, 9)), (date(2021, 8, 3), date(2021, 9, 9))]),
        ((date(2021, 2, 18), date(2021, 9, 4)), [(date(2021, 9, 5), date(2021, 9, 9))]),
        ((date(2021, 2, 19), date(2021, 9, 5)), [(date(2021, 2, 14), date(2021, 2, 18))]),
        ((date(2021, 2, 1), date(2021, 10, 1)), []),
        ((None, None), [(date(2021, 2, 14), date(2021, 9, 9))]),
    ],
)
def test_missing_ranges(spark, stored, want):
    """Four days are tolerated at either end, five are not."""
    got = S.missing_ranges(bounds(spark, *stored), date(2021, 2, 14), date(2021, 9, 9)).collect()
    assert sorted((r["range_start"], r["range_end"]) for r in got) == want


def test_calendar_chunks(spark):
    d = spark.createDataFrame([(date(2021, 2, 25), date(2021, 3, 9)), (date(2021, 2, 2), date(2021, 2, 1))], "range_start date, range_end date")
    got = [(r["chunk_start"].isoformat(), r["chunk_end"].isoformat()) for r in S.calendar_chunks(d, 5).collect()]
    assert got == [("2021-02-25", "2021-03-01"), ("2021-03-02", "2021-03-06"), ("2021-03-07", "2021-03-09")]


def test_normalize_keeps_the_last_arrival_and_coerces(spark):
    raw = spark.createDataFrame(
        [("A", "2024-01-02 09:30:00", "1", 1), ("A", "2024-01-02 09:30:00", "x", 2), ("A", "2024-01-02 09:31:00", "NaN", 3), ("A", "bad", "1", 4)],
        "symbol string, datetime string, close string, n int",
    )
    got = S.normalize_bars(raw, arrival="n", tz="America/New_York").orderBy("ts").collect()
    assert [(str(r["ts"]), r["close"], r["volume"]) for r in got] == [("2024-01-02 14:30:00", None, None), ("2024-01-02 14:31:00", None, None)]


def test_merge_refresh_and_store(spark, tmp_path):
    stored = S.with_storage_columns(bars_of(spark, walk(4, 6, 1)).drop("slot", "session_date"), "1min", "UTC")
    new = stored.where(F.col("session_date") >= date(2024, 1, 10)).withColumn("close", F.lit(1.0))
    assert S.merge_bars(stored, new).where("close = 1.0").count() == 12
    fresh = S.replace_window(stored, new.where(F.minute("ts") == 30), date(2024, 1, 10), date(2024, 1, 11))
    assert fresh.count() == 12 + 2
    path = str(tmp_path / "bars")
    assert S.upsert_bars(spark, stored, path) and S.upsert_bars(spark, new, path)
    assert not S.upsert_bars(spark, new.limit(0), path)
    back = S.read_bars(spark, path, symbols=["AAA"], start=date(2024, 1, 9), end=date(2024, 1, 10))
    assert (back.count(), back.where("close = 1.0").count()) == (12, 6)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan and "EqualTo(symbol,AAA)" in plan
    assert S.read_bars(spark, path).count() == 24


def test_fetch_plan(spark):
    from barwright.config import ExperimentConfig

    cfg = ExperimentConfig(data_start=date(2024, 1, 1), data_end=date(2024, 1, 25), ingest_chunk_calendar_days=10)
    stored = spark.createDataFrame([("A", "1min", date(2024, 1, 2)), ("A", "1min", date(2024, 1, 12))], "symbol string, interval string, session_date date")
    wanted = spark.createDataFrame([("A", "1min"), ("B", "1day")], "symbol string, interval string")
    got = S.fetch_plan(stored, wanted, cfg).orderBy("symbol", "chunk_start").collect()
    assert [(r["symbol"], r["chunk_start"].day, r["chunk_end"].day) for r in got] == [("A", 13, 22), ("A", 23, 25), ("B", 1, 10), ("B", 11, 20), ("B", 21, 25)]


def test_labels_and_predictions_round_trip(spark, tmp_path):
    d = spark.createDataFrame(
        [("A", datetime(2024, 1, 2), date(2024, 1, 2), "val"), ("A", datetime(2024, 1, 3), date(2024, 1, 3), "train")],
        "symbol string, entry_time timestamp, session_date date, split string",
    )
    tables.write_labels(d, str(tmp_path / "l"))
    assert tables.read_labels(spark, str(tmp_path / "l"), symbol="A", start=date(2024, 1, 3)).count() == 1
    p = str(tmp_path / "p")
    assert tables.write_predictions(d, p, "r1", "all") and tables.write_predictions(d, p, "r2")
    assert not tables.write_predictions(d, p, "r3", "none")
    assert tables.read_predictions(spark, p).count() == 1
    assert tables.read_predictions(spark, p, run_id="r1", split="all").count() == 2
    with pytest.raises(ValueError, match="no prediction rows"):
        tables.read_predictions(spark, p, split="train")
    with pytest.raises(ValueError, match="split"):
        tables.read_predictions(spark, p, split="test")


def test_runs_keep_their_own_columns(spark, tmp_path):
    p = str(tmp_path / "p")
    d = spark.createDataFrame([("A", "val", 0.4)], "symbol string, split string, proba_stop_loss double")
    tables.write_predictions(d, p, "r1")
    tables.write_predictions(d.withColumn("proba_take_profit", F.lit(0.6)), p, "r2")
    assert "proba_take_profit" in tables.read_predictions(spark, p, run_id="r2").columns
    assert "proba_take_profit" not in tables.read_predictions(spark, p, run_id="r1").columns
    both = {r["run_id"]: r["proba_take_profit"] for r in tables.read_runs(spark, p).collect()}
    assert both == {"r1": None, "r2": 0.6} and tables.run_ids(spark, p) == ["r1", "r2"]
    tables.write_predictions(d.limit(0), p, "r2")
    with pytest.raises(ValueError, match="no run"):
        tables.read_run(spark, p, "r3")


def test_report_of_a_run(spark):
    m = spark.createDataFrame([("A", "r1", 0.1), ("A", "r2", 0.2), ("B", "r1", 0.3)], "symbol string, run_id string, f1 double")
    c = spark.createDataFrame([("r1", "a"), ("r2", "b")], "run_id string, class string")
    log = m.withColumn("logged_at_utc", F.col("run_id"))
    for run, want in ((None, ("r2", "b")), ("r1", ("r1", "a"))):
        parts = R.run_report(log, m, c, "A", run_id=run)
        assert (parts["metrics"].first()["run_id"], parts["per_class"].first()["class"]) == want
    assert {(r["symbol"], r["run_id"]) for r in R.run_report(log, m, c)["metrics"].collect()} == {("A", "r2"), ("B", "r1")}
    assert R.run_report(log, m, c, entries=1)["log_tail"].count() == 2


def preds(spark):
    rows = [("a", 1, "a"), ("a", 2, "b"), ("b", 3, "b")]
    return spark.createDataFrame([(date(2024, 1, 2), i, y, p, 0.5, "val") for y, i, p in rows], "session_date date, entry_time int, y_true string, y_pred string, max_proba double, split string")


def test_classification_report(spark):
    got = {r["class"]: r for r in E.classification_report(preds(spark).withColumn("k", F.lit(1)), ["k"], classes=["a", "b", "c"]).collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["support"]) == (1.0, 0.5, 2)
    assert got["b"]["f1"] == pytest.approx(2 / 3) and got["c"]["f1"] == 0.0
    assert got["accuracy"]["f1"] == pytest.approx(2 / 3) and got["macro avg"]["f1"] == pytest.approx(4 / 9)
    assert got["weighted avg"]["f1"] == pytest.approx(2 / 3)
    f = E.f1_scores(preds(spark).withColumn("k", F.lit(1)), ["k"]).first()
    assert f["f1_macro"] == pytest.approx(2 / 3)  # the absent class does not count here


def test_session_rollup_takes_the_smallest_most_frequent(spark):
    r = J.session_rollup(preds(spark)).first()
    assert (r["pred_n"], r["y_true_first"], r["y_pred_mode"]) == (3, "a", "b")
    tie = J.session_rollup(preds(spark).where("entry_time < 3")).first()
    assert tie["y_pred_mode"] == "a"
    assert J.session_rollup(preds(spark), split="train").count() == 0


def test_journal(spark, tmp_path):
    f = tmp_path / "j.csv"
    f.write_text("Open Date,Ticker,notes\n2024-01-02, abc ,x\n2024-01-03,,y\n2024-01-02,zzz,z\n")
    j = JS.read_journal(spark, str(f), "ABC")
    got = J.compare_journal(j, preds(spark)).orderBy("entry_date").collect()
    assert [(r["notes"], r["model_matched"]) for r in got] == [("x", True), ("y", False)]
    assert tuple(J.match_counts(J.compare_journal(j, preds(spark))).first()) == (2, 1)
    f.write_text("date\nsoon\n")
    with pytest.raises(Exception, match="invalid entry_date"):
        JS.read_journal(spark, str(f)).collect()
    f.write_text("when\n2024-01-02\n")
    with pytest.raises(ValueError, match="needs one of"):
        JS.read_journal(spark, str(f))


def test_run_log(spark, tmp_path):
    p = str(tmp_path / "log")
    for i, f1 in enumerate([0.2, None, 0.5]):
        runlog.append_run(spark, p, {"run_id": f"r{i}", "symbol": "abc", "val_f1_macro": f1, "cfg": {"a": {"b": i}, "l": [1, 2], "s": None if i else "t"}})
    runlog.append_run(spark, p, {"run_id": "r9", "symbol": "XYZ"})
    flat = runlog.order_columns(runlog.flatten(runlog.read_log(spark, p, "ABC")))
    assert flat.columns == ["logged_at_utc", "run_id", "symbol", "val_f1_macro", "cfg.a.b", "cfg.l", "cfg.s"]
    rows = {r["run_id"]: r for r in flat.collect()}
    assert len(rows) == 3 and rows["r1"]["cfg.l"] == "[1,2]" and rows["r1"]["cfg.s"] == ""
    assert runlog.export_log(spark, p, str(tmp_path / "csv"), "ABC") == 3
    log = runlog.read_log(spark, p)
    assert [r["run_id"] for r in R.leaderboard(log).orderBy("rank").collect()] == ["r2", "r0"]
    assert R.best_run(log.select("run_id", "val_f1_macro")).first()["run_id"] == "r2"
    assert [r["run_id"] for r in R.log_tail(log, "ABC", entries=2).collect()] == ["r1", "r2"]
    assert R.sort_results(log).first()["run_id"] == "r2"


def test_order_grid_columns(spark):
    d = spark.createDataFrame([(1, "", True, 0.5, 2)], "extra int, error string, ok boolean, val_f1_macro double, `grid.b` int")
    assert R.order_grid_columns(d).columns == ["grid.b", "ok", "val_f1_macro", "error", "extra"]
