"""Settings, training, meta-labelling, grids, jobs and streaming."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.config import ContextSymbol, ExperimentConfig, FeatureConfig, LiveConfig, ModelConfig, TrainConfig
from barwright.operators import backtest as B
from barwright.operators.positions import with_positions, with_session
from barwright.plans import grid, jobs, meta, training
from barwright.sources import bars as S
from barwright.sources import runlog, tables
from barwright.streaming import bars as ST
from tests.helpers import bars_of, walk

CFG = ExperimentConfig(
    symbol="AAA", exchange_timezone="UTC", data_start=date(2024, 1, 1), data_end=date(2024, 3, 1),
    vol_lookback_trading_days=2, profit_barrier_base=0.05, stop_loss_base=0.05, vertical_max_trading_days=1, label_entry_stride=3,
    train_start=date(2024, 1, 8), train_end=date(2024, 1, 19), val_start=date(2024, 1, 22), val_end=date(2024, 2, 1),
    scaler="standard", train=TrainConfig(export_predictions="all"), model=ModelConfig(max_iter=100),
)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    pdf = pd.concat([walk(16, 60, 11), walk(16, 60, 12, "BBB")])
    raw = bars_of(spark, pdf).drop("slot", "session_date")
    S.upsert_bars(spark, S.with_storage_columns(raw, "1min", "UTC"), str(root / "bars"))
    jobs.run_label(spark, CFG, str(root / "bars"), str(root / "labels"))
    return root


@pytest.fixture(scope="module")
def matrix(spark, store):
    return jobs.configured_matrix(spark, CFG, str(store / "bars"), str(store / "labels")).persist()


def test_settings_are_closed_and_checked():
    assert ExperimentConfig().max_day_trades == 10 and ExperimentConfig().label_entry_stride == 390
    with pytest.raises(ValueError, match="unknown settings"):
        ExperimentConfig.from_dict({"symbl": "A"})
    cfg = ExperimentConfig.from_dict({"data_start": "2024-01-01", "features": {"ema_windows_bars": [21, 9, 9]}, "context_symbols": [{"symbol": "SPY"}, {"symbol": "VIXY", "interval": "1day"}]})
    assert cfg.features.ema_windows_bars == (9, 21) and cfg.volatility_proxy.symbol == "VIXY" and cfg.data_start == date(2024, 1, 1)
    for bad in (
        lambda: ExperimentConfig(profit_barrier_base=0.0), lambda: FeatureConfig(macd_fast_bars=30), lambda: ContextSymbol("^VIX", "1day"),
        lambda: LiveConfig(session_start_local="09:30"), lambda: LiveConfig(session_start_local="16:00", session_end_local="09:30"),
        lambda: LiveConfig(session_start_local="9:30", session_end_local="16:00"), lambda: LiveConfig(poll_interval_seconds=10),
        lambda: FeatureConfig(log_entry_close=False, label_geometry=False, intraday_range_pct=False, log1p_volume=False),
        lambda: ExperimentConfig(data_start=date(2024, 2, 1), data_end=date(2024, 1, 1)),
    ):
        with pytest.raises(ValueError):
            bad()
    over = CFG.with_overrides({"model.max_depth": 3, "features.roll_window_bars": 7})
    assert (over.model.max_depth, over.features.roll_window_bars, CFG.model.max_depth) == (3, 7, 6)
    with pytest.raises(ValueError, match="unknown setting"):
        CFG.with_overrides({"model.depth": 3})


def test_run_ids_sort_and_names_are_safe():
    a, b = training.new_run_id(), training.new_run_id()
    assert a[:22] <= b[:22]
    assert training.proba_column("take profit!") == "proba_take_profit"


def test_train_stores_a_run_that_can_be_backtested(spark, store):
    out = str(store / "out")
    result = jobs.run_train(spark, CFG, str(store / "bars"), str(store / "labels"), out)
    assert result.metrics["train_n"] > result.metrics["val_n"] > 0
    assert 0 <= result.metrics["val_accuracy"] <= 1
    assert runlog.read_log(spark, f"{out}/log", "aaa").first()["run_id"] == result.run_id
    total = result.predictions.select(sum(F.col(training.proba_column(c)) for c in result.model.classes).alias("s"))
    assert total.agg(F.max(F.abs(F.col("s") - 1))).first()[0] < 1e-9
    loaded = training.Model.load(f"{out}/runs/{result.run_id}/model")
    rows = training.prepare(jobs.configured_matrix(spark, CFG, str(store / "bars"), str(store / "labels")), CFG).rows
    a = loaded.predictions(rows).orderBy("entry_time", "split").toPandas()
    b = result.predictions.orderBy("entry_time", "split").toPandas()
    pd.testing.assert_frame_equal(a, b)
    facts = jobs.stored_facts(spark, CFG, str(store / "bars"), str(store / "labels"), out)
    summary, trades = jobs.backtest(facts, CFG, threshold=0.01)
    s = summary.first()
    gated = result.predictions.where("split = 'val' and proba_take_profit >= 0.01").count()
    assert s["n_predictions"] == result.metrics["val_n"]
    assert s["n_signals"] == gated == trades.count() > 0


@pytest.fixture(scope="module")
def stored(spark, store):
    out = str(store / "jobs")
    jobs.run_train(spark, CFG, str(store / "bars"), str(store / "labels"), out)
    return jobs.Stored(spark, CFG, str(store / "bars"), str(store / "labels"), out)


def test_a_stored_run_is_backtested_and_swept(spark, stored):
    run = stored.run_id(None)
    s = jobs.run_backtest(stored, threshold=0.01).first()
    trades = tables.read_run(spark, f"{stored.out}/trades", run)
    assert trades.count() == s["n_signals"] > 0 and s["tp_threshold"] == 0.01
    again = jobs.run_backtest(stored, run_id=run, threshold=1.0).first()
    assert again["n_signals"] == 0 and tables.read_run(spark, f"{stored.out}/trades", run).count() == 0
    sweep, best = jobs.run_sweep(stored, thresholds=[0.01, 0.02, 0.9], min_signals=1)
    at = {r["threshold"]: r for r in sweep.collect()}
    assert all(at[0.01][k] == pytest.approx(s[k]) for k in ("n_signals", "n_trades_taken", "gross_return_sum", "max_drawdown_cumulative_sum"))
    csv = spark.read.csv(stored.folder(run, "val_sweep_csv"), header=True)
    assert csv.columns == sweep.columns and csv.count() == 3 and best.count() == 1
    with pytest.raises(ValueError, match="no run"):
        jobs.run_backtest(stored, run_id="r0")


def test_a_stored_meta_model_compares_policies(spark, stored, matrix):
    run = stored.run_id(None)
    model = jobs.run_meta(stored, threshold=0.05, act=0.4)
    loaded = meta.MetaModel.load(stored.folder(run, "meta"))
    assert (loaded.threshold, loaded.act) == (0.05, 0.4)
    primary = training.Model.load(stored.folder(run, "model"))
    both = loaded.after(primary)
    both.write().overwrite().save(stored.folder(run, "both"))
    rows = training.prepare(matrix, CFG).rows
    want = model.score(primary.predictions(rows)).select("entry_time", "split", "meta_proba")
    got = type(both).load(stored.folder(run, "both")).transform(rows).select("entry_time", "split", F.col("meta_proba").alias("loaded"))
    assert want.join(got, ["entry_time", "split"]).where("abs(meta_proba - loaded) > 1e-12").count() == 0
    metrics = {r["split"]: r for r in spark.read.json(stored.folder(run, "meta_metrics")).collect()}
    assert set(metrics) == {"train", "val"} and metrics["val"]["n_gated"] > 0
    d = jobs.run_compare(stored)
    assert {r["policy"] for r in d.collect()} == {B.POLICY_ARGMAX, B.POLICY_THRESHOLD, B.POLICY_META}


def test_a_journal_beside_a_stored_run(spark, stored, tmp_path):
    f = tmp_path / "j.csv"
    f.write_text("Date,Ticker\n2024-01-23,aaa\n2024-01-23,zzz\n2030-01-01,AAA\n")
    rows, counts = jobs.run_journal(stored, str(f))
    assert rows.count() == 2 and tuple(counts.first()) == (2, 1)


def test_the_gradient_vanishes_at_the_optimum_only(spark, matrix):
    cfg = replace(CFG, model=ModelConfig(max_iter=2000, tol=1e-9, class_weight="balanced"))
    data = training.prepare(matrix, cfg)
    model = training.fit(data, cfg)
    assert training.logistic_gradient(model, data, cfg) < 1e-4
    rough = replace(cfg, model=ModelConfig(max_iter=100, tol=0.9, class_weight="balanced"))
    assert training.logistic_gradient(training.fit(data, rough), data, cfg) > 1e-4


def test_class_weights_count_twice_in_logistic_fits(spark, matrix):
    data = training.prepare(matrix, CFG)
    for kind, power in (("logistic_regression", 2), ("boosted_trees", 1)):
        cfg = replace(CFG, model=ModelConfig(type=kind, class_weight="balanced"))
        d = training.weighted_rows(data, cfg).select("class_weight", "fit_weight").distinct().collect()
        assert all(r["fit_weight"] == pytest.approx(r["class_weight"] ** power) for r in d)


def test_a_run_record_names_the_settings(spark, stored):
    r = runlog.read_log(spark, f"{stored.out}/log").first().asDict()
    assert r["solver"] == "l-bfgs" and r["drop_val_unseen_classes"] is True and r["export_predictions"] == "all"
    assert r["min_val_rows"] == 1 and "take_profit" in r["classes"]


def test_row_floors_and_unseen_classes():
    counts = {("train", "a"): 3, ("val", "a"): 2, ("val", "b"): 1}
    assert training.check_counts(counts, CFG) == (["a"], 1)
    for t in (TrainConfig(min_train_rows=4), TrainConfig(min_val_rows=3), TrainConfig(drop_val_unseen_classes=False)):
        with pytest.raises(ValueError):
            training.check_counts(counts, replace(CFG, train=t))
    for c in ({("train", "a"): 1}, {("train", "a"): 1, ("val", "b"): 1}):
        with pytest.raises(ValueError):
            training.check_counts(c, CFG)


def test_scaler_sees_train_rows_only(spark, matrix):
    prepared = training.prepare(matrix, CFG)
    a = training.fit(prepared, CFG)
    moved = prepared.rows.withColumn("log1p_volume", F.when(F.col("split") == "val", 1e6).otherwise(F.col("log1p_volume")))
    b = training.fit(replace(prepared, rows=moved), CFG)
    assert list(a.pipeline.stages[1].mean) == list(b.pipeline.stages[1].mean)


def test_boosted_trees_with_weights(spark, matrix):
    m = ModelConfig(type="boosted_trees", n_estimators=2, max_depth=2, class_weight="balanced")
    cfg = replace(CFG, model=m, scaler="robust", train=TrainConfig(sample_weight_method="uniqueness"))
    r = training.train(matrix, cfg)
    assert r.metrics["sample_weight_min"] > 0 and set(r.predictions.columns) >= {"y_pred", "max_proba", "proba_take_profit"}
    with pytest.raises(ValueError, match="class_weight names"):
        training.fit(training.prepare(matrix, cfg), replace(cfg, model=replace(m, class_weight={"nope": 1.0})))


def test_labels_are_indexed_alphabetically(spark):
    d = spark.createDataFrame([("b",), ("a",), ("z",)], "y string")
    got = {r["y"]: r["i"] for r in d.select("y", training.label_index(["a", "b"]).alias("i")).collect()}
    assert (got["a"], got["b"]) == (0.0, 1.0)


def test_meta_labelling(spark, matrix, store):
    prepared = training.prepare(matrix, CFG)
    scored = training.fit(prepared, CFG).predictions(prepared.rows).persist()
    on_train, on_val = (scored.where(F.col("split") == s) for s in ("train", "val"))
    second = meta.train_meta(on_train, on_train, CFG, threshold=0.05)
    val = second.score(on_val)
    m = meta.meta_metrics(second, second.score(scored))
    assert m["val_n_gated"] == val.where("proba_take_profit >= 0.05").count()
    dated = with_session(S.read_configured(spark, str(store / "bars"), CFG), "UTC")
    facts = B.with_trade_facts(val, tables.read_labels(spark, str(store / "labels")), with_positions(dated))
    assert B.compare_policies(facts, CFG, threshold=0.05).count() == 3
    with pytest.raises(ValueError, match="outside the primary train split"):
        meta.train_meta(scored, on_train, CFG, threshold=0.05)
    with pytest.raises(ValueError, match="no primary-gated"):
        meta.train_meta(on_train, on_train, CFG, threshold=1.0)


def test_meta_features_default_to_zero(spark):
    d = meta.with_meta_features(spark.createDataFrame([(0.3, 0.7)], "proba_take_profit double, proba_stop_loss double"))
    r = d.first()
    assert (r["proba_vertical"], r["max_proba"]) == (0.0, 0.7)


def test_grid(spark, matrix):
    assert grid.expand({}) == [{}]
    assert grid.expand({"a": [1, 2], "b": ["x"]}) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    with pytest.raises(ValueError):
        grid.expand({"a": "xy"})
    assert grid.name_suffix({"model.lr": 0.05, "train.n": 3}) == "lr0p05_n3"
    pairs = grid.build_configs(CFG, {"model.logistic_c": [0.5, 1.0], "train.min_val_rows": [1, 10**6]}, prefix="g", notes_prefix="n")
    assert pairs[0][1].train.notes == "n | logistic_c0p5_min_val_rows1"
    dry = grid.dry_run(spark, pairs, lambda cfg: matrix)
    assert dry.where("ready").count() == 2 and dry.columns[:2] == ["grid.model.logistic_c", "grid.train.min_val_rows"]
    done = grid.train_all(spark, pairs, lambda cfg: matrix).collect()
    assert [r["ok"] for r in done] == [True, True, False, False]
    assert done[0]["val_f1_macro"] >= done[1]["val_f1_macro"] and "below min_val_rows" in done[2]["error"]
    presets = grid.preset_configs(CFG, {"p": {"model.logistic_c": 2.0}})
    assert presets[0][1].train.experiment_name == "p" and presets[0][1].model.logistic_c == 2.0


def test_tick_stream_builds_the_bars_a_batch_builds(spark, tmp_path):
    rng = np.random.default_rng(1)
    ts = pd.to_datetime("2024-01-08 09:00") + pd.to_timedelta(np.sort(rng.choice(8 * 3600 * 10, 4000, replace=False)) / 10, unit="s")
    ticks = pd.DataFrame({"symbol": rng.choice(["A", "B"], 4000), "ts": ts, "price": rng.normal(100, 1, 4000), "size": 1.0})
    for i in range(3):
        spark.createDataFrame(ticks.iloc[i::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    live = LiveConfig(session_start_local="09:30", session_end_local="15:59", merge_strategy="merge_into_main")
    cfg = ExperimentConfig(exchange_timezone="UTC", live=live)
    stream = ST.stream_bars(ST.tick_stream(spark, str(tmp_path / "ticks"), files_per_batch=1), cfg)
    path = str(tmp_path / "bars")
    seen = []
    q = ST.start_refresh(stream, cfg, path, str(tmp_path / "progress"), once=True, on_batch=lambda b: seen.append(b.count()))
    q.awaitTermination()
    got = S.read_bars(spark, path).orderBy("symbol", "ts").toPandas()
    inside = ticks[ticks["ts"].dt.strftime("%H:%M").between("09:30", "15:59")]
    want = inside.groupby(["symbol", inside["ts"].dt.floor("min")])["price"].agg(["first", "max", "min", "last", "count"])
    assert len(seen) == 3 and len(got) == len(want)
    np.testing.assert_allclose(got["high"], want["max"])
    np.testing.assert_allclose(got["close"], want["last"])
    np.testing.assert_allclose(got["volume"], want["count"])
    assert ST.target_path("x/", replace(cfg, live=LiveConfig())) == "x_recent"


def test_new_bars_are_scored_with_a_saved_model(spark, matrix, store):
    prepared = training.prepare(matrix, CFG)
    model = training.fit(prepared, CFG)
    history = S.read_configured(spark, str(store / "bars"), CFG).drop("session_date", "interval")
    last = history.orderBy(F.desc("ts")).limit(3)
    got = ST.score_new_bars(history, last, CFG, model)
    assert got.count() == 3 and got.where("max_proba > 0").count() == 3
