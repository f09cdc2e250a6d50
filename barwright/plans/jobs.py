"""The batch jobs end to end: label, train and store, and on stored runs backtest, sweep, meta model, comparison, journal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.config import ExperimentConfig
from barwright.operators import backtest as bt
from barwright.operators import journal
from barwright.operators.features import feature_matrix
from barwright.operators.labels import label_job
from barwright.operators.positions import slot_table, with_positions, with_session
from barwright.operators.volatility import daily_last_close
from barwright.plans import meta
from barwright.plans.training import TrainResult, log_record, train
from barwright.sources import bars as bar_store
from barwright.sources import runlog, tables
from barwright.sources.journal import read_journal


def run_label(spark: SparkSession, cfg: ExperimentConfig, bars_path: str, labels_path: str) -> None:
    tables.write_labels(label_job(bar_store.read_configured(spark, bars_path, cfg), cfg), labels_path)


def configured_matrix(spark: SparkSession, cfg: ExperimentConfig, bars_path: str, labels_path: str) -> DataFrame:
    bars = bar_store.read_configured(spark, bars_path, cfg)
    labels = tables.read_labels(spark, labels_path, symbol=cfg.symbol, start=cfg.data_start, end=cfg.data_end)
    index = proxy = None
    if cfg.features.market_context:
        index, daily = bar_store.read_context(spark, bars_path, cfg)
        index, proxy = with_session(index, cfg.exchange_timezone), daily_last_close(daily)
    return feature_matrix(
        labels, with_session(bars, cfg.exchange_timezone), cfg, index_bars=index, proxy_daily=proxy
    )


def run_train(spark: SparkSession, cfg: ExperimentConfig, bars_path: str, labels_path: str, out: str) -> TrainResult:
    """Fit and store the model, metrics, per-class report, predictions and a run-log line."""
    result = train(configured_matrix(spark, cfg, bars_path, labels_path), cfg)
    run = f"{out}/runs/{result.run_id}"
    result.model.save(f"{run}/model")
    metrics = {k: v for k, v in result.metrics.items() if v is not None}
    tables.write_json(spark.createDataFrame([{"run_id": result.run_id, **metrics}]), f"{run}/metrics")
    tables.write_json(result.report, f"{run}/report")
    tables.write_predictions(result.predictions, f"{out}/predictions", result.run_id, cfg.train.export_predictions)
    runlog.append_run(spark, f"{out}/log", log_record(result, cfg))
    return result


def stored_facts(
    spark: SparkSession, cfg: ExperimentConfig, bars_path: str, labels_path: str, out: str,
    *, run_id: str | None = None, split: str = "val",
) -> DataFrame:
    """Stored predictions of a run with their trade facts."""
    dated = with_session(bar_store.read_configured(spark, bars_path, cfg), cfg.exchange_timezone)
    labels = tables.read_labels(spark, labels_path, symbol=cfg.symbol, start=cfg.data_start, end=cfg.data_end)
    predictions = tables.read_predictions(spark, f"{out}/predictions", run_id=run_id, split=split)
    return bt.with_trade_facts(predictions, labels, with_positions(dated, slot_table(dated)))


def backtest(
    facts: DataFrame, cfg: ExperimentConfig, *, threshold: float | None = None,
    by: list[str] | None = None, enforce_day_trade_cap: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(summary, trades) under the resolved entry policy."""
    by = by or ["symbol"]
    policy, tau = bt.resolve_policy(cfg, threshold)
    signals = facts.where(bt.is_signal(policy, tau))
    rows = bt.trades(signals, cfg, by, enforce_day_trade_cap=enforce_day_trade_cap)
    summary = bt.summarize(facts, signals, rows, by, by, expected=facts.select(*by).distinct())
    return summary.withColumn("policy", F.lit(policy)).withColumn("tp_threshold", F.lit(tau).cast("double")), rows


@dataclass(frozen=True)
class Stored:
    """Where the jobs on stored runs read and write: bars, labels, and the folder of runs."""

    spark: SparkSession
    cfg: ExperimentConfig
    bars: str
    labels: str
    out: str

    def run_id(self, run_id: str | None) -> str:
        return run_id or tables.latest_run(self.spark, f"{self.out}/predictions")

    def facts(self, run_id: str, split: str) -> DataFrame:
        return stored_facts(self.spark, self.cfg, self.bars, self.labels, self.out, run_id=run_id, split=split)

    def folder(self, run_id: str, name: str) -> str:
        return f"{self.out}/runs/{run_id}/{name}"


def run_backtest(
    at: Stored, *, run_id: str | None = None, split: str = "val", threshold: float | None = None,
    by: list[str] | None = None, enforce_day_trade_cap: bool = True,
) -> DataFrame:
    """Backtest a stored run: trades into the trades table under the run, the summary as JSON; returns the summary."""
    run = at.run_id(run_id)
    summary, trades = backtest(at.facts(run, split), at.cfg, threshold=threshold, by=by, enforce_day_trade_cap=enforce_day_trade_cap)
    tables.write_run(trades, f"{at.out}/trades", run)
    return _stored_json(at, summary, run, f"{split}_backtest")


def run_sweep(
    at: Stored, *, run_id: str | None = None, split: str = "val", thresholds: list[float] | None = None,
    base: list[str] | None = None, min_signals: int = 5, enforce_day_trade_cap: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Threshold sweep of a stored run as CSV and JSON, with the suggested threshold beside it; returns both."""
    run = at.run_id(run_id)
    facts = at.facts(run, split)
    sweep = bt.threshold_sweep(facts, at.cfg, thresholds=thresholds, base=base, enforce_day_trade_cap=enforce_day_trade_cap)
    stored = _stored_json(at, sweep, run, f"{split}_sweep")
    tables.write_csv(stored.coalesce(1).sortWithinPartitions(*(base or ["symbol"]), "threshold"), at.folder(run, f"{split}_sweep_csv"))
    best = bt.suggest_threshold(stored, base, min_signals=min_signals)
    return stored, _stored_json(at, best, run, f"{split}_suggested")


def run_meta(at: Stored, *, run_id: str | None = None, threshold: float | None = None, act: float | None = None) -> meta.MetaModel:
    """Train the meta model of a stored run on its train predictions; store it and its metrics on both splits."""
    run = at.run_id(run_id)
    scored = tables.read_predictions(at.spark, f"{at.out}/predictions", run_id=run, split="all")
    on_train = scored.where(F.col("split") == "train")
    model = meta.train_meta(on_train, on_train, at.cfg, threshold=threshold, act=act)
    model.save(at.folder(run, "meta"))
    metrics = meta.gated_metrics(model.score(scored), model.threshold, ["split"])
    named = metrics.withColumns({"primary_threshold": F.lit(model.threshold), "meta_act_threshold": F.lit(model.act)})
    _stored_json(at, named, run, "meta_metrics")
    return model


def run_compare(
    at: Stored, *, run_id: str | None = None, split: str = "val", base: list[str] | None = None, enforce_day_trade_cap: bool = True
) -> DataFrame:
    """Compare the entry policies on a stored run, with its stored meta model; JSON, returned."""
    run = at.run_id(run_id)
    model = meta.MetaModel.load(at.folder(run, "meta"))
    facts = model.score(at.facts(run, split))
    d = bt.compare_policies(
        facts, at.cfg, threshold=model.threshold, act=model.act, base=base, enforce_day_trade_cap=enforce_day_trade_cap
    )
    return _stored_json(at, d, run, f"{split}_policies")


def run_journal(at: Stored, journal_path: str, *, run_id: str | None = None, split: str = "val") -> tuple[DataFrame, DataFrame]:
    """A trade journal beside the predictions of a stored run: CSV of the rows, and the match counts; returns both."""
    run = at.run_id(run_id)
    predictions = tables.read_predictions(at.spark, f"{at.out}/predictions", run_id=run, split=split)
    if at.cfg.symbol is not None:
        predictions = predictions.where(F.upper("symbol") == at.cfg.symbol.upper())
    entries = read_journal(at.spark, journal_path, at.cfg.symbol)
    rows = journal.compare_journal(entries, predictions)
    tables.write_csv(rows, at.folder(run, f"{split}_journal_csv"))
    return rows, _stored_json(at, journal.match_counts(rows), run, f"{split}_journal")


def _stored_json(at: Stored, rows: DataFrame, run_id: str, name: str) -> DataFrame:
    path = at.folder(run_id, name)
    tables.write_json(rows, path)
    return at.spark.read.schema(rows.schema).json(path)
