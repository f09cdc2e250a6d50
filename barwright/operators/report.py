"""Leaderboards and run reports over the run log and the metrics tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.expr import leading


def leaderboard(runs: DataFrame, metric: str = "val_f1_macro", *, top: int = 10, by: list[str] | None = None) -> DataFrame:
    """The best runs per group with their rank; runs without the metric are left out.

    The first cut keeps `top` rows per group in a bounded heap on every input partition (the
    limit of a rank filter), so groups of any size rank cheaply.
    """
    groups = by or []
    w = Window.partitionBy(*groups).orderBy(F.desc(metric), "run_id") if groups else None
    scored = runs.where(F.col(metric).isNotNull())
    if w is None:
        best = scored.orderBy(F.desc(metric), "run_id").limit(top)
        w = Window.orderBy(F.desc(metric), "run_id")
        return best.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)


def sort_results(results: DataFrame, metric: str = "val_f1_macro") -> DataFrame:
    """Best first, runs without the metric last."""
    return results.orderBy(F.desc_nulls_last(metric))


def best_run(results: DataFrame, by: list[str] | None = None, metric: str = "val_f1_macro") -> DataFrame:
    """The run with the highest metric per group; the earliest run id wins a tie."""
    groups = by or []
    rest = [c for c in results.columns if c not in groups]
    best = results.where(F.col(metric).isNotNull()).groupBy(*groups).agg(
        F.min_by(F.struct(*rest), F.struct((-F.col(metric)).alias("m"), F.col("run_id"))).alias("b")
    )
    return best.select(*groups, "b.*")


def log_tail(log: DataFrame, symbol: str, *, entries: int = 5, order: str = "logged_at_utc") -> DataFrame:
    """The symbol's last entries, oldest first, however many lines of other symbols follow them."""
    mine = log.where(F.upper(F.col("symbol")) == symbol.upper())
    return mine.orderBy(F.desc(order)).limit(entries).orderBy(order)


def backfilled_trials(
    log: DataFrame, metrics: DataFrame, *, column: str = "train_accuracy", last: int = 10
) -> DataFrame:
    """The latest trials with a missing value taken from the run's stored metrics."""
    stored = metrics.select("run_id", F.col(column).alias("_stored"))
    filled: Column = F.coalesce(F.col(column), F.col("_stored"))
    joined = log.join(stored, "run_id", "left").withColumn(column, filled).drop("_stored")
    return joined.orderBy(F.desc("logged_at_utc")).limit(last)


#: leading columns of a grid result table after the grid parameters (fixed values)
GRID_COLUMNS = [
    "ready",
    "ok",
    "val_f1_macro",
    "val_f1_weighted",
    "val_accuracy",
    "train_f1_macro",
    "elapsed_s",
    "experiment_name",
    "run_id",
    "train_n",
    "val_n",
    "error",
    "run_dir",
]


def order_grid_columns(results: DataFrame) -> DataFrame:
    return results.select(*leading(results.columns, GRID_COLUMNS, "grid."))


def _latest(runs: DataFrame) -> DataFrame:
    rest = [c for c in runs.columns if c != "symbol"]
    last = runs.groupBy("symbol").agg(F.max_by(F.struct(*rest), "run_id").alias("r"))
    return last.select("symbol", "r.*").select(runs.columns)


def run_report(
    log: DataFrame, metrics: DataFrame, classes: DataFrame, symbol: str | None = None, *, run_id: str | None = None, entries: int = 5
) -> dict[str, DataFrame]:
    """Tables behind a run report: a run's metrics, its per-class rows, and the log tail of its symbol.

    The latest run of the symbol unless `run_id` names another; without a symbol, each symbol's latest run is reported.
    """
    mine = metrics if symbol is None else metrics.where(F.col("symbol") == symbol)
    if run_id is not None:
        chosen = mine.where(F.col("run_id") == run_id)
    else:
        chosen = _latest(mine)
    keys = [c for c in ("symbol", "run_id") if c in classes.columns]
    if symbol is not None:
        tail = log_tail(log, symbol, entries=entries)
    else:
        w = Window.partitionBy("symbol").orderBy(F.desc("logged_at_utc"), F.desc("run_id"))
        tail = log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= entries).drop("_n")
    return {"metrics": chosen, "per_class": classes.join(chosen.select(*keys), keys, "left_semi"), "log_tail": tail}
