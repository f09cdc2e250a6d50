"""Session roll-up of predictions and comparison with a personal trade journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_rollup(predictions: DataFrame, *, split: str | None = "val", by: list[str] | None = None) -> DataFrame:
    """(by..., session_date, pred_n, y_true_first, y_pred_mode, max_proba_mean)."""
    d = predictions
    if split is not None and "split" in d.columns:
        d = d.where(F.col("split") == split)
    aggs = [
        F.count(F.lit(1)).alias("pred_n"),
        F.min_by("y_true", "entry_time").alias("y_true_first"),
        F.mode("y_pred", True).alias("y_pred_mode"),
    ]
    if "max_proba" in d.columns:
        aggs.append(F.avg("max_proba").alias("max_proba_mean"))
    return d.groupBy(*(by or []), "session_date").agg(*aggs)


def compare_journal(journal: DataFrame, predictions: DataFrame, *, split: str | None = "val") -> DataFrame:
    """Journal rows with their session's roll-up and `model_matched`.

    `predictions` are those of the journal's symbol.
    """
    days = session_rollup(predictions, split=split)
    return journal.join(days, journal["entry_date"] == days["session_date"], "left").withColumn(
        "model_matched", F.coalesce(F.col("pred_n") > 0, F.lit(False))
    )


def match_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("model_matched").alias("n_matched")
    )
