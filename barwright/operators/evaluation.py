"""Classification quality from a confusion table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.expr import ratio_or_zero


def confusion(predictions: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return predictions.groupBy(*by, F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class(cells: DataFrame, by: list[str], classes: list[str] | None = None) -> DataFrame:
    """(by..., class, precision, recall, f1, support) from confusion cells.

    Without `classes` the classes seen as truth or prediction are listed; with it exactly those,
    unseen ones with zeros.
    """
    same = F.col("y_true") == F.col("y_pred")
    zero = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(
            F.col("y_true").alias("class"), F.col("n").alias("s"), zero.alias("p"),
            F.when(same, F.col("n")).otherwise(zero).alias("tp"),
        ),
        F.struct(F.col("y_pred").alias("class"), zero.alias("s"), F.col("n").alias("p"), zero.alias("tp")),
    )
    counts = (
        cells.select(*by, F.explode(roles).alias("r"))
        .groupBy(*by, "r.class")
        .agg(F.sum("r.s").alias("support"), F.sum("r.p").alias("predicted"), F.sum("r.tp").alias("tp"))
    )
    if classes is not None:
        listed = cells.select(*by).distinct().withColumn("class", F.explode(F.array(*map(F.lit, classes))))
        counts = listed.join(counts, [*by, "class"], "left").fillna(0, ["support", "predicted", "tp"])
    return counts.select(
        *by,
        "class",
        ratio_or_zero("tp", "predicted").alias("precision"),
        ratio_or_zero("tp", "support").alias("recall"),
        ratio_or_zero(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def averages(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, macro and weighted averages of per-class rows."""
    s, total = F.col("support"), F.sum("support")
    mean = [F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")]
    weighted = [
        ratio_or_zero(F.sum(F.col(c) * s), total).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")
    ]
    return rows.groupBy(*by).agg(
        ratio_or_zero(F.sum("tp"), total).alias("accuracy"), *mean, *weighted, total.alias("n")
    )


def classification_report(
    predictions: DataFrame, by: list[str], *, classes: list[str] | None = None
) -> DataFrame:
    """Per-class rows followed by `accuracy`, `macro avg` and `weighted avg` rows."""
    rows = per_class(confusion(predictions, by), by, classes)
    a = averages(rows, by)

    def line(name: str, p: str, r: str, f: str) -> DataFrame:
        return a.select(
            *by, F.lit(name).alias("class"), F.col(p).alias("precision"), F.col(r).alias("recall"),
            F.col(f).alias("f1"), F.col("n").alias("support"),
        )

    return (
        rows.drop("tp")
        .unionByName(line("accuracy", "accuracy", "accuracy", "accuracy"))
        .unionByName(line("macro avg", "precision_macro", "recall_macro", "f1_macro"))
        .unionByName(line("weighted avg", "precision_weighted", "recall_weighted", "f1_weighted"))
    )


def f1_scores(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy with macro and weighted F1 over the classes present as truth or prediction."""
    return averages(per_class(confusion(predictions, by), by), by).select(
        *by, "accuracy", "f1_macro", "f1_weighted", "n"
    )


def class_balance(matrix: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    return matrix.groupBy(*by, F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
