"""Sample weights: average uniqueness of overlapping labels, and class weights."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.positions import running_sums

CHUNK = 65536


def concurrency_edges(spans: DataFrame, by: list[str]) -> DataFrame:
    """Positions where the number of open label windows changes: (by..., pos, c, g).

    A label covers (entry_pos, entry_pos + bars_forward]. `c` is the number of labels open from
    `pos` until the next edge; `g` is the sum of 1 / c over all covered positions before `pos`.
    Two rows per label enter and the bars themselves are not needed.
    """
    start, end = F.col("entry_pos") + 1, F.col("entry_pos") + F.col("bars_forward") + 1
    edges = (
        spans.select(
            *by,
            F.explode(
                F.array(
                    F.struct(start.alias("pos"), F.lit(1).alias("d")),
                    F.struct(end.alias("pos"), F.lit(-1).alias("d")),
                )
            ).alias("e"),
        )
        .groupBy(*by, F.col("e.pos").alias("pos"))
        .agg(F.sum("e.d").alias("d"))
    )
    counted = running_sums(edges, by, "pos", {"d": "c"}, chunk_rows=CHUNK).withColumn(
        "_k", F.floor(F.col("pos") / CHUNK)
    )
    chunk_order = Window.partitionBy(*by).orderBy("_k")
    firsts = (
        counted.groupBy(*by, "_k")
        .agg(F.min("pos").alias("_first"))
        .withColumn("_next_first", F.lead("_first").over(chunk_order))
        .drop("_first")
    )
    inside = Window.partitionBy(*by, "_k").orderBy("pos")
    width = F.coalesce(F.lead("pos").over(inside), F.col("_next_first")) - F.col("pos")
    pieces = (
        counted.join(firsts, [*by, "_k"])
        .withColumn("_w", width)
        .withColumn("piece", F.when(F.col("c") > 0, F.col("_w") / F.col("c")).otherwise(0.0))
        .drop("_k", "_w", "_next_first", "d")
        .withColumn("piece", F.coalesce("piece", F.lit(0.0)))
    )
    summed = running_sums(pieces, by, "pos", {"piece": "g"}, chunk_rows=CHUNK)
    return summed.withColumn("g", F.col("g") - F.col("piece")).drop("piece")


def uniqueness_weights(labels: DataFrame, by: list[str] | None = None, *, name: str = "uniqueness") -> DataFrame:
    """Add the mean of 1 / concurrency over each label's window.

    Labels without a position or length get weight 1; a length below 1 stops the job. Only the
    rows given count as concurrent, so pass the training rows.
    """
    by = by or ["symbol"]
    length = F.col("bars_forward")
    checked = labels.withColumn(
        "bars_forward",
        F.when(length < 1, F.raise_error(F.lit("bars_forward must be >= 1")).cast("bigint")).otherwise(length),
    )
    known = checked.where(F.col("entry_pos").isNotNull() & F.col("bars_forward").isNotNull())
    edges = concurrency_edges(known, by).select(*by, "pos", "g")
    at_start = edges.select(*by, (F.col("pos") - 1).alias("entry_pos"), F.col("g").alias("_g0"))
    at_end = edges.select(*by, (F.col("pos") - 1).alias("_last"), F.col("g").alias("_g1"))
    return (
        checked.withColumn("_last", F.col("entry_pos") + F.col("bars_forward"))
        .join(at_start, [*by, "entry_pos"], "left")
        .join(at_end, [*by, "_last"], "left")
        .withColumn(
            name, F.coalesce((F.col("_g1") - F.col("_g0")) / F.col("bars_forward"), F.lit(1.0))
        )
        .drop("_last", "_g0", "_g1")
    )


def balanced_class_weights(rows: DataFrame, y: str = "y", by: list[str] | None = None) -> DataFrame:
    """(by..., y, n, class_weight) with weight = rows / (classes * rows of the class)."""
    by = by or []
    counts = rows.groupBy(*by, y).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn(
        "class_weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))
    )


def mapped_class_weight(weights: Mapping[Any, float], y: str = "y") -> Column:
    """Class weight from a mapping; classes not named weigh 1."""
    expr = F.lit(1.0)
    for cls, w in weights.items():
        expr = F.when(F.col(y) == cls, F.lit(float(w))).otherwise(expr)
    return expr


def collected_class_weights(rows: DataFrame, y: str = "y") -> dict[Any, float]:
    """Balanced weights as a mapping: one number per class is all that reaches the driver.

    As literals they need no join on the class, whose few values would gather the rows.
    """
    return {r[y]: float(r["class_weight"]) for r in balanced_class_weights(rows, y).collect()}


def with_fit_weights(
    train: DataFrame,
    *,
    method: str = "none",
    class_weight: str | Mapping[str, float] | None = None,
    y: str = "y",
) -> DataFrame:
    """Add `fit_weight` = (uniqueness if asked) x (class weight if asked).

    For uniqueness every train row needs its label's position and length; a row without them stops the job.
    """
    if method not in ("none", "uniqueness"):
        raise ValueError(f"unknown sample weight method {method!r}")
    if method == "uniqueness":
        lost = F.col("entry_pos").isNull() | F.col("bars_forward").isNull()
        found = F.when(lost, F.raise_error(F.lit("a train row lacks its label's position or bars_forward")).cast("bigint"))
        d = uniqueness_weights(train.withColumn("bars_forward", found.otherwise(F.col("bars_forward"))))
    else:
        d = train.withColumn("uniqueness", F.lit(1.0))
    weights = collected_class_weights(train, y) if class_weight == "balanced" else (class_weight or {})
    return d.withColumn("class_weight", mapped_class_weight(weights, y)).withColumn(
        "fit_weight", F.col("uniqueness") * F.col("class_weight")
    )


def weight_summary(weighted: DataFrame, by: list[str] | None = None) -> DataFrame:
    return weighted.groupBy(*(by or [])).agg(
        F.avg("fit_weight").alias("sample_weight_mean"), F.min("fit_weight").alias("sample_weight_min")
    )
