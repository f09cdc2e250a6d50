"""Meta-labelling: a second, binary model that decides which primary signals to act on."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.config import ExperimentConfig
from barwright.functions.expr import ratio_or_zero
from barwright.operators.backtest import act_threshold, primary_threshold
from barwright.operators.labels import TAKE_PROFIT
from barwright.operators.weights import collected_class_weights, mapped_class_weight
from barwright.plans.stages import META_COLUMNS, MetaFeatures, MetaProbability, with_meta_features
from barwright.plans.training import Model

MAX_ITERATIONS = 2000


def meta_target() -> Column:
    return (F.col("y_true") == TAKE_PROFIT).cast("double")


def leaked_rows(meta_train: DataFrame, primary_train: DataFrame) -> DataFrame:
    """Meta-training rows that are not primary-training rows."""
    return meta_train.join(primary_train.select("symbol", "entry_time"), ["symbol", "entry_time"], "left_anti")


@dataclass
class MetaModel:
    """A fitted pipeline from the four probabilities to `meta_proba`, with its gate and its least score to act on."""

    pipeline: PipelineModel

    @property
    def _last(self) -> MetaProbability:
        return self.pipeline.stages[-1]

    @property
    def threshold(self) -> float:
        return self._last.getOrDefault("threshold")

    @property
    def act(self) -> float:
        return self._last.getOrDefault("act")

    def score(self, predictions: DataFrame) -> DataFrame:
        """Add `meta_proba`, the probability that acting on the signal ends in take_profit."""
        return self.pipeline.transform(predictions)

    def after(self, primary: Model) -> PipelineModel:
        """Primary and meta model as one pipeline over feature rows."""
        return PipelineModel([*primary.pipeline.stages, *self.pipeline.stages])

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> MetaModel:
        return cls(PipelineModel.load(path))


def train_meta(
    train_predictions: DataFrame, primary_train: DataFrame, cfg: ExperimentConfig,
    *, threshold: float | None = None, act: float | None = None,
) -> MetaModel:
    """Balanced binary logistic regression on primary-gated train predictions."""
    tau = primary_threshold(cfg, threshold)
    gated = with_meta_features(train_predictions.where(F.col("proba_take_profit") >= tau)).withColumn("target", meta_target())
    n_leaked = leaked_rows(gated, primary_train).count()
    if n_leaked:
        raise ValueError(f"meta training has {n_leaked} rows outside the primary train split")
    balanced = collected_class_weights(gated, "target")
    weighted = gated.withColumn("class_weight", mapped_class_weight(balanced, "target"))
    assembler = VectorAssembler(inputCols=list(META_COLUMNS), outputCol="_mx")
    x = assembler.transform(weighted).persist()
    try:
        total = x.agg(F.sum("class_weight"), F.count_distinct("target")).first()
        if not total[0]:
            raise ValueError(f"no primary-gated train rows at threshold {tau}")
        if total[1] < 2:
            raise ValueError("primary-gated train rows have a single outcome class")
        model = LogisticRegression(
            featuresCol="_mx", labelCol="target", weightCol="class_weight", maxIter=MAX_ITERATIONS, tol=1e-4,
            regParam=1.0 / total[0], standardization=False,
            probabilityCol="_mp", rawPredictionCol="_mr", predictionCol="_my",
        ).fit(x)
    finally:
        x.unpersist()
    return MetaModel(PipelineModel([MetaFeatures(), assembler, model, MetaProbability(tau, act_threshold(cfg, act))]))


def gated_metrics(scored: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Accuracy, precision and recall of acting (meta_proba > 0.5) on primary-gated rows."""
    act, hit = F.col("meta_proba") > 0.5, F.col("y_true") == TAKE_PROFIT
    counts = scored.where(F.col("proba_take_profit") >= threshold).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_gated"),
        F.count_if(hit).alias("n_positive"),
        F.count_if(act).alias("_act"),
        F.count_if(act & hit).alias("_tp"),
        F.count_if(act == hit).alias("_ok"),
    )
    return counts.select(
        *by, "n_gated", "n_positive",
        ratio_or_zero("_ok", "n_gated").alias("accuracy_gated"),
        ratio_or_zero("_tp", "_act").alias("precision_gated"),
        ratio_or_zero("_tp", "n_positive").alias("recall_gated"),
    )


def meta_metrics(model: MetaModel, scored: DataFrame) -> dict[str, Any]:
    """Counts and quality per split of scored predictions."""
    rows = gated_metrics(scored, model.threshold, ["split"]).collect()
    out: dict[str, Any] = {"primary_threshold": model.threshold, "meta_act_threshold": model.act}
    for r in rows:
        out |= {f"{r['split']}_{k}": r[k] for k in r.asDict() if k != "split"}
    return out
