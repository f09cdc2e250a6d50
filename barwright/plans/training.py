"""Training set preparation, fitting, scoring and the training job."""

from __future__ import annotations

import dataclasses
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import RobustScaler, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.config import ExperimentConfig
from barwright.operators.evaluation import classification_report, f1_scores
from barwright.operators.features import feature_columns, split_by_session
from barwright.operators.weights import weight_summary, with_fit_weights
from barwright.plans.stages import ClassProbabilities, FiniteVector, proba_column
from barwright.session import cut_lineage

PARALLEL_FITS = 3


def new_run_id() -> str:
    """Run ids sort by time."""
    now = datetime.now(timezone.utc)
    return f"{now:%Y%m%dT%H%M%S}_{now.microsecond:06d}Z_{uuid.uuid4().hex[:6]}"


@dataclass(frozen=True)
class Prepared:
    """A split matrix with its classes; `rows` holds train and surviving validation rows."""

    rows: DataFrame
    features: list[str]
    classes: list[str]
    counts: dict[tuple[str, str], int]
    val_rows_dropped_unseen: int

    def n(self, split: str) -> int:
        return sum(v for (s, _), v in self.counts.items() if s == split)

    @property
    def train(self) -> DataFrame:
        return self.rows.where(F.col("split") == "train")

    @property
    def val(self) -> DataFrame:
        return self.rows.where(F.col("split") == "val")


def known_class_rows(split: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """All train rows, and validation rows whose class occurs in train.

    `classes`, where the counts are known already, saves the semi-join.
    """
    if classes is not None:
        return split.where((F.col("split") == "train") | F.col("y").isin(classes))
    seen = split.where(F.col("split") == "train").select("y").distinct()
    return split.where(F.col("split") == "train").unionByName(
        split.where(F.col("split") == "val").join(seen, "y", "left_semi").select(split.columns)
    )


def check_counts(counts: dict[tuple[str, str], int], cfg: ExperimentConfig) -> tuple[list[str], int]:
    """Classes in train and validation rows lost to unseen classes; unmet row floors are errors.

    `counts` is the (split, class) table: a handful of numbers, the only thing read by the driver.
    """
    classes = sorted({y for (s, y) in counts if s == "train"})
    n_train = sum(v for (s, _), v in counts.items() if s == "train")
    n_val_all = sum(v for (s, _), v in counts.items() if s == "val")
    unseen = {y: v for (s, y), v in counts.items() if s == "val" and y not in classes}
    lost, t = sum(unseen.values()), cfg.train
    if n_train == 0 or n_val_all == 0:
        raise ValueError(f"empty train or val split (train={n_train}, val={n_val_all})")
    if n_train < t.min_train_rows:
        raise ValueError(f"train rows {n_train} below min_train_rows={t.min_train_rows}")
    if unseen and not t.drop_val_unseen_classes:
        raise ValueError(f"val split has classes not seen in train: {sorted(unseen)}")
    if n_val_all - lost == 0:
        raise ValueError("val split empty after removing unseen classes")
    if n_val_all - lost < t.min_val_rows:
        raise ValueError(f"val rows {n_val_all - lost} below min_val_rows={t.min_val_rows}")
    return classes, lost


def split_counts(split: DataFrame) -> dict[tuple[str, str], int]:
    return {(r["split"], r["y"]): r["n"] for r in split.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n")).collect()}


def split_matrix(matrix: DataFrame, cfg: ExperimentConfig) -> tuple[DataFrame, dict[tuple[str, str], int]]:
    """The feature matrix split by session date and stored, with its (split, class) counts."""
    split = cut_lineage(split_by_session(matrix, cfg), "feature matrix")
    return split, split_counts(split)


def prepared(split: DataFrame, counts: dict[tuple[str, str], int], cfg: ExperimentConfig) -> Prepared:
    """A split matrix whose row floors hold, without the validation rows of unseen classes."""
    classes, lost = check_counts(counts, cfg)
    kept = {k: v for k, v in counts.items() if k[1] in classes}
    return Prepared(known_class_rows(split, classes) if lost else split, feature_columns(cfg.features), classes, kept, lost)


def prepare(matrix: DataFrame, cfg: ExperimentConfig) -> Prepared:
    """Split a feature matrix by session date and check its row floors."""
    return prepared(*split_matrix(matrix, cfg), cfg)


def balance_text(counts: dict[tuple[str, str], int], split: str) -> str:
    """Rows per class of a split, before unseen classes are dropped, as `class=rows` in the order of the classes."""
    return ",".join(f"{y}={n}" for (s, y), n in sorted(counts.items()) if s == split)


def readiness(counts: dict[tuple[str, str], int], cfg: ExperimentConfig) -> dict[str, Any]:
    """Pre-flight summary of one setting from its (split, class) counts."""
    out: dict[str, Any] = {
        "experiment_name": cfg.train.experiment_name,
        "model_type": cfg.model.type,
        "sample_weight_method": cfg.train.sample_weight_method,
        "n_feature_columns": len(feature_columns(cfg.features)),
        "feature_columns": ",".join(feature_columns(cfg.features)),
        **{f"{s}_balance": balance_text(counts, s) for s in ("train", "val")},
    }
    try:
        classes, lost = check_counts(counts, cfg)
    except ValueError as e:
        return {**out, "ready": False, "train_n": 0, "val_n": 0, "val_rows_dropped_unseen": 0, "error": str(e)}
    n = {s: sum(v for (t, y), v in counts.items() if t == s and y in classes) for s in ("train", "val")}
    return {
        **out, "ready": True, "train_n": n["train"], "val_n": n["val"], "val_rows_dropped_unseen": lost, "error": "",
    }


def _preparation(cfg: ExperimentConfig, train: DataFrame, features: list[str]) -> tuple[list[Any], str]:
    stages: list[Any] = [FiniteVector.of(train, features, "_raw")]
    if cfg.scaler == "standard":
        stages.append(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True))
    elif cfg.scaler == "robust":
        stages.append(RobustScaler(inputCol="_raw", outputCol="_x", withCentering=True, withScaling=True))
    return stages, "_x" if len(stages) > 1 else "_raw"


def _logistic(cfg: ExperimentConfig, total_weight: float, x: str) -> LogisticRegression:
    m = cfg.model
    return LogisticRegression(
        featuresCol=x, labelCol="_label", weightCol="fit_weight", maxIter=m.max_iter, tol=m.tol,
        regParam=1.0 / (m.logistic_c * total_weight), standardization=False,
        probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y",
    )


def _boosted(cfg: ExperimentConfig, x: str, n_features: int, head: int) -> GBTClassifier:
    m = cfg.model
    share = max(1, round(m.colsample * n_features))
    return GBTClassifier(
        featuresCol=x, labelCol="_target", weightCol="fit_weight", maxIter=m.n_estimators, maxDepth=m.max_depth,
        stepSize=m.learning_rate, subsamplingRate=m.subsample, seed=m.random_seed,
        featureSubsetStrategy="all" if m.colsample >= 1 else str(share),
        minInstancesPerNode=max(1, math.ceil(m.min_child_weight)), cacheNodeIds=False,
    ).setProbabilityCol(f"_p{head}").setRawPredictionCol(f"_r{head}").setPredictionCol(f"_y{head}")


@dataclass
class Model:
    """A fitted pipeline: preparation, one multinomial or one boosted model per class, and their probabilities as columns."""

    pipeline: PipelineModel
    weight_stats: dict[str, float | None] = field(default_factory=dict)

    @property
    def classes(self) -> list[str]:
        return next(s for s in self.pipeline.stages if isinstance(s, ClassProbabilities)).getOrDefault("classes")

    @property
    def features(self) -> list[str]:
        return self.pipeline.stages[0].getInputCols()

    def score(self, rows: DataFrame) -> DataFrame:
        """Add y_pred, one probability per class and max_proba."""
        return self.pipeline.transform(rows)

    def predictions(self, rows: DataFrame) -> DataFrame:
        """The prediction table of scored rows with symbol, entry_time, session_date, split and y."""
        cols = [proba_column(c) for c in self.classes]
        return self.score(rows).select(
            "symbol", "entry_time", "session_date", "split", F.col("y").alias("y_true"), "y_pred", *cols, "max_proba"
        )

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Model:
        return cls(PipelineModel.load(path))


def label_index(classes: list[str], y: str = "y") -> Column:
    """Place of a class in the alphabetical list; null for a class that is not there."""
    return (F.array_position(F.array(*map(F.lit, classes)), F.col(y)) - 1).cast("double")


def weighted_rows(prepared: Prepared, cfg: ExperimentConfig) -> DataFrame:
    """Train rows with `_label` and `fit_weight`.

    A logistic model with class weights weighs them twice by default, in the estimator and as sample weights.
    """
    cw = cfg.model.class_weight
    unknown = sorted(set(cw) - set(prepared.classes)) if isinstance(cw, dict) else []
    if unknown:
        raise ValueError(f"class_weight names classes not in training: {unknown}")
    train = with_fit_weights(prepared.train, method=cfg.train.sample_weight_method, class_weight=cw)
    if cfg.model.double_class_weight and cfg.model.type == "logistic_regression":
        train = train.withColumn("fit_weight", F.col("fit_weight") * F.col("class_weight"))
    return train.withColumn("_label", label_index(prepared.classes))


def fit(prepared: Prepared, cfg: ExperimentConfig) -> Model:
    """Fit on train rows only; scaling is fitted with the model."""
    train = weighted_rows(prepared, cfg)
    stages, x = _preparation(cfg, prepared.train, prepared.features)
    prep = Pipeline(stages=stages).fit(train)
    ready = prep.transform(train).select(x, "_label", "fit_weight").persist()
    try:
        s = weight_summary(ready).select("*").first()
        total = ready.agg(F.sum("fit_weight")).first()[0]
        if cfg.model.type == "logistic_regression":
            heads: list[Transformer] = [_logistic(cfg, total, x).fit(ready)]
        else:
            def one(i: int) -> Transformer:
                target = ready.withColumn("_target", (F.col("_label") == i).cast("double"))
                return _boosted(cfg, x, len(prepared.features), i).fit(target)

            with ThreadPoolExecutor(PARALLEL_FITS) as pool:
                heads = list(pool.map(one, range(len(prepared.classes))))
    finally:
        ready.unpersist()
    weighted = cfg.train.sample_weight_method != "none" or cfg.model.class_weight is not None
    stats = s.asDict() if weighted else {"sample_weight_mean": None, "sample_weight_min": None}
    vectors = ["_p"] if len(heads) == 1 else [f"_p{i}" for i in range(len(heads))]
    return Model(PipelineModel([*prep.stages, *heads, ClassProbabilities(prepared.classes, vectors)]), stats)


def logistic_gradient(model: Model, prepared: Prepared, cfg: ExperimentConfig) -> float:
    """Largest entry of the penalised loss's gradient at the fitted coefficients: 0 at the optimum.

    One aggregation over the train rows; its size is classes x features, whatever the rows.
    """
    *prep, head, _ = model.pipeline.stages
    x = "_x" if len(prep) > 1 else "_raw"
    rows = PipelineModel(prep).transform(weighted_rows(prepared, cfg))
    rows = head.transform(rows).select("fit_weight", "_label", vector_to_array(x).alias("x"), vector_to_array("_p").alias("p"))
    k, m = len(prepared.classes), len(prepared.features)
    off = [F.col("fit_weight") * (F.col("p")[i] - (F.col("_label") == i).cast("double")) for i in range(k)]
    sums = [F.sum(o * F.col("x")[j]) for o in off for j in range(m)] + [F.sum(o) for o in off]
    got = rows.agg(F.sum("fit_weight").alias("w"), F.array(*sums).alias("s")).first()
    coefficients = head.coefficientMatrix.toArray()
    binary = coefficients.shape[0] == 1  # one row stands for the second class against the first
    penalty = 1.0 / (cfg.model.logistic_c * got.w)
    worst = 0.0
    for i in [1] if binary else range(k):
        beta = coefficients[0 if binary else i]
        worst = max(worst, *[abs(got.s[i * m + j] / got.w + penalty * beta[j]) for j in range(m)], abs(got.s[k * m + i] / got.w))
    return worst


@dataclass
class TrainResult:
    run_id: str
    model: Model
    predictions: DataFrame
    report: DataFrame
    metrics: dict[str, Any]


def train(matrix: DataFrame, cfg: ExperimentConfig, *, data: Prepared | None = None) -> TrainResult:
    """Fit, score both splits and measure; only one row of metrics per split reaches the driver."""
    data = data or prepare(matrix, cfg)
    model = fit(data, cfg)
    scored = model.predictions(data.rows)
    quality = {r["split"]: r for r in f1_scores(scored, ["split"]).collect()}
    metrics: dict[str, Any] = {
        "model_type": cfg.model.type, "train_n": data.n("train"), "val_n": data.n("val"),
        "classes": data.classes, "preprocess_scaler": cfg.scaler,
        "sample_weight_method": cfg.train.sample_weight_method, **model.weight_stats,
    }
    for s, r in quality.items():
        metrics |= {f"{s}_accuracy": r["accuracy"], f"{s}_f1_macro": r["f1_macro"], f"{s}_f1_weighted": r["f1_weighted"]}
    report = classification_report(scored.where(F.col("split") == "val"), ["split"], classes=data.classes).drop("split")
    return TrainResult(new_run_id(), model, scored, report, metrics)


def log_record(result: TrainResult, cfg: ExperimentConfig) -> dict[str, Any]:
    """What a run leaves in the run log."""
    m, t = result.metrics, cfg.train
    keys = (
        "train_n", "val_n", "val_accuracy", "train_accuracy", "val_f1_macro", "val_f1_weighted",
        "train_f1_macro", "train_f1_weighted", "model_type", "preprocess_scaler", "sample_weight_method",
        "sample_weight_mean", "sample_weight_min", "classes",
    )
    boosted = cfg.model.type == "boosted_trees"
    return {
        "run_id": result.run_id,
        "symbol": (cfg.symbol or "ALL").upper(),
        **{k: m.get(k) for k in keys},
        "class_weight": cfg.model.class_weight,
        "learning_rate": cfg.model.learning_rate if boosted else None,
        "n_estimators": cfg.model.n_estimators if boosted else None,
        "max_depth": cfg.model.max_depth if boosted else None,
        "solver": None if boosted else "l-bfgs",
        "logistic_c": None if boosted else cfg.model.logistic_c,
        "min_train_rows": t.min_train_rows,
        "min_val_rows": t.min_val_rows,
        "drop_val_unseen_classes": t.drop_val_unseen_classes,
        "export_predictions": t.export_predictions,
        "label_entry_stride": cfg.label_entry_stride,
        "train_experiment_name": t.experiment_name,
        "train_notes": t.notes,
        "features": dataclasses.asdict(cfg.features),
        "experiment_config": dataclasses.asdict(cfg),
    }
