"""Pipeline stages between the models: a fitted primary and meta model are one `PipelineModel` that can be stored."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.expr import finite

#: what the meta model reads of a prediction (fixed values)
META_COLUMNS = ("proba_stop_loss", "proba_take_profit", "proba_vertical", "max_proba")


def proba_column(cls: str) -> str:
    safe = "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in cls)
    return "proba_" + "_".join(safe.split()).strip("_")


class FiniteVector(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The columns as one vector of finite numbers; a null is an error.

    Models cannot be fitted on infinities and NaN, which prices of zero lead to: an infinity counts as the largest or least
    finite training value of its column, NaN as the middle one. Finite values pass unchanged.
    """

    least = Param(Params._dummy(), "least", "what stands for -inf, by column", TypeConverters.toListFloat)
    middle = Param(Params._dummy(), "middle", "what stands for NaN, by column", TypeConverters.toListFloat)
    most = Param(Params._dummy(), "most", "what stands for inf, by column", TypeConverters.toListFloat)

    @classmethod
    def of(cls, train: DataFrame, columns: list[str], output: str) -> FiniteVector:
        """The stage with the bounds and medians of the train rows: one aggregate, three numbers a column."""
        kinds = {"least": F.min, "middle": lambda c: F.percentile_approx(c, 0.5), "most": F.max}
        got = train.agg(*[f(finite(F.col(f"`{c}`"))).alias(f"{k}{i}") for k, f in kinds.items() for i, c in enumerate(columns)]).first()
        values = {k: [got[f"{k}{i}"] or 0.0 for i in range(len(columns))] for k in kinds}
        return cls()._set(inputCols=columns, outputCol=output, **values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        least, middle, most = (self.getOrDefault(k) for k in ("least", "middle", "most"))
        inf, columns = float("inf"), {}
        for i, name in enumerate(self.getInputCols()):
            c = F.col(f"`{name}`").cast("double")
            columns[f"_finite{i}"] = F.when(F.isnan(c), middle[i]).when(c == inf, most[i]).when(c == -inf, least[i]).otherwise(c)
        assembler = VectorAssembler(inputCols=list(columns), outputCol=self.getOutputCol(), handleInvalid="error")
        return assembler.transform(dataset.withColumns(columns)).drop(*columns)


class ClassProbabilities(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """One probability per class, max_proba and y_pred, from one multinomial vector or one binary vector per class.

    Probabilities of binary models are normalised. Columns that begin with an underscore are the models' own and go.
    """

    classes = Param(Params._dummy(), "classes", "class names, in label order", TypeConverters.toListString)
    vectors = Param(Params._dummy(), "vectors", "columns of the models' probabilities", TypeConverters.toListString)

    def __init__(self, classes: list[str] | None = None, vectors: list[str] | None = None):
        super().__init__()
        if classes is not None:
            self._set(classes=classes, vectors=vectors)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes, vectors = self.getOrDefault("classes"), self.getOrDefault("vectors")
        if len(vectors) == 1:
            d = dataset.withColumn("_probs", vector_to_array(vectors[0]))
        else:
            parts = [vector_to_array(v)[1] for v in vectors]
            total = sum(parts[1:], parts[0])
            d = dataset.withColumn("_probs", F.array(*[F.try_divide(p, total) for p in parts]))
        d = d.withColumns({proba_column(c): F.col("_probs")[i] for i, c in enumerate(classes)} | {"max_proba": F.array_max("_probs")})
        names = F.array(*map(F.lit, classes))
        d = d.withColumn("y_pred", F.element_at(names, F.array_position("_probs", F.col("max_proba")).cast("int")))
        return d.drop(*[c for c in d.columns if c.startswith("_")])


def with_meta_features(predictions: DataFrame) -> DataFrame:
    """The four probability columns; a class unknown to the primary model has probability 0."""
    proba = [c for c in predictions.columns if c.startswith("proba_")]
    d = predictions
    if "max_proba" not in d.columns:
        d = d.withColumn("max_proba", F.greatest(*proba) if len(proba) > 1 else F.col(proba[0]))
    return d.withColumns({c: F.lit(0.0) for c in META_COLUMNS if c not in d.columns})


class MetaFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the probability columns that the meta model reads."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_meta_features(dataset)


class MetaProbability(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """`meta_proba` from the meta model's vector; the thresholds it was trained for travel with it."""

    threshold = Param(Params._dummy(), "threshold", "gate on proba_take_profit", TypeConverters.toFloat)
    act = Param(Params._dummy(), "act", "least meta_proba to act on", TypeConverters.toFloat)

    def __init__(self, threshold: float | None = None, act: float | None = None):
        super().__init__()
        if threshold is not None:
            self._set(threshold=threshold, act=act)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("meta_proba", vector_to_array("_mp")[1]).drop("_mx", "_mp", "_mr", "_my")
