"""Quality by a sparse rule ensemble: tree paths over text statistics, weighted by a lasso logistic regression.

Random-forest trees are fitted on the statistics of a bounded sample of labelled rows (`sample` rows, the ones with the
smallest hash of the id). Every path from a root is a conjunctive rule; an L1-penalised logistic regression keeps few of
them. The score is one Spark expression over the statistics, so scoring all documents is a projection without shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.tables import written
from barwright.llm.trees import parse_trees, paths

#: Characters whose shares are statistics of their own
UPPER, DIGITS, STOPS, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?", "|!%$#&*@<>{}[]\\/_=+~^"


def share_of(text: Column, chars: str, n: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))) / n


def statistics(text: Column) -> list[Column]:
    """Numbers from the text alone, all finite; an empty text has zeros."""
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(F.translate(text, "\t\n\r", "   "), " +"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    m = F.greatest(F.size(words), F.lit(1)).cast("double")
    return [
        F.log1p(F.char_length(text).cast("double")),
        F.log1p(F.size(words).cast("double")),
        *(share_of(text, c, n) for c in (UPPER, DIGITS, STOPS, MARKS, "|", "!", "%$#&*", "\n")),
        (F.octet_length(text) - F.char_length(text)) / n,
        n / m,
        F.size(F.array_distinct(words)) / m,
        F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)).cast("double"),
    ]


def rules_of(trees: list) -> list[tuple]:
    """Different rules of all trees, each a sorted conjunction of (feature, threshold, at most?)."""
    return sorted({tuple(sorted(set(p))) for t in trees for p in paths(t)})


def holds(rule: tuple, x: Column) -> Column:
    """1.0 where the rule holds."""
    tests = [x[f] <= F.lit(t) if at_most else x[f] > F.lit(t) for f, t, at_most in rule]
    return reduce(lambda a, b: a & b, tests).cast("double")


def fit_rules(rows: DataFrame, *, trees: int, depth: int, penalty: float) -> tuple[list[tuple], list[float], float]:
    """rows: x (array), y (0 or 1). The rules with weights other than 0, their weights, and the constant."""
    width = len(statistics(F.lit("")))
    wide = rows.select(F.col("y").cast("double").alias("y"), "x", *(F.col("x")[k].alias(f"x{k}") for k in range(width)))
    d = VectorAssembler(inputCols=[f"x{k}" for k in range(width)], outputCol="v").transform(wide)
    forest = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=5).fit(d)
    rules = rules_of(parse_trees(forest.toDebugString))
    if not rules:
        return [], [], 0.0
    fires = wide.select("y", *(holds(r, F.col("x")).alias(f"r{k}") for k, r in enumerate(rules)))
    d = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="v").transform(fires).select("y", "v")
    lasso = LogisticRegression(featuresCol="v", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=False)
    model = lasso.fit(written(d, "rules"))
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w]
    return [r for r, _ in kept], [w for _, w in kept], float(model.intercept)


def quality_scores(docs: DataFrame, labelled: DataFrame, *, sample: int = 20_000, trees: int = 20, depth: int = 3,
                   penalty: float = 0.001) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5), for every row of docs.

    labelled: doc_id, quality (0 or 1); other values and null keys are left out, and of a repeated key one row counts, the
    better one. Null and empty texts are scored from statistics of zero. Without labels, or with one class only, every
    score is the share of good labels (0 without labels). Repeated rows get equal scores. Empty table: no rows.
    """
    stats = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(*statistics(F.coalesce("text", F.lit("")))).alias("x")),
        "statistics",
    )
    marks = labelled.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").alias("y")
    )
    marks = marks.orderBy(F.xxhash64(F.lit("rules"), "doc_id"), "doc_id").limit(sample)
    rows = written(stats.join(marks, "doc_id").select("x", "y"), "labelled")
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if good in (0, n):
        score = F.lit(good / n if n else 0.0)
    else:
        rules, weights, constant = fit_rules(rows, trees=trees, depth=depth, penalty=penalty)
        total = reduce(lambda a, b: a + b, (holds(r, F.col("x")) * F.lit(w) for r, w in zip(rules, weights, strict=True)), F.lit(constant))
        score = 1 / (1 + F.exp(-total))
    out = stats.select("doc_id", score.cast("double").alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
