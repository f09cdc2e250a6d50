from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import positions, weights as W


def spans(spark, rows, symbol="A"):
    return spark.createDataFrame([(symbol, p, f, i) for i, (p, f) in enumerate(rows)], "symbol string, entry_pos bigint, bars_forward bigint, i int")


def values(df, name="uniqueness"):
    return [r[name] for r in df.orderBy("i").collect()]


def test_full_overlap_and_no_overlap(spark):
    assert values(W.uniqueness_weights(spans(spark, [(10, 5), (10, 5)]))) == [0.5, 0.5]
    assert values(W.uniqueness_weights(spans(spark, [(10, 3), (20, 3)]))) == [1.0, 1.0]


@pytest.mark.parametrize("chunk", [65536, 16])
def test_matches_counting_every_bar(spark, monkeypatch, chunk):
    monkeypatch.setattr(W, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    rows = [(int(p), int(f)) for p, f in zip(rng.integers(0, 300, 80), rng.integers(1, 60, 80))]
    c = np.zeros(400)
    for p, f in rows:
        c[p + 1 : p + f + 1] += 1
    want = [np.mean(1 / c[p + 1 : p + f + 1]) for p, f in rows]
    np.testing.assert_allclose(values(W.uniqueness_weights(spans(spark, rows))), want, rtol=1e-12)


def test_missing_position_weighs_one_and_short_span_fails(spark):
    d = spans(spark, [(1, 2), (5, 2)]).withColumn("entry_pos", F.when(F.col("i") == 0, F.col("entry_pos")))
    assert values(W.uniqueness_weights(d)) == [1.0, 1.0]
    with pytest.raises(Exception, match="bars_forward"):
        W.uniqueness_weights(spans(spark, [(1, 0)])).collect()
    with pytest.raises(Exception, match="lacks its label"):
        W.with_fit_weights(d.withColumn("y", F.lit("a")), method="uniqueness").collect()


def test_symbols_do_not_overlap_each_other(spark):
    d = spans(spark, [(10, 5)]).union(spans(spark, [(10, 5)], "B"))
    assert values(W.uniqueness_weights(d)) == [1.0, 1.0]


def test_class_weights(spark):
    d = spark.createDataFrame([("a",)] * 3 + [("b",)], "y string")
    got = {r["y"]: r["class_weight"] for r in W.balanced_class_weights(d).collect()}
    assert got == {"a": 4 / (2 * 3), "b": 4 / 2}
    s = W.weight_summary(W.with_fit_weights(d, class_weight={"b": 3.0})).first()
    assert tuple(s) == (1.5, 1.0)


def test_running_sums_do_not_depend_on_chunks(spark):
    d = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("p"), (F.col("id") * 2).alias("v"))
    for size in (7, 1000):
        got = positions.running_sums(d, ["k"], "p", {"v": "s"}, chunk_rows=size).orderBy("p").collect()
        assert [r["s"] for r in got] == list(np.cumsum(np.arange(100) * 2))
