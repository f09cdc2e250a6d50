"""Hard negatives against the plain definition, and the tables against matrix products."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barwright.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, block int, rank string, anchors long"


def brute(rows, every=5, positives=5, least=3):
    part = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for i, label, v in part:
        if i % every:
            continue
        same = sorted(((-score(v, w), j) for j, m, w in part if m == label and j != i))[:positives]
        for s, j in same:
            other = sorted((-score(v, w), k) for k, m, w in part if m != label)
            able = [(n, k) for n, k in other if 50 * -s <= 100 * -n <= 95 * -s][:least]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(able)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(4, 19)) * 0.4
    out = []
    for i in range(260):
        label = int(rnd.integers(0, 4))
        out.append((i, [float(x) for x in np.float32(centres[label] * rnd.choice([0.5, 1, 1]) + rnd.normal(size=19) * 0.5)], label))
    copy = out[10][1]
    out += [(1000 + k, copy, k % 3) for k in range(60)]  # ties by the dozen
    out += [(2000, None, 1), (2005, [float("nan")] * 19, 1), (2010, [float("inf")] + [0.0] * 18, 1), (2015, copy, None)]
    out += [(None, copy, 1), (2020, [None] + [0.0] * 18, 1), (2025, [], 2), (2030, [3.0, -4.0], 1), (2035, copy + [9.0] * 6, 0)]
    out += [(-5, copy, 2), (2040, [-x for x in copy], 3), (2045, [200.0] * 19, 1)]
    return out


def answer(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **more).collect()
    return sorted(map(tuple, got))


@pytest.mark.parametrize("size", [(2048, 1024), (37, 11)])
def test_equals_brute_force(spark, rows, size, monkeypatch):
    """In one block, and in so many that each anchor's answer comes from several."""
    monkeypatch.setattr(negatives, "CANDIDATES", size[0])
    monkeypatch.setattr(negatives, "ANCHORS", size[1])
    want = brute(rows)
    assert len(want) > 300
    assert answer(spark, rows) == want


def test_repeated_rows_count_one_by_one(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.8, 0.0], 1), (2, [0.8, 0.0], 1), (3, [0.7, 0.0], 1)]
    got = answer(spark, rows)
    one = [(5, 1, 1, 2, 58880, 52224), (5, 1, 2, 2, 58880, 52224), (5, 1, 3, 3, 58880, 45824)]
    assert got == sorted(one * 2)


def test_empty_tables_and_lonely_anchors(spark):
    assert answer(spark, []) == []
    assert answer(spark, [(1, [1.0], 0)]) == []
    assert answer(spark, [(5, [1.0], 0)]) == []
    assert answer(spark, [(5, [1.0], 0), (6, [1.0], 1)]) == []


def test_huge_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond 2\\*\\*40"):
        answer(spark, [(5, [1e30], 0), (6, [1.0], 0)])


def test_scores_equal_products():
    rnd = random.Random(2)
    for most, width in [(3, 8), (300, 64), (2**20, 24), (2**35, 16)]:
        a = np.array([[rnd.randint(-most, most) for _ in range(width)] for _ in range(9)])
        c = np.array([[rnd.randint(-most, most) for _ in range(width)] for _ in range(600)])
        bits = negatives.bit_planes(c)
        if most == 2**35:
            with pytest.raises(ValueError):
                negatives.number_kind(a, len(bits))
            continue
        sums = negatives.subset_sums(a, negatives.number_kind(a, len(bits)))
        assert (negatives.scores(bits, sums) == c @ a.T).all()
    zero = np.zeros((2, 8), np.int64)
    assert (negatives.scores(negatives.bit_planes(zero), negatives.subset_sums(zero, np.int32)) == 0).all()


def test_numbers_round_down():
    v = pa.array([[0.5, -0.001, -1.0], [], [1.0] * 9], pa.list_(pa.float64()))
    q = negatives.quantised(v, 256)
    assert q.shape == (3, 16) and q[0, :3].tolist() == [128, -1, -256] and not q[1].any() and q[2, 8] == 256


def test_first_of_equal_scores_wins():
    s = np.array([[5, 7, 7, 1]], np.int32)
    assert [(r.tolist(), c.tolist()) for r, c in negatives.best(s, 3)] == [([0], [1]), ([0], [2]), ([0], [0])]
