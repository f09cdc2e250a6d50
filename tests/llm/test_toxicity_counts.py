"""What the toxicity models read from the corpus and from the classes."""

from __future__ import annotations

import random

import numpy as np

from barwright.llm import toxicity
from tests.llm.test_text_operators import prose


def model_of(spark, rows: list[tuple[int, str]], classes: list[tuple[int, int]]) -> toxicity.Model:
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(classes, "doc_id long, toxic int")
    return toxicity.Model(toxicity.gram_table(toxicity.word_table(docs, marks)))


def test_unlabelled_documents_count(spark):
    rnd = random.Random(4)
    labelled = [(i, prose(rnd, 30)) for i in range(20)]
    classes = [(i, i % 2) for i in range(20)]
    more = [(100 + i, f"{a}vexqu{b}") for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "abcdefgh")]
    without = model_of(spark, labelled, classes).word_logs([b"vexqu"])[0]
    with_more = model_of(spark, labelled + more, classes).word_logs([b"vexqu"])[0]
    assert (with_more - without > 15.0).all()


def test_counts_are_exact():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 51, 300_000))
    table = toxicity.Table(keys, np.stack([keys % 1000 + 1, keys % 7], axis=1))
    strange = np.setdiff1d(rng.integers(0, 1 << 51, 300_000), keys)
    assert (table.values[table.rows(keys)][:, 0] == keys % 1000 + 1).all()
    assert not table.values[table.rows(strange)].any()
    empty = toxicity.Table(keys[:0], np.zeros((0, 2)))
    assert not empty.values[empty.rows(keys)].any()


def plain_log(word: bytes, rows: list[tuple[bytes, int, int, int]]) -> tuple[float, float]:
    """Kneser-Ney by dictionaries over word counts (word, toxic, plain, whole)."""
    counts: list[dict[bytes, np.ndarray]] = [{} for _ in range(toxicity.ORDER + 1)]
    for k in range(toxicity.ORDER, 0, -1):
        for w, *n in rows:
            x = b" " + w + b" "
            for i in range(1, len(x)):
                if i >= k - 1 and (k == toxicity.ORDER or i == k - 1):
                    g = x[i - k + 1 : i + 1]
                    counts[k][g] = counts[k].get(g, np.zeros(3)) + n
        if k < toxicity.ORDER:
            for g, n in counts[k + 1].items():
                counts[k][g[1:]] = counts[k].get(g[1:], np.zeros(3)) + (n > 0)
    x, out = b" " + word + b" ", [0.0, 0.0]
    for i in range(1, len(x)):
        p = [1 / 256, 1 / 256]
        for k in range(1, min(toxicity.ORDER, i + 1) + 1):
            g = x[i - k + 1 : i + 1]
            seen = [n for h, n in counts[k].items() if h[:-1] == g[:-1]]
            for j in range(2):
                col = 2 if k <= toxicity.SHARED else j
                total = sum(n[col] for n in seen)
                if total:
                    kinds = sum(n[col] > 0 for n in seen)
                    c = counts[k].get(g, np.zeros(3))[col]
                    p[j] = min(1.0, max(1e-12, (max(c - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * kinds * p[j]) / total))
        out = [o + float(np.log(q)) for o, q in zip(out, p, strict=True)]
    return out[0], out[1]


def test_model_equals_plain_counts(spark):
    rnd = random.Random(6)
    docs = [(i, prose(rnd, 12)) for i in range(12)]
    counts: dict[bytes, list[int]] = {}
    for i, text in docs:
        for w in text.encode().split():
            n = counts.setdefault(w, [0, 0, 0])
            n[2] += 1
            if i < 8:
                n[i % 2] += 1
    model = model_of(spark, docs, [(i, 1 - i % 2) for i in range(8)])
    words = [*list(counts)[:30], b"lonazz", b"z", "é".encode()]
    want = [plain_log(w, [(k, *n) for k, n in counts.items()]) for w in words]
    assert np.allclose(model.word_logs(words), want, rtol=1e-5)
