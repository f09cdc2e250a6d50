"""Decontamination against alignments of every document with every item."""

from __future__ import annotations

import random

import numpy as np
import pytest

from barwright.llm import decontaminate
from barwright.llm.words import Words

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def numbered(stem: str, n: int) -> list[str]:
    return [f"{stem}{k}" for k in range(n)]


def test_edited_copies_are_found_beside_a_verbatim_one(spark):
    rnd = random.Random(3)
    item = numbered("w", 40)
    edited = [w if k < 14 or k % 4 else f"x{k}" for k, w in enumerate(item)]
    rows = [(0, " ".join([*numbered("a", 60), *item, *numbered("b", 60)]))]
    for d in range(1, 61):
        rows.append((d, " ".join([f"s{rnd.randint(0, 10**9)}" for _ in range(60)] + edited + [f"s{rnd.randint(0, 10**9)}" for _ in range(60)])))
    got = decontaminate.contaminated(
        spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(7, " ".join(item))], ITEMS)
    ).collect()
    assert {r.doc_id for r in got} == set(range(61))


def changed(rnd: random.Random, words: list[str], share: float) -> list[str]:
    """Words replaced, left out, or with a strange word put behind them."""
    out = []
    for w in words:
        how = rnd.choice("rdi") if rnd.random() < share else ""
        out += {"": [w], "r": [f"n{rnd.randint(0, 10**6)}"], "d": [], "i": [w, f"n{rnd.randint(0, 10**6)}"]}[how]
    return out


def hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)])).hash


def best_scores(docs: list[tuple[int, str]], items: list[tuple[int, str]], threshold: float) -> dict[tuple[int, int], float]:
    out: dict[tuple[int, int], float] = {}
    for d, text in docs:
        for i, item in items:
            words = hashes(item)
            if len(words) and text:
                score = decontaminate.align(hashes(text), words)[0] / (decontaminate.MATCH * len(words))
                if score >= threshold:
                    out[d, i] = max(score, out.get((d, i), 0.0))
    return out


def edited_corpus(rnd: random.Random) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    usual = numbered("u", 400)
    items, docs = [], []
    for i, n in enumerate([1, 2, 3, 4, 5, 8, 16, 16, 20, 30, 40, 90]):
        items.append((i, " ".join(rnd.choice(usual) for _ in range(n))))
    template = [rnd.choice(usual) for _ in range(18)]
    items += [(20 + k, " ".join([*template, f"t{k}", *template[:3]])) for k in range(20)]
    items.append((6, " ".join(rnd.choice(usual) for _ in range(12))))
    d = 0
    for _, text in items:
        for share in (0.0, 0.2, 0.3, 0.4):
            body = changed(rnd, text.split(), share)
            docs.append((d, " ".join([*rnd.choices(usual, k=rnd.randint(0, 90)), *body, *rnd.choices(usual, k=rnd.randint(0, 90))])))
            d += 1
    docs.append((d, " ".join(w for x in items[9][1].split() for w in (x, "between"))))
    docs.append((d + 1, " ".join(w if k % 5 else "fifth" for k, w in enumerate(items[9][1].split()))))
    docs.append((d + 2, ""))
    return docs, items


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_equal_to_aligning_everything(spark, monkeypatch, threshold):
    docs, items = edited_corpus(random.Random(11))
    want = best_scores(docs, items, threshold)
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 300)
    monkeypatch.setattr(decontaminate, "COMMON", 4)
    out = decontaminate.contaminated(
        spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([*items, (99, None), (98, " ")], ITEMS), threshold=threshold
    )
    got: dict[tuple[int, int], float] = {}
    for r in out.collect():
        got[r.doc_id, r.item_id] = max(r.score, got.get((r.doc_id, r.item_id), 0.0))
    assert got == want


def test_no_copy_is_lost_whatever_the_edits():
    rnd = random.Random(12)
    for _ in range(3):
        docs, items = edited_corpus(rnd)
        # one id of two texts is left to the test above
        items = items[:-1]
        index = decontaminate.Index([i for i, _ in items], [t for _, t in items], 0.5)
        finder = decontaminate.Finder(index)
        got: dict[tuple[int, int], float] = {}
        for d, text in docs:
            raw = np.frombuffer(text.encode(), np.uint8)
            for _, i, score, _, _ in finder.rows(Words(raw, np.array([0, len(raw)]))):
                got[d, i] = max(score, got.get((d, i), 0.0))
        assert got == best_scores(docs, items, 0.5)
