"""Importance resampling against the plain formulas, n-gram by n-gram."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from barwright.llm import resample

SCHEMA = "doc_id long, text string, weight string, rank int, n_words string, source string"


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [crc32(g.encode()) % 10000 for g in runs]


def brute(rows, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, found = grams(text)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    vocabulary = ["Alpha", "beta", "gamma-ray", "DÖNER", "x1", "中文", "naïve,", "a", "İstanbul", "under_score", "tab\tbed", "ŝ"]
    out = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    out += [(200, None), (201, ""), (202, " .,;\n"), (None, out[5][1] * 3), (None, None), (7, out[7][1]), (7, "beta " * 30)]
    out += [(300, "long " * 3000 + "word" * 2000 + " tail"), (301, "w" * 70000 + " " + "v" * 300 + " u " * 50), (302, "\x00a\x7fb\x00" * 30)]
    return out


TARGET = ["Alpha beta gamma-ray beta alpha", None, "", "中文 naïve x1 x1 x1", "long long long"]


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "w", 1, "n", "s") for i, t in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")


@pytest.mark.parametrize("limit", [1 << 21, 700])
def test_equals_brute_force(spark, rows, limit):
    """Also with slices so short that most texts are read in pieces."""
    docs, target = frames(spark, rows)
    got = resample.importance_draw(docs, target, percent=20, limit=limit).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, TARGET, percent=20)


def test_equal_scores_are_drawn_by_doc_id(spark):
    rows = [(5, "same words " * 15)] * 40 + [(4, "few")]
    docs, target = frames(spark, rows)
    got = resample.importance_draw(docs, target, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))
    assert all(r["rank"] is None for r in got if r.doc_id == 4)


def test_empty_tables(spark, rows):
    docs, target = frames(spark, [])
    assert resample.importance_draw(docs, target).count() == 0
    docs, target = frames(spark, rows[:30])
    got = resample.importance_draw(docs, target.where("false"), percent=100).collect()
    want = brute(rows[:30], [], percent=100)
    assert sorted(map(tuple, got), key=repr) == want


def test_columns_are_carried(spark, rows):
    docs, target = frames(spark, rows)
    got = resample.importance_draw(docs, target, carry=("text", "source"))
    assert got.columns[:3] == ["doc_id", "text", "source"]
    texts = dict(r for r in rows if r[0] is not None and r[0] != 7)
    assert all(r.text == texts[r.doc_id] for r in got.collect() if r.doc_id in texts)
    with pytest.raises(ValueError):
        resample.importance_draw(docs, target, carry=("rank",))


def test_sums_of_joined_bytes():
    rnd = random.Random(1)
    for n in [0, 1, 255, 256, 257, 1000, 70000, 123456]:
        a, b = rnd.randbytes(20), rnd.randbytes(n)
        moved = resample.zero_bytes().shift(np.array([crc32(a)], np.int64), np.array([n]))
        assert int(moved[0]) ^ crc32(b) == crc32(a + b)


def test_pieces_share_words_not_features():
    text = b"one two three four five six seven " * 40
    total = Counter()
    for part, shared in resample.pieces(text, 3, 50):
        assert len(part) < 120
        for _, f in [resample.features([part], 3, 10000)]:
            total.update(int(x) for b, _ in f for x in b)
        if shared:
            total.subtract(int(x) for b, _ in resample.features([shared], 3, 10000)[1] for x in b)
    assert +total == Counter(grams(text.decode())[1])
