"""Text operators against brute force on small tables, with nulls, empty texts, copies and clashing column names."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import decontaminate, mixing, ngram_join, quality, repeats, sharding, toxicity
from barwright.llm.words import U

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, score double"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(["lo", "mi", "ra", "ten", "vo"]) + rnd.choice(["na", "su", "ki", "por"]) + str(rnd.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [prose(rnd, rnd.randint(1, 120)) for _ in range(30)]
    common = prose(rnd, 60)
    out = [*base, None, "", "  \n", base[3], base[3], "é" * 300, "ab" * 400]
    for k in range(12):
        words = base[k].split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
        out.append(base[k][:80] + " " + common + " " + base[-k - 1][:50])
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 0, "clash", 0.5) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_repeats_equal_brute_force(docs, texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(r[k : k + 200] for r in raw.values() for k in range(len(r) - 199))
    got = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert got.keys() == raw.keys()
    for i, r in raw.items():
        cut = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                cut[k : k + 200] = True
        kept = bytes(c for c, gone in zip(r, cut, strict=True) if not gone)
        spans = sum(bool(cut[k]) and (k == 0 or not cut[k - 1]) for k in range(len(r)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(r), cut.sum(), spans, kept)


def test_cover_meets_at_every_shift():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def shingles(text: str | None, k: int) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("gram", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(docs, texts, gram, percent):
    sets = {i: shingles(t, gram) for i, t in texts.items()}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs, gram=gram, percent=percent).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def plain_alignment(a, b) -> int:
    s = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s[i, j] = max(0, s[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1, j] - 1, s[i, j - 1] - 1)
    return int(s.max())


def test_alignment_equals_the_full_table():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        a, b = rnd.integers(0, 5, rnd.integers(0, 30)).astype(U), rnd.integers(0, 5, rnd.integers(0, 20)).astype(U)
        assert decontaminate.align(a, b)[0] == plain_alignment(a, b)


def test_decontamination_finds_exact_and_edited_items(spark, docs):
    rnd = random.Random(9)
    items = [prose(rnd, 40) for _ in range(4)]
    edited = items[1].split()
    for k in (3, 11, 19, 27, 35):
        edited[k] = "other"
    extra = [(1000, prose(rnd, 70) + " " + items[0] + " " + prose(rnd, 70)), (1001, " ".join(edited).upper()), (1002, prose(rnd, 90))]
    more = spark.createDataFrame([(i, t, "en", "s", 0, "x", 0.0) for i, t in extra], SCHEMA)
    table = spark.createDataFrame([*enumerate(items), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs.unionByName(more), table).collect()}
    assert got.keys() == {(1000, 0), (1001, 1)}
    assert (got[1000, 0].first_word, got[1000, 0].last_word, got[1000, 0].score) == (70, 109, 1.0)


def test_toxicity_learns_unseen_forms(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        words = prose(rnd, 40).split()
        if i % 4 == 0:
            words[5], words[20] = "zorgh" + rnd.choice("abcdefgh") + str(i), "ZORGH" + str(i)
        rows.append((i, " ".join(words), "en", "s", 0, "x", 0.0))
    d = spark.createDataFrame([*rows, (900, None, None, None, None, None, None), (901, "", "", "", 0, "", 0.0)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(300)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(d, labels).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].predicted == int(i % 4 == 0) for i in range(300, 400)) >= 97
    assert got[900].score == got[901].score


def test_quality_rules(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(w + ("%%%" if i % 3 == 0 else "") for w in prose(rnd, 30).split()), "en", "s", 0, "x", 0.0) for i in range(240)]
    d = spark.createDataFrame([*rows, (900, None, None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(i % 3 > 0)) for i in range(180)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(d, labels, trees=5).collect()}
    assert len(got) == 241 and all(got[i].predicted == int(i % 3 > 0) for i in range(240))


def test_shards_move_only_to_the_new_one(docs):
    got = sharding.shard_documents(docs.unionByName(docs), [1.0] * 6).collect()
    assert all(r.grown_shard in (r.shard, 6) for r in got)
    for k in range(6):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))


def test_mixing_meets_targets(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, rnd.randint(5, 60)).replace(" ", " | " if i % 3 == 0 else " ")) for i in range(120)]
    d = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = d.where("doc_id < 60").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("domain"))
    got = mixing.mixed(d, labels, {"a": 0.7, "b": 0.3})
    a, b = got.agg(F.sum(F.expr("rate * tokens * p0")), F.sum(F.expr("rate * tokens * p1"))).first()
    assert got.count() == 122 and a / (a + b) == pytest.approx(0.7, abs=1e-3)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        repeats.without_repeats(none), ngram_join.similar_components(none), decontaminate.contaminated(none, items),
        decontaminate.contaminated(docs, items), toxicity.toxicity_scores(none, labels), quality.quality_scores(none, labels),
        sharding.shard_documents(none, [1.0]), mixing.mixed(none, labels.select("doc_id", F.lit("a").alias("domain")), {"a": 1.0}),
    ):
        assert out.count() == 0


