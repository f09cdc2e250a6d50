"""The corpus pipeline, stage by stage, on rows with nulls, repeated ids and clashing columns."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barwright.llm import decontaminate, mixing, rows as R, toxicity
from barwright.llm.queries import TARGETS, quality_domains
from barwright.llm.tables import read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, copy string, row string, text_key int, place string"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(["lo", "mi", "ra", "ten", "vo"]) + rnd.choice(["na", "su", "ki", "por"]) + str(rnd.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    texts = [prose(rnd, rnd.randint(30, 90)) for _ in range(40)]
    vile = ["vlorg grubbit " * 4 + prose(rnd, 20) for _ in range(10)]
    item = prose(rnd, 40)
    out = [(i, t) for i, t in enumerate(texts + vile)]
    out += [(60, texts[3]), (61, texts[3] + " tail"), (62, texts[3]), (3, texts[3]), (3, texts[3]), (4, "a text of its own under a taken id " + prose(rnd, 20))]
    out += [(62, prose(rnd, 50)), (None, prose(rnd, 40)), (None, texts[5]), (None, None), (70, None), (71, ""), (71, ""), (72, "two words")]
    out += [(80, prose(rnd, 10) + " " + item + " " + prose(rnd, 10)), (None, item), (80, prose(rnd, 30)), (81, "vlorg grubbit " * 8)]
    return out, item


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """The tables that the stages read; half of the ids are labelled."""
    root, (docs, item) = tmp_path_factory.mktemp("tables"), rows
    vile = {i for i, t in docs if t and "vlorg" in t}
    marks = [(i, i % 2, int(i in vile)) for i in range(0, 81) if i % 7]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    langs = ["en", "de", "fr", "es"]
    table = spark.createDataFrame([(i, t, langs[k % 4], "s", 0, 7, "x", "y", 5, "z") for k, (i, t) in enumerate(docs)], SCHEMA)
    table.repartition(3).write.parquet(str(root / "documents.parquet"))
    return str(root)


def kept(df) -> Counter:
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_without_takes_rows_by_id_and_text(spark, folder):
    docs = read(spark, folder, "documents")
    gone = docs.where("doc_id = 62 OR doc_id IS NULL AND text IS NULL").where("text IS NULL OR text LIKE '%' AND length(text) < 100000")
    gone = gone.limit(2).select("doc_id", R.text_key(F.col("text")).alias("text_key"))
    names = {(r.doc_id, r.text_key) for r in gone.collect()}
    keyed = docs.select("doc_id", "text", R.text_key(F.col("text")).alias("k")).collect()
    want = Counter((r.doc_id, r.text) for r in keyed if (r.doc_id, r.k) not in names)
    got = R.without(docs, spark.createDataFrame(sorted(names, key=repr), "doc_id long, text_key long"))
    assert kept(got) == want and got.columns == docs.columns


def test_a_full_bitmap_changes_nothing(spark, folder, monkeypatch):
    monkeypatch.setattr(R, "BITS", 1 << 15)
    docs = read(spark, folder, "documents")
    others, maybe = R.may_be(docs, docs.select("doc_id", R.text_key(F.col("text")).alias("text_key")))
    assert others.count() == 0 and kept(maybe) == kept(docs)
    assert kept(R.without(docs, docs.limit(0).select("doc_id", F.lit(1).cast("long").alias("text_key")))) == kept(docs)


def test_toxic_rows_go_whatever_their_id(spark, folder):
    docs = read(spark, folder, "documents")
    got = corpus_pipeline.toxic(spark, docs, folder)
    assert got.columns == docs.columns
    scores = toxicity.toxicity_scores(docs, read(spark, folder, "labels"))
    bad = {(r.doc_id, r.text_key) for r in scores.where("predicted = 1").collect()}
    keyed = docs.select("doc_id", "text", R.text_key(F.col("text")).alias("k")).collect()
    assert kept(got) == Counter((r.doc_id, r.text) for r in keyed if (r.doc_id, r.k) not in bad)
    assert bad and not any("vlorg" in (t or "") for _, t in kept(got))


def shingles(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_one_row_of_each_group_stays(spark, folder, rows):
    docs = read(spark, folder, "documents")
    got = kept(corpus_pipeline.near_copies(spark, docs, folder))
    texts = {t for _, t in rows[0]}
    sets = {t: shingles(t) for t in texts}
    group = {t: t for t in texts}

    def root(t):
        while group[t] != t:
            t = group[t]
        return t

    for a in texts:
        for b in texts:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    by_group: dict = {}
    for i, t in rows[0]:
        by_group.setdefault(root(t), []).append((i, t))
    for members in by_group.values():
        here = Counter({r: got[r] for r in set(members)})
        named = {r for r in members if r[0] is not None}
        if not sets[members[0][1]]:
            assert all(here[r] == 1 for r in set(members))
        else:
            least = min((i for i, _ in named), default=None)
            assert sum(here[r] for r in named) == (1 if named else 0)
            assert all(here[r] == 1 for r in set(members) - named)
            assert all(r[0] == least for r in named if here[r])
    assert (4, next(t for i, t in rows[0] if i == 4 and t.startswith("a text of its own"))) in got
    assert any(i == 62 for i, _ in got), "the unique text under a copy's id stays"


def test_leaked_rows_go(spark, folder, rows):
    docs = read(spark, folder, "documents")
    got = kept(corpus_pipeline.leaked(spark, docs, folder))
    found = decontaminate.contaminated(docs, read(spark, folder, "benchmark")).select("doc_id").distinct().collect()
    assert {r.doc_id for r in found} == {80, None}
    assert got == Counter(r for r in rows[0] if not (r[1] and rows[1] in r[1]))


def test_mixing_repeats_rows_and_drops_none(spark, folder):
    docs = read(spark, folder, "documents")
    got = corpus_pipeline.mix(spark, docs, folder)
    assert got.columns == docs.columns
    rates = mixing.mixed(docs, quality_domains(docs, read(spark, folder, "labels")), TARGETS, floor=1.0)
    want: Counter = Counter()
    texts = {(r.doc_id, r.k): r.text for r in docs.select("doc_id", "text", R.text_key(F.col("text")).alias("k")).collect()}
    for r in rates.collect():
        want[(r.doc_id, texts[(r.doc_id, r.text_key)])] += r.copies
    assert kept(got) == want


def test_the_whole_pipeline_runs(spark, folder, rows):
    out = corpus_pipeline.run(spark, folder)
    got = out.collect()
    assert {"doc_id", "shard", "slot"} <= set(out.columns)
    assert len({(r.shard, r.slot) for r in got}) == len(got) > 0
    assert {r.doc_id for r in got} <= {i for i, _ in rows[0]}


def test_empty_documents(spark, folder):
    docs = read(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
