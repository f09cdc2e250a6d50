"""The near-copy stage looks at each text in one Python task at a time, in batches of bounded bytes."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from barwright.llm import ngram_join
from barwright.llm.tables import read, written
from tests.llm.test_pipeline import folder, kept, prose, rows  # noqa: F401


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_wanted_texts_are_picked_in_one_python_task(spark, folder, monkeypatch):  # noqa: F811
    plans: dict[str, list[str]] = {}

    def spy(df, name):
        plans.setdefault(name, []).append(plan_of(df))
        return written(df, name)

    monkeypatch.setattr(ngram_join, "written", spy)
    ngram_join.similar_components(read(spark, folder, "documents"))
    assert plans["texts"]
    for plan in plans["texts"]:
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_near_copies_passes_texts_through_python_once(spark, folder):  # noqa: F811
    plan = plan_of(corpus_pipeline.near_copies(spark, read(spark, folder, "documents"), folder))
    assert plan.count("MapInArrow") == 2 and "EvalPython" not in plan  # rows no key names, rows that one may name


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [prose(rnd, 60) for _ in range(30)]
    texts += [t + " tail" for t in texts[:10]] + texts[5:8] + ["", "two words", "two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def found() -> Counter:
        return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect())

    want = found()
    assert sum(i != c for i, _, c in want) == 14
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 8)
    assert found() == want


def test_stages_send_batches_of_bounded_bytes(spark, folder):  # noqa: F811
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = read(spark, folder, "documents")
    assert kept(corpus_pipeline.STAGES[1][1](spark, docs, folder)) == kept(corpus_pipeline.near_copies(spark, docs, folder))
    assert int(spark.conf.get(name)) == corpus_pipeline.BATCH_BYTES
    spark.conf.unset(name)
