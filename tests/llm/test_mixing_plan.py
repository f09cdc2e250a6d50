"""The mixing stage is made of DataFrame functions; slices stay small."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from barwright.llm import mixing, words
from barwright.llm.queries import TARGETS, quality_domains
from barwright.llm.tables import read
from tests.llm.test_pipeline import folder, rows  # noqa: F401


def test_mixing_runs_no_python_on_executors(spark, folder):  # noqa: F811
    plan = corpus_pipeline.mix(spark, read(spark, folder, "documents"), folder)._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups") if n in plan]


def test_mixing_leaves_texts_where_they_are(spark, folder):  # noqa: F811
    docs = read(spark, folder, "documents")
    plan = corpus_pipeline.mix(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rates_of_rows_in_place_are_those_of_the_table(spark, folder):  # noqa: F811
    docs = read(spark, folder, "documents")
    labelled = quality_domains(docs, read(spark, folder, "labels"))
    for floor, budget in ((0.0, None), (1.0, None), (0.0, 900.0)):
        rates = mixing.mixed(docs, labelled, TARGETS, floor=floor, budget=budget).collect()
        want: Counter = Counter()
        for r in rates:
            want[(r.doc_id, r.text_key)] += r.copies
        got = mixing.repeated(docs, labelled, TARGETS, floor=floor, budget=budget)
        assert got.columns == docs.columns
        key = F.xxhash64(F.coalesce("text", F.lit("")))
        assert Counter((r.doc_id, r.k) for r in got.select("doc_id", key.alias("k")).collect()) == +want
        assert len(rates) == docs.count()


def test_powers_kept_by_a_worker_are_small():
    words.powers(10)
    assert sum(p.nbytes for p in words._powers) < 1 << 24


def test_stages_send_small_batches(spark, folder):  # noqa: F811
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    corpus_pipeline.STAGES[-1][1](spark, read(spark, folder, "documents"), folder)
    assert int(spark.conf.get(name)) == corpus_pipeline.BATCH_ROWS
    spark.conf.unset(name)
