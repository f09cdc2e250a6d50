"""A corpus pipeline over the text operators: each stage takes and returns documents, the last one their shards.

Decisions name a row by its doc_id and a hash of its text (`llm.rows`): rows that share a doc_id are judged apart, and a row
with a null doc_id is judged like any other. Of rows equal in both, one stays if any does. Null and empty texts are
kept by the filters unless the toxicity curve rejects them. Documents may have any further columns. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from barwright.llm.queries import TARGETS, quality_domains
from barwright.llm.rows import KEY, may_be, named, same_row, without
from barwright.llm.tables import read, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the two language models find toxic."""
    scores = toxicity.toxicity_scores(docs, read(spark, sf_dir, "labels"))
    return without(docs, written(scores.where("predicted = 1").select(*KEY), "toxic"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar documents: the smallest doc_id, of several texts the smallest hash.

    Rows without words are similar to nothing; of rows that repeat doc_id and text, one stays.
    """
    rows = written(ngram_join.similar_components(docs).select(*KEY, "component_id", "component_key"), "groups")
    grouped = rows.where("component_key IS NOT NULL AND doc_id IS NOT NULL")
    first = grouped.where("doc_id = component_id").groupBy("component_key").agg(F.min("text_key").alias("kept_key"))
    gone = grouped.join(first, "component_key").where("doc_id <> component_id OR text_key <> kept_key").select(*KEY)
    gone = written(gone.distinct(), "gone")
    repeated = written(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY), "repeated")
    # one look at the texts for both: a second Python pass over the first would hold twice the workers
    others, maybe = may_be(docs, gone.unionByName(repeated))
    d, back = named(maybe)
    kept = d.join(gone, same_row(d, gone), "left_anti").dropDuplicates(KEY)
    return others.unionByName(kept.select(*back))


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows with a passage that aligns with a benchmark item."""
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return without(docs, written(found.select(*KEY), "leaked"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as its rate says, at least once: no row is dropped to meet the targets.

    DataFrame functions only, without a join: each row stays where it is.
    """
    labelled = quality_domains(docs, read(spark, sf_dir, "labels"))
    return mixing.repeated(docs, labelled, TARGETS, floor=1.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, [1.0] * sharding.SHARDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: rows and bytes of whole texts that go to a Python task at once; a task holds several such batches on both sides
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 21


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session whose batches for Python tasks are small; the setting stays, as plans run later."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    (name, in_small_batches(stage)) for name, stage in (
        ("toxicity", toxic), ("ngram_join", near_copies), ("decontamination", leaked), ("mixing", mix), ("sharding", shard),
    )
]
#: the toxicity stage and the mixing stage are models, which SQL cannot express
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
