"""The named queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import decontaminate, extract, fingerprints, line_dedup, mixing, negatives, ngram_join, quality, repeats, resample, sharding, toxicity, urls
from barwright.llm.tables import read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), [1.0] * sharding.SHARDS)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(read(spark, sf_dir, "documents"), gram=4, percent=85).drop("text_key", "component_key")


def held_out(parts: int, kept: int) -> Column:
    """Rows whose labels are not learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == kept


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(~held_out(3, 1))
    scores = quality.quality_scores(read(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(~held_out(5, 0))
    scores = toxicity.toxicity_scores(read(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


#: Share of the tokens wanted from each (language, quality) domain
TARGETS = {"en/1": 0.50, "en/0": 0.06, "de/1": 0.14, "de/0": 0.02, "fr/1": 0.14, "fr/0": 0.02, "es/1": 0.10, "es/0": 0.02}


def quality_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain: the language of each labelled document and its quality mark."""
    return (
        labels.select("doc_id", "quality").join(docs.select("doc_id", "lang"), "doc_id")
        .select("doc_id", F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("domain"))
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mixed(docs, quality_domains(docs, read(spark, sf_dir, "labels")), TARGETS)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(read(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kept = line_dedup.LineIndex.empty(spark).insert(docs).cleaned(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.importance_draw(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_sharding": op2_sharding,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_suffix_array": op8_suffix_array,
    "op9_extraction": op9_extraction,
    "op10_url_filter": op10_url_filter,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_importance_resampling": op13_importance_resampling,
}
