"""Document fingerprints by one-permutation MinHash.

The hashes of a text's word n-grams are dealt into bins once and each bin keeps its smallest value. Empty bins take the
value of another bin, tried in an order that is fixed for each bin and the same for all texts (optimal densification),
so two texts fill a bin from the same place when they agree on which bins are empty. The low-order bits of each value
are packed. Two fingerprints that share nothing still agree by chance in 2**-bits of the bins; `likeness` takes that
off. Cost is one pass over the text and one pass over its bins.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.words import SLICE_BYTES, U, Words, mix, slices

BINS, BITS, GRAM = 512, 4, 5
_NONE = U(2**64 - 1)


@lru_cache(maxsize=4)
def _tries(bins: int) -> np.ndarray:
    """Row i: the bins in the order in which an empty bin i asks them."""
    key = mix(np.arange(1, bins * bins + 1, dtype=U).reshape(bins, bins) * U(0x9E3779B97F4A7C15))
    return np.argsort(key, axis=1, kind="stable").astype(np.int32)


def bin_minima(words: Words, texts: int, gram: int, bins: int) -> np.ndarray:
    """texts x bins smallest n-gram hashes, empty bins filled; rows of texts without words hold one fixed value."""
    h, doc, _ = words.grams(gram)
    out = np.full(texts * bins, _NONE, U)
    shift = U(64 - int(bins).bit_length() + 1)
    np.minimum.at(out, doc * bins + (h >> shift).astype(np.int64), h & ((U(1) << shift) - U(1)))
    out = out.reshape(texts, bins)
    has = out != _NONE
    row, hole = np.nonzero(~has & has.any(axis=1)[:, None])
    kept, tries = out.copy(), _tries(bins)
    for k in range(bins):
        if not len(row):
            break
        ask = tries[hole, k]
        found = has[row, ask]
        out[row[found], hole[found]] = kept[row[found], ask[found]]
        row, hole = row[~found], hole[~found]
    return out


def pack(minima: np.ndarray, bits: int) -> np.ndarray:
    """The low-order bits of each bin, packed into bytes; one row for each text."""
    low = (minima & U((1 << bits) - 1)).astype(np.uint8)
    spread = (low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(spread.reshape(len(low), -1), axis=1)


def fingerprints(texts: list[str | None], gram: int = GRAM, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(packed fingerprints, whether each text has words)."""
    out, has = [np.zeros((0, bins * bits // 8), np.uint8)], [np.zeros(0, bool)]
    for lo, hi, data, at in slices(pa.array(texts, pa.large_string()), SLICE_BYTES):
        w = Words(data, at)
        out.append(pack(bin_minima(w, hi - lo, gram, bins), bits))
        has.append(w.count > 0)
    return np.concatenate(out), np.concatenate(has)




def likeness(a: np.ndarray, a_has: np.ndarray, b: np.ndarray, b_has: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of the n-gram sets, from 0 to 1. Two texts without words are alike, one is not."""
    x = np.unpackbits(a ^ b, axis=1).reshape(len(a), -1, bits)
    agree = (~x.any(axis=2)).mean(axis=1) if len(a) else np.zeros(0)
    chance = 2.0**-bits
    est = np.clip((agree - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_has & b_has, est, (a_has == b_has).astype(float))


def as_string(row: np.ndarray, has: bool) -> str:
    """Base64 of the packed bits; empty for a text without words."""
    return base64.b64encode(row.tobytes()).decode() if has else ""


def fingerprint_table(docs: DataFrame, *, key: str = "doc_id", text: str = "text", gram: int = GRAM, bins: int = BINS,
                      bits: int = BITS) -> DataFrame:
    """`key`, `fingerprint` for every row; no shuffle. Null and empty texts get the empty fingerprint."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp, has = fingerprints(b.column(1).to_pylist(), gram, bins, bits)
            strings = pa.array([as_string(f, h) for f, h in zip(fp, has, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), strings], names=[key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(batches, f"`{key}` {kind}, fingerprint string")


# ------------------------------------------------------------------------------------------------ the next document


def with_next(docs: DataFrame, *, per_bucket: int = 4096) -> DataFrame:
    """Rows dealt into ranges of ascending doc_id, each followed by the first row of the next range (`look` true).

    Returns bucket, look, ord, doc_id, text, partitioned by bucket and sorted inside it. The range bounds are quantiles
    of doc_id, at most one for `per_bucket` rows; nothing but the bounds and the smallest id of each range comes to the
    driver. A null doc_id comes first. Rows of one doc_id are ordered by text and share a range.
    """
    spark: SparkSession = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("ord"), "doc_id", "text")
    rows = ids.count()
    if not rows:
        return ids.select(F.lit(0).alias("bucket"), F.lit(False).alias("look"), "ord", "doc_id", "text")
    n = max(1, min(-(-rows // per_bucket), 100_000))
    cuts = np.unique(ids.select("ord").stat.approxQuantile("ord", [k / n for k in range(1, n)], 0.1 / n)) if n > 1 else []
    bounds = spark.sparkContext.broadcast(np.asarray(cuts, np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def bucket_of(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, o.to_numpy(), "right").astype(np.int32))

    first = sorted(tuple(r) for r in ids.select("ord").withColumn("b", bucket_of("ord")).groupBy("b").agg(F.min("ord")).collect())
    before = {o: first[k - 1][0] for k, (_, o) in enumerate(first)}
    back = spark.sparkContext.broadcast(before)

    @F.pandas_udf("array<int>")
    def homes(o: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds.value, o.to_numpy(), "right").tolist()
        follows = back.value
        return pd.Series([[b, -1 - follows[x]] if x in follows else [b] for b, x in zip(own, o, strict=True)])

    dealt = ids.withColumn("home", F.explode(homes("ord"))).select(
        F.when(F.col("home") < 0, -1 - F.col("home")).otherwise(F.col("home")).alias("bucket"),
        (F.col("home") < 0).alias("look"), "ord", "doc_id", "text",
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(first) // 4))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "look", "ord", "text")


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by the first as many of the next document."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_report(docs: DataFrame, *, gram: int = GRAM, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    One row for each input row; null text counts as empty. Empty table: no rows. A single document is its own next.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, doc_id, text, fingerprint, has words) of the row before; it still wants its next
        step = 2048
        for b in it:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                bucket, look = part.column(0).to_pylist(), part.column(1).to_pylist()
                ids = part.column(3).to_pylist()
                texts = [t or "" for t in part.column(4).to_pylist()]
                fp, has = fingerprints(texts, gram, bins, bits)
                left: list[tuple] = []
                for i in range(len(texts)):
                    if last is not None and last[0] == bucket[i]:
                        left.append((*last[1:], texts[i], fp[i], has[i]))
                    last = None if look[i] else (bucket[i], ids[i], texts[i], fp[i], has[i])
                if left:
                    yield _report(left, gram, bins, bits)

    return with_next(docs).mapInArrow(batches, RESULT)


def _report(rows: list[tuple], gram: int, bins: int, bits: int) -> pa.RecordBatch:
    ids, texts, fp, has, nxt, next_fp, next_has = zip(*rows, strict=True)
    fp, has, next_fp, next_has = np.array(fp), np.array(has), np.array(next_fp), np.array(next_has)
    edited = [edited_text(t, f) for t, f in zip(texts, nxt, strict=True)]
    e_fp, e_has = fingerprints(edited, gram, bins, bits)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([as_string(f, h) for f, h in zip(fp, has, strict=True)], pa.string()),
            pa.array([as_string(f, h) for f, h in zip(e_fp, e_has, strict=True)], pa.string()),
            pa.array(likeness(fp, has, e_fp, e_has, bits)), pa.array(likeness(fp, has, next_fp, next_has, bits)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
