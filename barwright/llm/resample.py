"""Importance resampling towards a target text: hashed word n-gram features, log-ratio weights, Gumbel top-k draw.

A batch's texts are joined with a separator that no word contains, so one regular-expression pass finds the words of all
of them. Where each document's words begin follows from a binary search of its offset among the word starts; n-grams
that would reach into the next document are masked before the buckets are counted.

A feature's bucket is the CRC-32 of its bytes. That sum is linear: crc(a + b) is crc(a) moved on by len(b) zero bytes,
xor crc(b). Each word is therefore summed once, and the n-grams' sums are put together from the words' by table lookups.

The draw without replacement adds to each weight a Gumbel number that depends on the seed and doc_id alone and takes the
highest scores. Documents are put in order by range partitioning, and a row's rank is its place in its partition plus the
rows of the partitions before: no task sees more than its own range, however many scores are equal.

Defined cases: a null or empty text, or one without words, has no features and weight 0. A null doc_id is hashed as the
text `null` and comes last among equal scores. Repeated rows are drawn one by one; rows equal in score and doc_id have
consecutive ranks. An empty target gives every feature the count 0; an empty table gives no rows. Extra columns of the
inputs are ignored unless they are named in `carry`. A text longer than a slice is read in pieces cut between words,
each led by the last words of the one before.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.tables import written
from barwright.llm.words import text_bytes

BUCKETS = 10_000
ORDERS = 3
PERCENT = 5
MIN_WORDS = 20
SEED = 42
SLICE_BYTES = 1 << 21
#: words over the UTF-8 bytes of lower-cased text: digits, a to z, and every character outside ASCII
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
SENTINEL = b"\n"


class ZeroBytes:
    """`shift(c, n)`: the CRC-32 register c after n further zero bytes. Linear in c, so four table lookups do."""

    DIRECT = 256

    def __init__(self) -> None:
        one = np.array([crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)], np.uint32)  # register b after a zero byte
        byte = np.arange(256, dtype=np.uint32)
        tables = np.empty((self.DIRECT, 4, 256), np.uint32)
        tables[0] = np.stack([byte << np.uint32(8 * k) for k in range(4)])
        for n in range(1, self.DIRECT):
            last = tables[n - 1]
            tables[n] = (last >> np.uint32(8)) ^ one[last & np.uint32(255)]
        self.tables = tables
        last = tables[-1]
        self.doubled = [(last >> np.uint32(8)) ^ one[last & np.uint32(255)]]  # 256, 512, 1024 ... zero bytes

    @staticmethod
    def _look(table: np.ndarray, c: np.ndarray) -> np.ndarray:
        return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]

    def shift(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        flat, at = self.tables.reshape(-1), (n & 255) << 10
        out = flat[at + (c & 255)] ^ flat[at + (256 + ((c >> 8) & 255))]
        out ^= flat[at + (512 + ((c >> 16) & 255))] ^ flat[at + (768 + (c >> 24))]
        far = np.flatnonzero(n >= self.DIRECT)
        high, k = n[far] >> 8, 0
        while len(far):
            if k == len(self.doubled):
                t = self.doubled[-1]
                self.doubled.append(self._look(t, t))
            odd = (high & 1).astype(bool)
            out[far[odd]] = self._look(self.doubled[k], out[far[odd]])
            high >>= 1
            far, high, k = far[high > 0], high[high > 0], k + 1
        return out


_zero: list[ZeroBytes] = []


def zero_bytes() -> ZeroBytes:
    if not _zero:
        _zero.append(ZeroBytes())
    return _zero[0]


def features(texts: list[bytes], orders: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each order the buckets of its runs of words and the text each belongs to."""
    joined = SENTINEL.join(texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(SENTINEL) for t in texts], out=offsets[1:])
    found = list(WORD.finditer(joined))
    starts = np.fromiter(map(re.Match.start, found), np.int64, len(found))
    words = list(map(re.Match.group, found))
    crc = np.fromiter(map(crc32, words), np.int64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    count = np.diff(np.searchsorted(starts, offsets))
    doc = np.repeat(np.arange(len(texts)), count)
    shift = zero_bytes().shift
    spaced = shift(np.full(len(words), crc32(b" "), np.int64), size) ^ crc  # a space and the word
    out, run = [(crc % buckets, doc)], crc
    for k in range(1, orders):
        if len(run) < 2:
            break
        run = shift(run[:-1], size[k:] + 1) ^ spaced[k:]
        whole = doc[: len(run)] == doc[k:]  # runs over a separator are no n-grams
        out.append((run[whole] % buckets, doc[: len(run)][whole]))
    return count, out


def pieces(text: bytes, orders: int, limit: int) -> Iterator[tuple[bytes, bytes]]:
    """(piece, what it shares with the piece before) of a text, cut between words; the features of the text are those of
    its pieces less those of the shared words."""
    lo, shared = 0, b""
    while lo < len(text):
        cut = GAP.search(text, lo + limit) if lo + limit < len(text) else None
        hi = cut.start() if cut else len(text)
        part = shared + b" " + text[lo:hi] if shared else text[lo:hi]
        yield part, shared
        tail = part if len(part) <= limit else part[max(0, len(part) - limit) :]
        words = WORD.findall(tail)
        if len(words) < orders:  # very long words: look at the whole piece
            words = WORD.findall(part)
        shared = b" ".join(words[-(orders - 1) :]) if orders > 1 else b""
        lo = hi


def slices(texts: pa.Array, orders: int, limit: int) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
    """(rows, texts, shared words to take off) of about `limit` bytes; a longer text comes as several rows."""
    data, at = text_bytes(texts)
    rows: list[int] = []
    parts: list[bytes] = []
    less: list[bytes] = []
    size = 0
    for i in range(len(at) - 1):
        whole = data[at[i] : at[i + 1]].tobytes().lower()
        for part, shared in pieces(whole, orders, limit) if len(whole) > limit else [(whole, b"")]:
            if parts and size + len(part) > limit:
                yield rows, parts, less
                rows, parts, less, size = [], [], [], 0
            rows.append(i)
            parts.append(part)
            less.append(shared)
            size += len(part)
    if parts:
        yield rows, parts, less


def bucket_counts(df: DataFrame, *, orders: int = ORDERS, buckets: int = BUCKETS, limit: int = SLICE_BYTES) -> list[int]:
    """How many features of all texts fall in each bucket. Tasks add up, so `buckets` rows a task are shuffled."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in it:
            for _, parts, less in slices(b.column(0), orders, limit):
                for texts, sign in ((parts, 1), ([x for x in less if x], -1)):
                    for found, _ in features(texts, orders, buckets)[1] if texts else []:
                        total += sign * np.bincount(found, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])

    rows = df.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(target: list[int], source: list[int]) -> list[int]:
    """Thousandths of the log ratio of the smoothed bucket shares, rounded down."""
    n, t_all, s_all = len(source), float(sum(target) + len(source)), float(sum(source) + len(source))
    return [math.floor(1000 * math.log((target[k] + 1.0) * s_all / ((source[k] + 1.0) * t_all))) for k in range(n)]


def gumbel(seed: int, doc_id: int | None) -> int:
    """Thousandths of a Gumbel number that the seed and doc_id fix, rounded down."""
    name = f"{seed}:{'null' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], *, orders: int, seed: int, limit: int, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, the carried columns, n_words, n_features, weight, score of every document."""
    table = np.array(gain, np.int64)
    buckets = len(table)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = b.num_rows
            words, count, weight = (np.zeros(n, np.int64) for _ in range(3))
            for rows, parts, less in slices(b.column(1), orders, limit):
                at = np.array(rows)
                back = [i for i, x in enumerate(less) if x]
                for where, texts, sign in ((at, parts, 1), (at[back], [less[i] for i in back], -1)):
                    if not texts:
                        continue
                    each, found = features(texts, orders, buckets)
                    np.add.at(words, where, sign * each)
                    for bucket, doc in found:
                        np.add.at(count, where, sign * np.bincount(doc, minlength=len(texts)))
                        total = np.concatenate([[0], np.cumsum(table[bucket])])
                        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                        np.add.at(weight, where, sign * np.diff(total[ends]))
            luck = np.array([gumbel(seed, i) for i in b.column(0).to_pylist()], np.int64)
            made = [pa.array(x) for x in (words, count, weight, weight + luck)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(2 + k) for k in range(len(carry))], *made], schema=out_schema)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *carry)
    result = kept.drop("_text")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    spark_schema = StructType(list(result.schema.fields))
    for name in ("n_words", "n_features", "weight", "score"):
        spark_schema = spark_schema.add(name, LongType())
    out_schema = to_arrow_schema(spark_schema)
    return kept.mapInArrow(score, spark_schema)


def importance_draw(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    orders: int = ORDERS,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """doc_id, the carried columns, n_words, n_features, weight, score, rank of every document of `docs`.

    Of the documents with at least `min_words` words, `percent` in a hundred (rounded down) are drawn; `rank` counts them
    from 1 by falling score, and is null for the others. `carry` names columns of `docs` to take along, such as the text.
    """
    if not 0 <= percent <= 100 or buckets < 1 or orders < 1:
        raise ValueError("percent must lie in 0 to 100, buckets and orders must be positive")
    taken = {"doc_id", "n_words", "n_features", "weight", "score", "rank"} & set(carry)
    if taken:
        raise ValueError(f"columns {sorted(taken)} cannot be carried under their names")
    sizes = {"orders": orders, "limit": limit}
    gain = gains(bucket_counts(target, buckets=buckets, **sizes), bucket_counts(docs, buckets=buckets, **sizes))
    rows = written(scored(docs, gain, seed=seed, carry=carry, **sizes), "scored")
    eligible = F.col("n_words") >= min_words
    drawn = rows.where(eligible).count() * percent // 100
    order = [eligible.desc(), F.desc("score"), F.col("doc_id").asc_nulls_last()]
    placed = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "placed"
    )
    part = F.shiftright("_place", 33)
    parts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = list(accumulate([0, *[n for _, n in parts]]))
    bases = docs.sparkSession.createDataFrame(
        [(p, b) for (p, _), b in zip(parts, before, strict=False)] or [(0, 0)], "_part long, _base long"
    )
    rank = F.col("_base") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("_part", part).join(F.broadcast(bases), "_part", "left")
    return ranked.select(
        "doc_id", *carry, "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank")
    )
