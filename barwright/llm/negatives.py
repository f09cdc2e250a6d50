"""Hard negatives by exact integer scores, looked up in subset-sum tables (the method of four Russians).

A component x becomes floor(scale * x). For eight dimensions of an anchor there are 256 subset sums; a candidate's bit
plane of these dimensions is one byte and names the subset. The sum over the groups of dimensions is the inner product
of the anchor with that bit plane, and the planes, from the sign down, add up by doubling: a full exact score from
lookups and additions alone, for a whole block of anchors side by side.

Rows are packed once, where they are read, into blocks of bit planes; anchors into blocks of numbers. Every block of
anchors meets every block of candidates through an equi-join on the candidates' block: the stated queries against all
rows, block by block. A first pass finds each anchor's positives (labels only meet their own), a second the negatives
below each positive. A block keeps at most `positives` or `negatives` rows an anchor, and Spark ranks those. No step
depends on how many rows share a label, a vector or an id.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component take no part. Vectors of
different lengths meet as if the shorter ended in zeros; an empty vector scores 0. A row is no candidate for an anchor
of its own vec_id and label. Repeated anchor rows are answered one by one, repeated candidate rows count one by one;
those of one vec_id and score are alike in the result. A component beyond 2**40 after scaling, or scores beyond 62 bits,
raise an error. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barwright.llm.tables import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: rows of a block of candidates, and of a block of anchors (tables take 1 KB for each anchor and group of dimensions)
CANDIDATES, ANCHORS = 2048, 1024
STEP = 256
TABLES_KEPT = 2

BLOCK = "block long, rows int, groups int, planes int, vec_ids binary, labels binary, bits binary"
ANCHOR = "anchors long, rows int, groups int, vec_ids binary, labels binary, numbers binary"


def quantised(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) as a matrix of whole groups of eight dimensions; shorter vectors end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = vectors.offsets.to_numpy().astype(np.int64)
    flat = np.floor(scale * vectors.values.to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() > 2.0**40:
        raise ValueError("a component is beyond 2**40 after scaling")
    size = np.diff(ends)
    width = -(-int(size.max(initial=0)) // 8) * 8
    out = np.zeros((len(size), max(8, width)), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)] = flat[ends[0] : ends[-1]]
    return out


def bit_planes(q: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of two's complement numbers, the sign plane last."""
    most = max(int(q.max(initial=0)), -1 - int(q.min(initial=0)))
    count = most.bit_length() + 1
    return np.stack([np.packbits(((q >> p) & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(count)])


def subset_sums(q: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of each eight dimensions of every anchor."""
    groups = q.shape[1] // 8
    out = np.zeros((groups, 256, len(q)), kind)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + q.T.reshape(groups, 8, len(q))[:, j][:, None].astype(kind)
    return out


def number_kind(q: np.ndarray, planes: int) -> type:
    """The narrowest type that holds every partial score of these anchors with numbers of `planes` bits."""
    most = int(np.abs(q).sum(1).max(initial=0)) << planes
    if most >= 1 << 62:
        raise ValueError("scores are beyond 62 bits")
    return np.int32 if most < 1 << 31 else np.int64


def scores(bits: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: planes from the sign down, doubled and added."""
    planes, groups, rows = bits.shape
    groups = min(groups, len(sums))
    out = np.empty((rows, sums.shape[2]), sums.dtype)
    part = np.empty((min(STEP, rows), sums.shape[2]), sums.dtype)
    for lo in range(0, rows, STEP):
        acc = out[lo : lo + STEP]
        one = part[: len(acc)]
        acc[:] = 0
        for p in range(planes - 1, -1, -1):
            if p < planes - 1:
                acc <<= 1
            for g in range(groups):
                np.take(sums[g], bits[p, g, lo : lo + STEP], axis=0, out=one, mode="clip")
                if p == planes - 1:
                    acc -= one
                else:
                    acc += one
    return out


def best(masked: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The `count` largest of each row of a matrix, one after the other, as (row, column); the first of equal ones.

    Entries at the type's minimum are none. The matrix is used up.
    """
    least = np.iinfo(masked.dtype).min
    rows = np.arange(len(masked))
    for _ in range(min(count, masked.shape[1])):
        at = masked.argmax(1)
        there = masked[rows, at] > least
        yield rows[there], at[there]
        masked[rows, at] = least


class Blocks:
    """The blocks of one joined row, with the anchors' tables kept for the next rows."""

    def __init__(self) -> None:
        self.kept: dict[tuple[int, type], np.ndarray] = {}

    def candidates(self, r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits = np.frombuffer(r["bits"], np.uint8).reshape(r["planes"], r["groups"], r["rows"])
        return np.frombuffer(r["vec_ids"], np.int64), np.frombuffer(r["labels"], np.int64), bits

    def anchors(self, r: dict, planes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.frombuffer(r["numbers"], np.int64).reshape(r["a_rows"], r["a_groups"] * 8)
        key = (r["anchors"], number_kind(q, planes))
        if key not in self.kept:
            while len(self.kept) >= TABLES_KEPT:
                self.kept.pop(next(iter(self.kept)))
            self.kept[key] = subset_sums(q, key[1])
        return np.frombuffer(r["a_vec_ids"], np.int64), np.frombuffer(r["a_labels"], np.int64), self.kept[key]


def taking_part(rows: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def _chunks(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of `size` rows, the last one shorter, ordered by vec_id."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in it:
        lo = 0
        while lo < b.num_rows:
            part = b.slice(lo, size - count)
            held.append(part)
            count, lo = count + part.num_rows, lo + part.num_rows
            if count == size:
                yield pa.Table.from_batches(held).sort_by("vec_id")
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).sort_by("vec_id")


def candidate_blocks(rows: DataFrame, scale: int) -> DataFrame:
    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, t in enumerate(_chunks(it, CANDIDATES)):
            bits = bit_planes(quantised(t["embedding"], scale))
            yield pa.RecordBatch.from_pylist([{
                "block": (task << 32) + k, "rows": t.num_rows, "groups": bits.shape[1], "planes": bits.shape[0],
                "vec_ids": t["vec_id"].to_numpy().tobytes(), "labels": t["label"].to_numpy().tobytes(), "bits": bits.tobytes(),
            }], pa.schema([
                ("block", pa.int64()), ("rows", pa.int32()), ("groups", pa.int32()), ("planes", pa.int32()),
                ("vec_ids", pa.binary()), ("labels", pa.binary()), ("bits", pa.binary()),
            ]))

    return rows.mapInArrow(pack, BLOCK)


def anchor_blocks(rows: DataFrame, scale: int) -> DataFrame:
    """Anchors are a small share of a table's rows, so they are brought together into full blocks first."""
    count = rows.count()

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, t in enumerate(_chunks(it, ANCHORS)):
            q = quantised(t["embedding"], scale)
            yield pa.RecordBatch.from_pylist([{
                "anchors": (task << 32) + k, "rows": t.num_rows, "groups": q.shape[1] // 8,
                "vec_ids": t["vec_id"].to_numpy().tobytes(), "labels": t["label"].to_numpy().tobytes(), "numbers": q.tobytes(),
            }], pa.schema([
                ("anchors", pa.int64()), ("rows", pa.int32()), ("groups", pa.int32()),
                ("vec_ids", pa.binary()), ("labels", pa.binary()), ("numbers", pa.binary()),
            ]))

    return rows.repartition(max(1, -(-count // ANCHORS))).mapInArrow(pack, ANCHOR)


def met(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block of candidates beside each block of anchors, spread by the candidates' blocks.

    The anchors are written out once for each block of candidates: an anchor's numbers cost as much as scoring it against
    a few hundred rows. The numbers of the blocks (one for each `CANDIDATES` rows) pass through the driver.
    """
    numbers = sorted(r.block for r in blocks.select("block").collect())
    parts = max(1, 2 * len(numbers))
    own = anchors.select(
        "anchors", *[F.col(c).alias(f"a_{c}") for c in ("rows", "groups", "vec_ids", "labels")],
        *[c for c in anchors.columns if c not in ("anchors", "rows", "groups", "vec_ids", "labels")],
        F.explode(F.lit(numbers).cast("array<bigint>")).alias("block"),
    )
    return blocks.repartition(parts, "block").join(own.repartition(parts, "block").hint("shuffle_merge"), "block")


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in it:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def positive_rows(met_: DataFrame, count: int) -> DataFrame:
    """anchors, anchor, anchor_id, positive_id, positive_score: the best of each pair of blocks among rows of one label."""
    names = ["anchors", "anchor", "anchor_id", "positive_id", "positive_score"]

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for r in _rows(it):
            ids, labels, bits = blocks.candidates(r)
            a_ids, a_labels, sums = blocks.anchors(r, r["planes"])
            for label in np.unique(a_labels):
                c, a = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
                if not len(c):
                    continue
                s = np.ascontiguousarray(scores(np.ascontiguousarray(bits[:, :, c]), np.ascontiguousarray(sums[:, :, a])).T)
                own = a_ids[a][:, None] == ids[c][None]
                masked = np.where(own, np.iinfo(s.dtype).min, s)
                for row, at in best(masked, count):
                    yield _batch(names, np.full(len(row), r["anchors"]), a[row], a_ids[a[row]], ids[c[at]], s[row, at])

    return met_.mapInArrow(find, "anchors long, anchor long, anchor_id long, positive_id long, positive_score long")


def negative_rows(met_: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The best rows of other labels between `low` and `high` percent of each positive's score, for each pair of blocks."""
    names = ["anchors", "anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for r in _rows(it):
            ids, labels, bits = blocks.candidates(r)
            a_ids, a_labels, sums = blocks.anchors(r, r["planes"])
            s = np.ascontiguousarray(scores(bits, sums).T)
            least = np.iinfo(s.dtype).min
            other = np.where(a_labels[:, None] != labels[None], s, least)
            n = len(a_ids)
            for place in range(1, positives + 1):
                mine = [p for p in r["found"] if p["place"] == place]
                at = np.array([p["anchor"] for p in mine], np.int64)
                score, who = np.zeros(n, np.int64), np.zeros(n, np.int64)
                lo, hi = np.ones(n, np.int64), np.zeros(n, np.int64)
                if len(at):
                    score[at], who[at] = [p["positive_score"] for p in mine], [p["positive_id"] for p in mine]
                    lo[at], hi[at] = -(-low * score[at] // 100), high * score[at] // 100
                able = np.flatnonzero(lo <= hi)
                o = other[able]
                masked = np.where((o >= lo[able, None]) & (o <= hi[able, None]), o, least)
                for row, col in best(masked, negatives):
                    a = able[row]
                    yield _batch(
                        names, np.full(len(a), r["anchors"]), a, np.full(len(a), place), a_ids[a], who[a], score[a], ids[col], s[a, col]
                    )

    return met_.mapInArrow(find, ", ".join(f"{n} long" for n in names))


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has vec_id, label and embedding; `is_anchor` is a condition on vec_id or label. For each anchor and each of
    its `positives` best rows of the same label: the `negatives` best rows of other labels whose score lies between `low`
    and `high` percent of the positive's. Higher scores come first, ties by smaller vec_id.
    """
    rows = taking_part(rows)
    blocks = written(candidate_blocks(rows, scale), "blocks")
    anchors = written(anchor_blocks(rows.where(is_anchor), scale), "anchors")
    order = W.partitionBy("anchors", "anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = positive_rows(met(blocks, anchors), positives).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    per_block = found.groupBy("anchors").agg(
        F.collect_list(F.struct("anchor", "place", "positive_id", "positive_score")).alias("found")
    )
    bounded = written(anchors.join(per_block, "anchors"), "bounded")
    near = negative_rows(met(blocks, bounded), positives, negatives, low, high)
    order = W.partitionBy("anchors", "anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


#: the same in SQL over `embeddings`, as op12 reads it
NEGATIVES_SQL = f"""
WITH part_ AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           coalesce(list_sum(list_transform(list_zip(a.q, c.q), lambda p: p[1] * p[2])), 0)::BIGINT AS score
    FROM part_ a JOIN part_ c ON a.vec_id % 50 = 0 AND (a.vec_id <> c.vec_id OR a.label <> c.label)
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
), ranked AS (
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS r
    FROM positive JOIN scored USING (anchor_id)
    WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE r <= {NEGATIVES}
"""
