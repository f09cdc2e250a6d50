"""Repeated byte strings across all texts, by difference-cover sampling, one bucket of strings at a time.

A string of LENGTH bytes that starts at p and at q (in any two texts) has an offset k < PERIOD with p + k and q + k both in
the difference cover, whatever p and q are. So it is enough to compare texts at cover positions first:

1. The cover sample of every text (about a tenth of its positions) is named by its next LENGTH - PERIOD + 1 bytes. Names
   are dealt into buckets and each bucket is sorted on its own; a name at two places marks both.
2. The starts whose string holds a marked cover position are a block. All its strings hold the block's core (at first the
   cover window), and they lie in its wide string. Where each block of a group with equal cores shares its wide string
   with another one, all strings of the group are repeated and it is settled: the inside of long repeats. The blocks of other
   groups, at the ends, are cut into smaller ones, whose cores are longer; a block alone with its core is dropped.
3. Only the starts in small blocks that are not settled are named by all their LENGTH bytes, and these names are sorted
   bucket by bucket as in 1. A name at two places makes both starts repeated. Two equal strings lie in blocks of one group,
   at the same place, so either both are settled or both are named.
4. Each text's repeated starts come back to it; the bytes they cover are removed. Texts that share nothing stay in place.

Names are 64-bit hashes: equality of strings is all that is asked, so equal names stand for tied suffixes and their order
is not needed. A batch sends each name once, with the places it has there, so a passage that many documents hold is one
row for each batch; rows are in the order of texts, which packs well. Equal texts share their places; a text held twice is repeated as a whole. A text's working arrays are
about 50 times its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.rows import may_be
from barwright.llm.tables import written
from barwright.llm.words import U, mix, powers, signed, slices

LENGTH, PERIOD = 200, 133
#: starts of a small block; a divisor of PERIOD
SMALL = 19
#: bytes of texts that are worked on at once
SLICE = 1 << 19
#: bytes of rows that go to a Python task at once; a task holds several such batches on both sides
BATCH_BYTES = 1 << 21
#: A difference cover of the residues modulo PERIOD
COVER = [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109]


def small_batches(df: DataFrame) -> None:
    """Long texts go to Python tasks in few rows at a time, short rows in many; the setting stays, as plans run later."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_shuffles(df: DataFrame) -> None:
    """Shuffle files go when the driver collects the plans that made them; it need not wait for memory to run short.

    The scheduler holds on to its last job, so the one before is what goes.
    """
    df.sparkSession._jvm.System.gc()


def step(df: DataFrame, name: str) -> DataFrame:
    out = written(df, name)
    free_shuffles(out)
    return out


def window_names(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` bytes at each start."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[start + length] - total[start]) * down[start])


def bundle(name: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One row for each different name, in the order of first occurrences: name, key and place of that, and the different
    other ones as bytes (keys and places in turn)."""
    order = np.lexsort((place, key, name))
    name, key, place = name[order], key[order], place[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    name, key, place = name[new], key[new], place[new].astype(np.int64)
    first = np.ones(len(name), bool)
    first[1:] = name[1:] != name[:-1]
    at = np.flatnonzero(first)
    other = np.stack([key[~first], place[~first]], axis=1)
    # offsets of the other occurrences: those before each name's first one
    offsets = np.append(at - np.arange(len(at)), len(other)).astype(np.int32) * 16
    rest = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(other.tobytes())])
    out = pa.RecordBatch.from_arrays(
        [pa.array(signed(name[at])), pa.array(key[at]), pa.array(place[at].astype(np.int32)), rest], names=["name", "key", "place", "rest"]
    )
    return out.take(pa.array(np.lexsort((place[at], key[at]))))


BUNDLE = "name long, key long, place int, rest binary"


def unbundled(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the rows of bundles; row, key and place of every occurrence, in the order of rows."""
    rest = b.column(3)
    at = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1]
    data = rest.buffers()[2]
    other = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.int64).reshape(-1, 2) if data is not None else np.zeros((0, 2), np.int64)
    every = np.arange(len(rest))
    row = np.concatenate([every, np.repeat(every, np.diff(at) // 16)])
    order = np.argsort(row, kind="stable")
    keys = np.concatenate([b.column(1).to_numpy(), other[:, 0]])[order]
    places = np.concatenate([b.column(2).to_numpy(), other[:, 1]])[order]
    return b.column(0).to_numpy(), row[order], keys, places


def cover_names(docs: DataFrame, length: int) -> DataFrame:
    """Bundles of the cover sample of all texts (key, text)."""
    inside = np.zeros(PERIOD, bool)
    inside[COVER] = True

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys = b.column(0).to_numpy()
            for lo, hi, data, at in slices(b.column(1), SLICE):
                size = np.diff(at)
                doc = np.repeat(np.arange(hi - lo), size)
                place = np.arange(len(data)) - at[:-1][doc]
                start = np.flatnonzero(inside[place % PERIOD] & (place + length - PERIOD + 1 <= size[doc]) & (size[doc] >= length))
                yield bundle(window_names(data, start, length - PERIOD + 1), keys[lo + doc[start]], place[start])

    return docs.select("key", "text").mapInArrow(batches, BUNDLE)


def block_names(blocks: DataFrame, width: int, parts: int, length: int) -> DataFrame:
    """name, wide, key, place for blocks of `width` starts, each block at `places` (key, text, places; a row for each
    key) cut into `parts` of them: a hash of the bytes that all strings of the block hold, and of the bytes that any
    holds (null where the text does not), and the block's first start. A block without a string in the text is left out."""
    core = length - width + 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, firsts = b.column(0).to_numpy(), b.column(2)
            for lo, hi, data, at in slices(b.column(1), SLICE):
                part = firsts.slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()) * parts)
                place = (part.flatten().to_numpy().astype(np.int64)[:, None] + np.arange(parts) * width).ravel()
                here = np.unique(np.stack([doc, place], axis=1), axis=0)
                size = np.diff(at)
                doc, place = here[(here[:, 1] + width > 0) & (here[:, 1] + length <= size[here[:, 0]])].T
                start = at[doc] + place
                whole = (place >= 0) & (place + length + width - 1 <= size[doc])
                wide = np.zeros(len(start), U)
                wide[whole] = window_names(data, start[whole], length + width - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(window_names(data, start + width - 1, core))), pa.array(signed(wide), mask=~whole), pa.array(keys[lo + doc]),
                     pa.array(place.astype(np.int32))],
                    names=["name", "wide", "key", "place"],
                )

    return blocks.select("key", "text", "places").mapInArrow(batches, "name long, wide long, key long, place int")


def settled_blocks(blocks: DataFrame, width: int, parts: int, length: int) -> DataFrame:
    """key, settled, places (arrays): the blocks of which every string is repeated, and those to look into further.

    Blocks with equal cores are a group. A block alone in its group has no repeated string that others know of.
    """
    def count(c: str, *by: str) -> Column:
        return F.count(c).over(Window.partitionBy(*by))

    d = block_names(blocks, width, parts, length).withColumns({"n": count("name", "name"), "twin": count("wide", "name", "wide") > 1})
    d = d.withColumn("done", F.min("twin").over(Window.partitionBy("name"))).where("n > 1")
    by_key = d.groupBy("key").agg(
        F.collect_list(F.when(F.col("done"), F.col("place"))).alias("settled"),
        F.collect_list(F.when(~F.col("done"), F.col("place"))).alias("places"),
    )
    return step(by_key, "settled")


def start_names(blocks: DataFrame, width: int, length: int) -> DataFrame:
    """Bundles of the starts in blocks of `width` at `places` with their whole name (key, text, places)."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, marks = b.column(0).to_numpy(), b.column(2)
            for lo, hi, data, at in slices(b.column(1), SLICE):
                open_ = np.zeros(len(data) + 1, np.int64)
                for i in range(hi - lo):
                    p = np.asarray(marks[lo + i].values, np.int64)
                    last = at[i + 1] - at[i] - length
                    if last >= 0:
                        np.add.at(open_, at[i] + np.clip(p, 0, last + 1), 1)
                        np.add.at(open_, at[i] + np.clip(p + width, 0, last + 1), -1)
                start = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
                doc = np.searchsorted(at, start, "right") - 1
                yield bundle(window_names(data, start, length), keys[lo + doc], start - at[doc])

    return blocks.select("key", "text", "places").mapInArrow(batches, BUNDLE)


def repeated_places(bundles: DataFrame, name: str) -> DataFrame:
    """key, places (array): every place whose name has a second one. Sorted buckets are streamed, a row at a time."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the open name and its first place while that has no second
        for b in it:
            if not b.num_rows:
                continue
            names, row, keys, places = unbundled(b)
            if held is not None and held[0] == names[0]:
                row, keys, places = np.append(0, row), np.append(held[1], keys), np.append(held[2], places)
                again = held[3]
            else:
                again = False
            group = np.cumsum(np.concatenate([[0], names[1:] != names[:-1]]))[row]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[group]
            other = (keys != keys[first]) | (places != places[first])
            several = np.bincount(group, other, group[-1] + 1) > 0
            several[0] |= again
            good = several[group]
            yield pa.RecordBatch.from_arrays([pa.array(keys[good]), pa.array(places[good].astype(np.int32))], names=["key", "place"])
            last = first[-1]
            held = (names[-1], keys[last], places[last], bool(several[-1]))

    dealt = bundles.repartition("name").sortWithinPartitions("name")
    flat = dealt.mapInArrow(batches, "key long, place int")
    return step(flat.groupBy("key").agg(F.collect_set("place").alias("places")), name)


def keyed(d: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of d (key, text, ...) whose key is surely not, or may be, among `keys`."""
    none = F.lit(0).cast("long").alias("doc_id")
    return may_be(d.select(none, *d.columns), keys.select(none, F.col("key").alias("text_key")))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes), for every row of docs.

    Removes each byte covered by a string of `length` bytes (at least PERIOD) that also starts anywhere else. Null text
    counts as empty. Texts below `length` bytes lose nothing. Repeated rows are copies of each other. Empty table: no rows.
    Sets `spark.sql.execution.arrow.maxBytesPerBatch` of the session.
    """
    if length < PERIOD:
        raise ValueError(f"length must be at least {PERIOD}")
    small_batches(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("key", F.xxhash64("text"))
    long_ = d.where(F.octet_length("text") >= length)
    copies = long_.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("whole"))
    marks = repeated_places(cover_names(long_, length), "cover")
    texts = keyed(long_.select("key", "text"), marks)[1].select("key", "text").dropDuplicates(["key"])
    free_shuffles(texts)
    firsts = marks.select("key", F.transform("places", lambda p: p - (PERIOD - 1)).alias("places"))
    large = settled_blocks(texts.join(firsts, "key"), PERIOD, 1, length)
    small = settled_blocks(texts.join(large.where(F.size("places") > 0), "key"), SMALL, PERIOD // SMALL, length)
    starts = repeated_places(start_names(texts.join(small.where(F.size("places") > 0), "key"), SMALL, length), "starts")
    inside = [d.where(F.size("settled") > 0).select("key", F.col("settled").alias(c)) for d, c in ((large, "large"), (small, "small"))]
    found = starts.join(inside[0], "key", "full").join(inside[1], "key", "full").join(copies, "key", "full")
    found = step(found.select("key", "places", "small", "large", "whole"), "found")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = []
                for text, *blocks, whole in zip(*part.columns[1:], strict=True):
                    raw = np.frombuffer(text.as_py().encode(), np.uint8)
                    gone = np.zeros(len(raw) + 1, np.int64)
                    for places, width in zip(blocks, (1, SMALL, PERIOD), strict=True):
                        p = np.asarray(places.values, np.int64) if places.is_valid else np.zeros(0, np.int64)
                        np.add.at(gone, p, 1)
                        np.add.at(gone, p + width - 1 + length, -1)
                    cut = np.cumsum(gone[:-1]) > 0
                    if whole.as_py():
                        cut[:] = True
                    spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
                    out.append((len(raw), int(cut.sum()), spans, raw[~cut].tobytes()))
                n, removed, spans, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    others, maybe = keyed(d.withColumnRenamed("doc_id", "id"), found)
    columns = ["places", "small", "large", "whole"]
    apart = others.select(F.col("id").alias("doc_id"), "text", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns))
    joined = maybe.join(found, "key", "left").select(F.col("id").alias("doc_id"), "text", *columns)
    return apart.unionByName(joined).mapInArrow(batches, RESULT)
