"""Decisions about rows of documents, applied where the rows are.

A row is named by its doc_id (null is a name too) and a hash of its text, so rows that share a doc_id but not their text
are judged apart. Few rows are usually decided on; a bitmap of fixed size, built from their names, is sent to the tasks
and picks the rows that may be meant. Only those are shuffled and compared by name; all others stay where they are. With
very many names the bitmap lets more rows through, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24
PART = 1 << 15  # bits of one piece of the bitmap, as Spark builds them
KEY = ["doc_id", "text_key"]


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _place(doc_id: Column, key: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, key), F.lit(BITS))


def may_be(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that no key names, rows that one may name), each row of docs in one of them."""
    bit = _place(F.col("doc_id"), F.col("text_key")) + 1
    pieces = keys.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    ).collect()  # at most BITS / 8 bytes
    table = np.zeros(BITS // 8, np.uint8)
    for r in pieces:
        x = np.frombuffer(bytes(r.bits), np.uint8)
        table[(r.k - 1) * PART // 8 : (r.k - 1) * PART // 8 + len(x)] = x
    sent = docs.sparkSession.sparkContext.broadcast(table)
    place = _place(F.col("doc_id").cast("long"), text_key(F.col("text")))
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns may repeat nothing here, whatever their names
    plain = docs.select(place.alias("place"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])

    def passing(wanted: bool) -> DataFrame:
        def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                p = b.column(0).to_numpy()
                hit = (sent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays(b.columns[1:], names=names).filter(pa.array(hit == wanted))

        out = plain.mapInArrow(keep, plain.drop("place").schema)
        return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])

    return passing(False), passing(True)


def named(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with its own columns as one struct `row` beside doc_id and text_key, and the columns to select from it again."""
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    return d, [F.col("row")[c].alias(c) for c in docs.columns]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that `gone` (doc_id, text_key) names."""
    gone = gone.select(*KEY).distinct()
    others, maybe = may_be(docs, gone)
    rows, back = named(maybe)
    return others.unionByName(rows.join(gone, same_row(rows, gone), "left_anti").select(*back))
