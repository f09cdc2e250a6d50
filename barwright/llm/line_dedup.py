"""Incremental removal of repeated lines: sharded cuckoo filters in front of exact reference counts.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. A key of at least `min_chars` code
points that at least `min_docs` documents hold is kept in the largest doc_id that holds it and dropped everywhere else.

`LineIndex` is a state that grows and shrinks by documents:

* `held`: the distinct keys of each document, as SHA-256 digests, so that a document can be taken out again;
* `refs`: the exact count of documents and the largest doc_id of each key;
* `filters`: for each shard of the key space one chain of cuckoo filters of the keys counted at all (`any`) and one of
  the keys that reach `min_docs` (`many`).

An insertion counts the keys of the new documents alone, asks the shards' `any` filters which of them may be known, and
reads the exact counts for those only; keys that the filter denies are new without a lookup. A deletion counts down,
finds the next largest holder where the largest went, and takes keys out of the filters. Marking lines asks the `many`
filters where the text is (as many shards as `FILTER_BYTES` holds, the rest pass) and checks each hit against the exact counts.

Nothing is rewritten: each change adds a generation (an overlay of counts and of touched shards) and returns a new
`LineIndex`; the old one stays readable. Every table is stored in the shared folder, so a lost executor costs tasks.
Shards hold about `KEYS_PER_SHARD` keys whatever the hottest line is, since keys are counted before they are dealt out.

Defined cases: a null or empty text is one empty line. Rows with one doc_id are one holder; each row keeps its own
lines. A null doc_id holds nothing: its lines are neither counted nor dropped. Equal lines of one document stay or go
together. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from barwright.llm.cuckoo import Chain
from barwright.llm.tables import shared_folder

MIN_CHARS = 20
MIN_DOCS = 3
KEYS_PER_SHARD = 1 << 16
#: rows worked on at a time in a task
ROWS = 1024
#: at least so many shards, so that small inputs use all cores
LEAST_SHARDS = 256
#: bound of the filters sent to every task when lines are marked
FILTER_BYTES = 32 << 20
#: The characters stripped from both ends, and the letters lower-cased
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

REFS = "shard int, h long, key binary, docs long, top long"
FILTERS = "shard int, kind string, part int, blob binary"


_FOLD = str.maketrans(UPPER, LOWER)


def line_key(line: str) -> str:
    """ASCII lines, the usual case, are lower-cased as a whole; others letter by letter, A-Z only."""
    ends = line.strip(BLANKS)
    return ends.lower() if ends.isascii() else ends.translate(_FOLD)


def digests(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(place, SHA-256 of the key) of the lines whose key has `min_chars` code points."""
    for pos, line in enumerate((text or "").split("\n")):
        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
            yield pos, sha256(key.encode()).digest()


def hashes(keys: list[bytes]) -> np.ndarray:
    """Spark's `xxhash64` of binary values."""
    return np.fromiter((xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys)).view(np.int64)


def text_mark(text: Column) -> Column:
    """Tells the rows of a repeated doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def kept_text(text: str | None, drops: list[int] | None) -> tuple[str, int, int]:
    """The text without the lines at the given places, its lines before, and how many went."""
    text = text or ""
    if not drops:
        return text, text.count("\n") + 1, 0
    lines, gone = text.split("\n"), set(drops)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def _filtered(shard_changes: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """The new filters of one shard, from its old ones and its keys' old and new counts of documents."""
    out, minimum = [], int(shard_changes["minimum"].iloc[0]) if len(shard_changes) else 0
    for kind, least in (("any", 1), ("many", minimum)):
        mine = old[old["kind"] == kind].sort_values("part")
        chain = Chain.load(list(mine["blob"]))
        if len(shard_changes):
            before, now = shard_changes["old_docs"].to_numpy() >= least, shard_changes["docs"].to_numpy() >= least
            h = shard_changes["h"].to_numpy()
            chain.delete(h[before & ~now])
            chain.insert(h[~before & now], expected=2 * int((~before & now).sum()))
        shard = (shard_changes if len(shard_changes) else old)["shard"].iloc[0]
        out += [(shard, kind, i, blob) for i, blob in enumerate(chain.dump())]
    return pd.DataFrame(out, columns=["shard", "kind", "part", "blob"])


def _asked(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """One shard's keys with the answer of its `any` filters."""
    chain = Chain.load(list(filters[filters["kind"] == "any"].sort_values("part")["blob"]))
    return keys.assign(known=chain.contains(keys["h"].to_numpy()) if len(keys) else np.zeros(0, bool))


@dataclass(frozen=True)
class LineIndex:
    """An index as a value: `insert` and `delete` return the next state, the present one stays as it is."""

    spark: SparkSession
    folder: str
    shards: int = 0
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    held: tuple[str, ...] = field(default=())
    gone: tuple[str, ...] = field(default=())
    refs: tuple[str, ...] = field(default=())
    filters: tuple[str, ...] = field(default=())

    @classmethod
    def empty(cls, spark: SparkSession, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        if min_docs < 2 or min_chars < 1:
            raise ValueError("min_docs must be at least 2 and min_chars at least 1")
        return cls(spark, f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}", min_docs=min_docs, min_chars=min_chars)

    # ---- stored tables

    def _store(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return path

    def _layers(self, paths: tuple[str, ...], schema: str) -> DataFrame:
        layers = [self.spark.read.schema(schema).parquet(p).withColumn("layer", F.lit(i)) for i, p in enumerate(paths)]
        out = layers[0] if layers else self.spark.createDataFrame([], schema + ", layer int")
        for x in layers[1:]:
            out = out.unionByName(x)
        return out

    def holders(self) -> DataFrame:
        """doc_id, keys: what each row of the documents in the index holds. A document inserted again after a deletion counts."""
        rows = self._layers(self.held, "doc_id long, keys array<binary>")
        if not self.gone:
            return rows.drop("layer")
        gone = self._layers(self.gone, "doc_id long, upto int").groupBy("doc_id").agg(F.max("upto").alias("upto"))
        return rows.join(gone, "doc_id", "left").where("upto IS NULL OR layer >= upto").select("doc_id", "keys")

    def counts(self, among: DataFrame | None = None) -> DataFrame:
        """shard, h, key, docs, top: the exact counts, or those of the keys of `among` only."""
        rows = self._layers(self.refs, REFS)
        if among is not None:
            rows = rows.join(among.select("key"), "key", "left_semi")
        if len(self.refs) > 1:
            last = F.max_by(F.struct("shard", "h", "docs", "top"), "layer").alias("s")
            rows = rows.groupBy("key").agg(last).select("key", "s.*")
        return rows.where("docs > 0").select("shard", "h", "key", "docs", "top")

    def shard_filters(self) -> DataFrame:
        rows = self._layers(self.filters, FILTERS)
        if len(self.filters) > 1:
            last = rows.groupBy("shard").agg(F.max("layer").alias("layer"))
            rows = rows.join(last, ["shard", "layer"], "left_semi")
        return rows.where("part >= 0").drop("layer")

    # ---- changes

    def _changed(self, changes: DataFrame, **more: tuple[str, ...]) -> LineIndex:
        """The state after `changes` (shard, h, key, old_docs, docs, top), already stored."""
        refs = self._store(changes.select("shard", "h", "key", "docs", "top"), "refs")
        narrow = changes.select("shard", "h", "old_docs", "docs", F.lit(self.min_docs).alias("minimum"))
        touched = self.shard_filters().join(changes.select("shard").distinct(), "shard", "left_semi")
        new = narrow.groupBy("shard").cogroup(touched.groupBy("shard")).applyInPandas(_filtered, FILTERS)
        # a shard left without keys hides its older layers by a row without a filter
        marks = changes.select("shard").distinct().select(
            "shard", F.lit("any").alias("kind"), F.lit(-1).alias("part"), F.lit(b"").alias("blob")
        )
        filters = self._store(new.unionByName(marks), "filters")
        return LineIndex(**{**self.__dict__, **more, "refs": (*self.refs, refs), "filters": (*self.filters, filters)})

    def insert(self, docs: DataFrame) -> LineIndex:
        """Count the lines of new documents. A doc_id that the index already holds is refused."""
        min_chars = self.min_chars

        def distinct_keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    keys = [list({k for _, k in digests(t, min_chars)}) for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(keys, pa.list_(pa.binary()))], names=["doc_id", "keys"]
                    )

        known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        held = self._store(known.mapInArrow(distinct_keys, "doc_id long, keys array<binary>"), "held")
        rows = self.spark.read.schema("doc_id long, keys array<binary>").parquet(held)
        if self.held and not rows.join(self.holders(), "doc_id", "left_semi").isEmpty():
            raise ValueError("some documents are in the index already; delete them first")
        batch = rows.select("doc_id", F.explode("keys").alias("key")).groupBy("key").agg(
            F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("top")
        )
        stored = self._store(batch.select(F.xxhash64("key").alias("h"), "key", "docs", "top"), "batch")
        batch = self.spark.read.schema("h long, key binary, docs long, top long").parquet(stored)
        shards = self.shards or max(LEAST_SHARDS, 1 << (-(-batch.count() // KEYS_PER_SHARD) - 1).bit_length())
        state = LineIndex(**{**self.__dict__, "shards": shards})
        batch = batch.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "key", "docs", "top")
        if not self.refs:
            changes = batch.withColumn("old_docs", F.lit(0).cast("long"))
            return state._changed(changes, held=(*self.held, held))
        asked = batch.groupBy("shard").cogroup(self.shard_filters().groupBy("shard")).applyInPandas(
            _asked, REFS + ", known boolean"
        )
        path = self._store(asked, "asked")
        asked = self.spark.read.schema(REFS + ", known boolean").parquet(path)
        new = asked.where("NOT known").select("shard", "h", "key", F.lit(0).cast("long").alias("old_docs"), "docs", "top")
        maybe = asked.where("known")
        old = self.counts(maybe).select("key", F.col("docs").alias("old_docs"), F.col("top").alias("old_top"))
        known = maybe.join(old, "key", "left").select(
            "shard", "h", "key", F.coalesce("old_docs", F.lit(0).cast("long")).alias("old_docs"),
            (F.col("docs") + F.coalesce("old_docs", F.lit(0))).alias("docs"), F.greatest("top", "old_top").alias("top"),
        )
        return state._merged(new.unionByName(known), held=(*self.held, held))

    def _merged(self, changes: DataFrame, **more: tuple[str, ...]) -> LineIndex:
        path = self._store(changes, "changes")
        return self._changed(self.spark.read.schema(REFS + ", old_docs long").parquet(path), **more)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take documents out again; `ids` has a column doc_id. Ids that the index does not hold are ignored."""
        if not self.held:
            return self
        gone = self._store(
            ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
            .withColumn("upto", F.lit(len(self.held))), "gone",
        )
        left = LineIndex(**{**self.__dict__, "gone": (*self.gone, gone)})
        out = self.spark.read.schema("doc_id long, upto int").parquet(gone)
        less = (
            self.holders().join(out, "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key"))
            .groupBy("key").agg(F.count_distinct("doc_id").alias("less"), F.max("doc_id").alias("top_gone"))
        )
        path = self._store(less, "less")
        less = self.spark.read.schema("key binary, less long, top_gone long").parquet(path)
        old = self.counts(less).join(less, "key").select(
            "shard", "h", "key", F.col("docs").alias("old_docs"), (F.col("docs") - F.col("less")).alias("docs"),
            "top", (F.col("top") == F.col("top_gone")).alias("lost"),
        )
        lost = old.where("lost AND docs > 0").select("key")
        tops = (
            left.holders().select("doc_id", F.explode("keys").alias("key")).join(lost, "key", "left_semi")
            .groupBy("key").agg(F.max("doc_id").alias("next_top"))
        )
        changes = old.join(tops, "key", "left").select(
            "shard", "h", "key", "old_docs", "docs", F.when(F.col("lost"), F.col("next_top")).otherwise(F.col("top")).alias("top")
        )
        return left._merged(changes)

    # ---- use

    def _sent_filters(self) -> tuple[Broadcast, int]:
        """The `many` filters of the shards below a number, as many as FILTER_BYTES holds, and that number."""
        many = self.shard_filters().where("kind = 'many'").withColumn("bytes", F.length("blob"))
        upto = self.shards
        while upto and (many.where(F.col("shard") < upto).agg(F.sum("bytes")).first()[0] or 0) > FILTER_BYTES:
            upto //= 2
        blobs: dict[int, list[tuple[int, bytes]]] = {}
        for r in many.where(F.col("shard") < upto).select("shard", "part", "blob").collect():
            blobs.setdefault(r.shard, []).append((r.part, bytes(r.blob)))
        return self.spark.sparkContext.broadcast({s: [b for _, b in sorted(parts)] for s, parts in blobs.items()}), upto

    def repeated_lines(self, docs: DataFrame) -> DataFrame:
        """doc_id, mark, pos: the lines of `docs` that go; `mark` tells the rows of one doc_id apart."""
        if not self.refs:
            return self.spark.createDataFrame([], "doc_id long, mark long, pos int")
        sent, upto = self._sent_filters()
        shards, min_chars = self.shards, self.min_chars
        chains: dict[int, Chain] = {}

        def may_be_many(keys: list[bytes]) -> np.ndarray:
            h = hashes(keys)
            shard = h % shards
            out = shard >= upto
            order = np.argsort(shard, kind="stable")
            names, starts = np.unique(shard[order], return_index=True)
            for s, rows in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
                if s < upto and s in sent.value:
                    if s not in chains:
                        chains[s] = Chain.load(sent.value[s])
                    out[rows] = chains[s].contains(h[rows])
            return out

        def lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    found = [list(digests(t, min_chars)) for t in part.column(2).to_pylist()]
                    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                    keys = [k for x in found for _, k in x]
                    hit = np.flatnonzero(may_be_many(keys)) if keys else np.zeros(0, np.int64)
                    place = np.array([p for x in found for p, _ in x], np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row[hit])), part.column(1).take(pa.array(row[hit])),
                         pa.array(place[hit]), pa.array([keys[i] for i in hit], pa.binary())],
                        names=["doc_id", "mark", "pos", "key"],
                    )

        known = docs.where("doc_id IS NOT NULL").select(
            F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), "text"
        )
        maybe = known.mapInArrow(lines, "doc_id long, mark long, pos int, key binary")
        many = self.counts().where(F.col("docs") >= self.min_docs).select("key", "top")
        return maybe.join(many, "key").where("doc_id <> top").select("doc_id", "mark", "pos")

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """doc_id, text, n_lines, n_dropped for every row of `docs`: the text without the lines that go."""

        def without(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    out = [kept_text(t, d) for t, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                    text, lines, gone = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(text, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())],
                        names=["doc_id", "text", "n_lines", "n_dropped"],
                    )

        drops = self.repeated_lines(docs).groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("drops"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_mark(F.col("text")).alias("mark"))
        joined = rows.join(drops, ["doc_id", "mark"], "left").select("doc_id", "text", "drops")
        return joined.mapInArrow(without, "doc_id long, text string, n_lines long, n_dropped long")


#: the same in SQL, over a table `documents`
CLEANED_SQL = f"""
WITH rows_ AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines_ AS (
    SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM rows_
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines_
), many AS (
    SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= {MIN_CHARS} AND doc_id IS NOT NULL
    GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
    SELECT r, pos, line, coalesce(doc_id <> top, false) AS gone FROM keyed LEFT JOIN many USING (k)
), kept AS (
    SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
    FROM marked GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM rows_ JOIN kept USING (r)
"""
