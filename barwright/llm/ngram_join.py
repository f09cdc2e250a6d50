"""Exact similarity join of documents on their word n-gram sets (Jaccard), for connected components of similar texts.

1. Count n-grams in a sketch of fixed size and give every document its set size and a 128-bit name of its set. Equal
   sets are one node from here on, so copies are never paired.
2. Order each node's n-grams rare first (by sketch count, then hash) and keep the prefix any similar set must meet.
3. Group nodes by prefix n-gram. A pair must pass the length filter and, at its first common n-gram, the positional
   filter. First only the most central node of each group is paired with the others (a star: linear in the group).
   Pairs then pass a suffix filter (counts of both sets in fixed hash ranges) and are verified once, on whole texts.
4. What the stars linked is one component. Only groups that still hold several components are paired further, and only
   across components, in blocks of bounded size: a link inside a component cannot change it. No other pair is left out.

Groups expected to be large are salted by node; their centre is found by an aggregate with map-side combine.
N-grams are 64-bit hashes; two different ones are taken for the same with probability about 1e-19 a pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.components import components
from barwright.llm.rows import text_key
from barwright.llm.tables import written
from barwright.llm.words import U, Words, gram_sets, mix, signed, slices

SKETCH_BITS = 20
BLOCK = 1 << 16
SALT_ROWS = 4096
PAIR_BLOCK = 2048
PARTS = 64


def _set_name(h: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """16 bytes for each text that depend on its set of hashes alone."""
    name = np.zeros((texts, 2), U)
    if len(h):
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        name[doc[at], 0] = np.add.reduceat(mix(h), at)
        name[doc[at], 1] = np.add.reduceat(mix(h ^ U(0xA0761D6478BD642F)), at)
    return name


def _names(name: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() if k else None for x, k in zip(name, n, strict=True)], pa.binary())


def scan(docs: DataFrame, gram: int) -> DataFrame:
    """One row (doc_id, text_key, n, name) for each document and, for each task, rows (block, counts) of the sketch; written once."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in it:
            for lo, hi, data, at in slices(b.column(1)):
                h, doc = gram_sets(Words(data, at), gram)
                counts += np.bincount((h >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                n = np.bincount(doc, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n), _names(_set_name(h, doc, hi - lo), n),
                     pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names=names,
                )
        filled = [k for k in range(0, len(counts), BLOCK) if counts[k : k + BLOCK].any()]
        if filled:
            blobs = [zlib.compress(counts[k : k + BLOCK].tobytes(), 1) for k in filled]
            m = len(filled)
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.binary()),
                 pa.array([k // BLOCK for k in filled], pa.int32()), pa.array(blobs, pa.binary())], names=names,
            )

    names = ["doc_id", "text_key", "n", "name", "block", "counts"]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    return written(d.mapInArrow(batches, "doc_id long, text_key long, n long, name binary, block int, counts binary"), "scan")


def sketch(scanned: DataFrame) -> np.ndarray:
    """The summed sketch: 2**SKETCH_BITS numbers whatever the input, added up block by block on the executors."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(blob), np.int64)
                total[k] = total[k] + x if k in total else x
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
                names=["block", "counts"],
            )

    part = scanned.where("block IS NOT NULL").select("block", "counts")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in part.repartition((1 << SKETCH_BITS) // BLOCK, "block").mapInArrow(batches, "block int, counts binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    return out


def prefix_nodes(docs: DataFrame, counts, gram: int, percent: int) -> DataFrame:
    """One row for each different set: node, name, n, prefix (hashes, rare first), central (mean log count)."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = counts.value
        for b in it:
            for lo, hi, data, at in slices(b.column(0)):
                h, doc = gram_sets(Words(data, at), gram)
                n = np.bincount(doc, minlength=hi - lo)
                name = _set_name(h, doc, hi - lo)
                f = freq[(h >> U(64 - SKETCH_BITS)).astype(np.int64)]
                central = np.bincount(doc, weights=np.log2(f + 1.0), minlength=hi - lo) / np.maximum(n, 1)
                order = np.lexsort((h, f, doc))
                h, first = h[order], np.concatenate([[0], np.cumsum(n)])
                keep = n - (percent * n + 99) // 100 + 1
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name[i].tobytes() for i in some], pa.binary()), pa.array(n[some].astype(np.int32)),
                     pa.array([h[first[i] : first[i] + keep[i]].tobytes() for i in some], pa.binary()),
                     pa.array(central[some].astype(np.float32))], names=["name", "n", "prefix", "central"],
                )

    rows = docs.select("text").mapInArrow(batches, "name binary, n int, prefix binary, central float")
    return written(rows.dropDuplicates(["name"]).withColumn("node", F.monotonically_increasing_id()), "nodes")


def postings(nodes: DataFrame, counts) -> DataFrame:
    """token, salt, node, n, at (place in the order), central: a row for each prefix n-gram of a node."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = counts.value
        for b in it:
            for lo in range(0, b.num_rows, 2048):
                p = b.slice(lo, 2048)
                blobs = p.column(2).to_pylist()
                size = np.array([len(x) // 8 for x in blobs])
                token = np.frombuffer(b"".join(blobs), U)
                who = np.repeat(np.arange(len(blobs)), size)
                at = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                node = p.column(0).to_numpy()[who]
                salts = np.maximum(1, freq[(token >> U(64 - SKETCH_BITS)).astype(np.int64)] // SALT_ROWS)
                salt = (mix(node.astype(U)) % salts.astype(U)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(token)), pa.array(np.where(salts > 1, salt, -1).astype(np.int32)), pa.array(node),
                     pa.array(p.column(1).to_numpy()[who]), pa.array(at.astype(np.int32)),
                     pa.array(p.column(3).to_numpy()[who])], names=["token", "salt", "node", "n", "at", "central"],
                )

    return nodes.select("node", "n", "prefix", "central").mapInArrow(
        batches, "token long, salt int, node long, n int, at int, central float"
    )


def may_link(n_a, n_b, at_a, at_b, percent: int):
    """Length filter, and positional filter for a first common n-gram at these places. Columns or arrays."""
    least = percent * (n_a + n_b)
    low, high = (np.minimum, np.maximum) if not isinstance(n_a, Column) else (F.least, F.greatest)
    return (percent * high(n_a, n_b) <= 100 * low(n_a, n_b)) & ((100 + percent) * low(n_a - at_a, n_b - at_b) >= least)


def stars(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each group's most central node with the others, and the rows of groups that hold more than a pair.

    Streams sorted groups: a group is never held. Rows of groups of one are dropped here.
    """
    cols = ["token", "salt", "node", "n", "at"]
    kinds = [np.int64, np.int32, np.int64, np.int32, np.int32]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, k) for k in kinds]  # the open group's first two rows
        seen = 0  # rows of the open group so far
        for b in it:
            new = [np.concatenate([h, b.column(k).to_numpy()]) for k, h in enumerate(held)]
            token, salt, node, n, at = new
            old = len(held[0])
            start = np.ones(len(token), bool)
            start[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            begin = np.flatnonzero(start)
            size = np.diff(np.append(begin, len(token)))
            hub = np.repeat(begin, size)
            index = np.arange(len(token)) - hub
            total = np.repeat(size, size)
            if old:
                index[(hub == 0) & (np.arange(len(token)) >= old)] += seen - old
                total[hub == 0] += seen - old
            fresh = np.arange(len(token)) >= old
            ok = fresh & (index > 0) & may_link(
                n[hub].astype(np.int64), n.astype(np.int64), at[hub].astype(np.int64), at.astype(np.int64), percent
            )
            if ok.any():
                m = int(ok.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(node[ok]), pa.array(n[ok]),
                     pa.nulls(m, pa.int32()), pa.array(node[hub[ok]]), pa.array(n[hub[ok]])], names=names,
                )
            more = (fresh & ((total > 2) | (salt >= 0))) | (~fresh & (total > 2) & (seen <= 2) & (salt < 0))
            if more.any():
                m = int(more.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[more]), pa.array(salt[more]), pa.array(node[more]), pa.array(n[more]),
                     pa.array(at[more]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], names=names,
                )
            last = begin[-1]
            seen = int(total[last])
            held = [x[last : last + 2] for x in new]

    names = [*cols, "hub", "hub_n"]
    dealt = posts.repartition("token", "salt").sortWithinPartitions("token", "salt", F.desc("central"), "node")
    return written(
        dealt.select(*cols).mapInArrow(batches, "token long, salt int, node long, n int, at int, hub long, hub_n int"), "stars"
    )


def ordered(d: DataFrame) -> DataFrame:
    """Each pair once, the smaller node first: a, n_a, b, n_b."""
    first = F.col("node") < F.col("hub")
    return d.where("node <> hub").select(
        F.when(first, F.col("node")).otherwise(F.col("hub")).alias("a"),
        F.when(first, F.col("hub")).otherwise(F.col("node")).alias("b"),
    ).distinct()


def central_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Star pairs of salted groups over the whole group: the centre comes from an aggregate combined before the shuffle."""
    salted = rows.where("hub IS NULL AND salt >= 0").select("token", "node", "n", "at")
    hubs = salted.groupBy("token").agg(F.min(F.struct("at", "node", "n")).alias("h"), F.count("*").alias("size")).where("size > 1")
    return salted.join(hubs, "token").where(
        may_link(F.col("h.n"), F.col("n"), F.col("h.at"), F.col("at"), percent)
    ).select("node", F.col("h.node").alias("hub"))


def cross_pairs(rows: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components in groups that still hold several; in blocks of about PAIR_BLOCK rows.

    A large group's rows are dealt into blocks by node and every two blocks meet in a task of their own.
    """
    named = rows.where("hub IS NULL").select("token", "node", "n", "at").join(roots, "node", "left")
    named = written(named.withColumn("root", F.coalesce("root", "node")), "groups")
    groups = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(float(PAIR_BLOCK))).cast("int")
    open_ = groups.where("lo < hi").select("token", blocks.alias("blocks"))
    cells = (
        named.join(open_, "token")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "n", "at", "root")
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in it:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            a = [t.column(k).to_numpy() for k in range(8)]
            edge = np.flatnonzero((a[0][1:] != a[0][:-1]) | (a[1][1:] != a[1][:-1]) | (a[2][1:] != a[2][:-1])) + 1
            last = int(edge[-1]) if len(edge) else 0
            if last:
                yield from _pairs([x[:last] for x in a], edge[:-1], percent)
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield from _pairs([held.column(k).to_numpy() for k in range(8)], np.zeros(0, int), percent)

    dealt = cells.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "n", "node")
    return dealt.mapInArrow(batches, "node long, hub long")


def _pairs(a: list[np.ndarray], edges: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of each cell (rows ordered by n), row by row against the rows after it that the length filter allows."""
    left, right, held = [], [], 0
    for lo, hi in zip([0, *edges], [*edges, len(a[0])], strict=True):
        x, y, own, node, root = a[1][lo], a[2][lo], a[3][lo:hi], a[4][lo:hi], a[7][lo:hi]
        n, at = a[5][lo:hi].astype(np.int64), a[6][lo:hi].astype(np.int64)
        stop = np.searchsorted(n, 100 * n // percent, "right")
        for i in range(hi - lo):
            s = slice(i + 1, stop[i])
            ok = (root[s] != root[i]) & may_link(n[s], n[i], at[s], at[i], percent)
            if x != y:
                ok &= own[s] != own[i]
            if ok.any():
                right.append(node[s][ok])
                left.append(np.full(len(right[-1]), node[i]))
                held += len(right[-1])
        if held > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["node", "hub"])
            left, right, held = [], [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["node", "hub"])


# --------------------------------------------------------------------------------------------------- verification

#: bits of the filter that picks the texts to fetch: 8 MB at any size; when it fills up, more texts are fetched
FILTER_BITS = 1 << 26


def filter_places(name: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bit for each 16-byte name, from its first four bytes, as in `filter_place`."""
    return name.view(">u4")[:, 0].astype(np.int64) % bits


def filter_place(name: Column, bits: int) -> Column:
    return F.conv(F.hex(F.substring(name, 1, 4)), 16, 10).cast("long") % F.lit(bits)


def texts_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, gram: int) -> DataFrame:
    """node, text for every node in a pair. Texts are looked at where they are; only those needed leave the Python task."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "name"), "node")
    wanted = written(wanted, "wanted")
    size = FILTER_BITS
    bit = filter_place(F.col("name"), size) + 1
    marks = wanted.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    ).collect()
    table = np.zeros(size // 8, np.uint8)
    for r in marks:
        x = np.frombuffer(bytes(r.bits), np.uint8)[: len(table)]
        table[(r.k - 1) * 4096 : (r.k - 1) * 4096 + len(x)] = x
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi, data, at in slices(b.column(0)):
                h, doc = gram_sets(Words(data, at), gram)
                name = _set_name(h, doc, hi - lo)
                p = filter_places(name, size)
                hit = (sent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                some = np.flatnonzero(hit & (np.bincount(doc, minlength=hi - lo) > 0))
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name[i].tobytes() for i in some], pa.binary()),
                         b.column(0).slice(lo, hi - lo).take(pa.array(some))], names=["name", "text"],
                    )

    hit = docs.select("text").mapInArrow(batches, "name binary, text string").dropDuplicates(["name"])
    found = written(wanted.join(hit, "name").select("node", "text"), "texts")
    sent.unpersist()
    return found


def verify(pairs: DataFrame, texts: DataFrame, gram: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose n-gram sets are similar enough; each is computed once, from both whole texts."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 256):
                p = b.slice(lo, 256)
                ok = similar(p.column(2), p.column(3), gram, percent)
                yield pa.RecordBatch.from_arrays(
                    [p.column(0).filter(pa.array(ok)), p.column(1).filter(pa.array(ok))], names=["a", "b"]
                )

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(batches, "a long, b long"), "links")


def similar(left: pa.Array, right: pa.Array, gram: int, percent: int) -> np.ndarray:
    """Row by row: 100 * common >= percent * union. Pairs that the suffix filter excludes are not intersected."""
    m = len(left)
    sides = []
    for texts in (left, right):
        hs, ds = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for lo, _, data, at in slices(texts):
            h, doc = gram_sets(Words(data, at), gram)
            hs.append(h)
            ds.append(doc + lo)
        sides.append((np.concatenate(hs), np.concatenate(ds)))
    size = [np.bincount(d, minlength=m) for _, d in sides]
    part = [np.bincount(d * PARTS + (h >> U(58)).astype(np.int64), minlength=m * PARTS).reshape(m, PARTS) for h, d in sides]
    most = np.minimum(*part).sum(axis=1)
    maybe = (100 + percent) * most >= percent * (size[0] + size[1])
    h = np.concatenate([x[maybe[d]] for x, d in sides])
    d = np.concatenate([d[maybe[d]] for _, d in sides])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    common = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=m) if len(h) else np.zeros(m, int)
    return maybe & ((100 + percent) * common >= percent * (size[0] + size[1])) & (size[0] > 0)


# ----------------------------------------------------------------------------------------------------- the operator


def similar_components(docs: DataFrame, *, gram: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, component_key for every row of docs (columns doc_id, text; others are ignored).

    Two texts are linked when they share at least `percent` in a hundred of the union of their sets of `gram`-word
    n-grams; component_id is the smallest doc_id reachable, and component_key names the component itself: two of them have
    one component_id where a repeated doc_id has texts in both. A text with fewer words has one n-gram, all its words. Null
    text, and text without words, has none and is linked with nothing. A repeated doc_id keeps a row for each. Empty
    table: no rows.
    """
    spark = docs.sparkSession
    scanned = scan(docs, gram)
    counts = spark.sparkContext.broadcast(sketch(scanned))
    nodes = prefix_nodes(docs, counts, gram, percent)
    rows = stars(postings(nodes, counts), percent)
    tried = written(
        ordered(rows.where("hub IS NOT NULL").select("node", "hub").unionByName(central_pairs(rows, percent))), "tried"
    )
    links = verify(tried, texts_of(docs, nodes, tried, gram), gram, percent)
    roots = written(components(links), "roots")
    more = written(ordered(cross_pairs(rows, roots, percent)).join(tried, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        links = links.unionByName(verify(more, texts_of(docs, nodes, more, gram), gram, percent))
        roots = written(components(links), "roots")
    counts.unpersist()

    each = scanned.where("block IS NULL").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "name")
    least = each.where("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("least"))
    linked = nodes.select("node", "name").join(roots, "node").join(least, "name")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    linked = linked.join(smallest, "root").select("name", "smallest", F.concat(F.lit("r"), F.col("root").cast("string")).alias("key"))
    ids = least.join(linked, "name", "left").select(
        "name", F.coalesce("smallest", "least").alias("component_id"), F.coalesce("key", F.hex("name")).alias("component_key")
    )
    named = each.where("name IS NOT NULL").join(ids, "name").select("doc_id", "text_key", "n_shingles", "component_id", "component_key")
    # texts without words need no join, so their rows never gather
    bare = each.where("name IS NULL").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("component_key"))
    return named.unionByName(bare)
