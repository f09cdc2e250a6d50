"""Benchmark decontamination: an index of the test items' word pairs finds candidate places, Smith-Waterman scores them.

A score of at least `threshold` leaves a trace that the search relies on, so no document is passed over. With 2 for a match
and -1 for a mismatch or a left-out word, an alignment of m matches that reaches 2 * threshold * L (L words in the item) has
lost at most 2m - 2 * threshold * L, and so

* at least threshold * L - 1 of the steps from one match to the next lose at most 1. Such a step is a pair of words that are
  neighbours, or have one word between them, in the item and in the document; the pairs begin at different words;
* the alignment spans at most (3 - 2 * threshold) * L words of the document.

1. The items' pairs make an index of sorted arrays that goes to every task, ITEM_WORDS words at a time; a larger benchmark
   takes more passes over the documents. Items too short for a sure pair (two words at a threshold of 0.5) are looked up by
   single words. Pairs of many items are left out of an item only while the count above still leaves pairs it must share.
2. A task reads each document once and keeps the places where enough different pairs of one item lie within its span. Those
   places, widened by the span, are aligned there and then: nothing is shuffled, and copies meet in no task.
3. `score` is the alignment score over that of the whole item; edits, insertions and left-out words lower it but do not break
   the alignment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.rows import text_key
from barwright.llm.words import PLACE, U, Words, mix, slices

THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: words of items in one index (about 50 MB), and bits of the table that most pairs of a document are turned away by
ITEM_WORDS, FILTER_BITS = 1 << 20, 1 << 26
#: pairs that more items hold are left out where that is safe
COMMON = 16
#: meetings of a pair of a document and one of an item that are looked at together
MEETINGS = 1 << 22


def pair_hashes(w: Words, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the pairs of words that are `apart` words from each other in one text; 0: the single words."""
    n = max(0, len(w.hash) - apart)
    if not apart:
        return mix(w.hash * PLACE[2]), np.arange(n)
    place = np.flatnonzero(w.doc[:n] == w.doc[apart:])
    return mix(w.hash[place] * PLACE[0] + w.hash[place + apart] * PLACE[1]), place


def least(x: float) -> int:
    """The smallest whole number that is not below x, but for rounding."""
    return math.ceil(x - 1e-9)


class Index:
    """Items of one pass: hashes in order with the item of each; `need` pairs within `span` words make a candidate."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float):
        self.ids, self.threshold = np.array(ids, np.int64), threshold
        self.words: list[np.ndarray] = []
        self.need, self.span = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, _, data, at in slices(pa.array(texts, pa.string())):
            w = Words(data, at)
            self.words += [w.hash[w.first[k] : w.first[k + 1]] for k in range(len(w.count))]
            part = slice(lo, lo + len(w.count))
            self.need[part] = [least(threshold * n - 1) for n in w.count]
            self.span[part] = [least((3 - 2 * threshold) * n) for n in w.count]
            short = self.need[part] < 1
            self.need[part] = np.where(short, [max(1, least(threshold * n)) for n in w.count], self.need[part])
            for apart in range(3):
                h, place = pair_hashes(w, apart)
                own = short[w.doc[place]] == (apart == 0)
                h, place = h[own], place[own]
                rows.append((h, w.doc[place] + lo, place - w.first[w.doc[place]]))
        h, item, place = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, U), *np.zeros((2, 0), np.int64))
        h, item = self.without_common(h, item, place)
        order = np.lexsort((item, h))
        h, item = h[order], item[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
        self.item = item[new]
        self.hash, self.first, self.held = np.unique(h[new], return_index=True, return_counts=True)
        self.single = any(len(x) and least(threshold * len(x) - 1) < 1 for x in self.words)

    def without_common(self, h: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves out the begin words with the most widely held pairs, as far as `need` stays at 1 or more."""
        if not len(h):
            return h, item
        _, of, count = np.unique(h, return_inverse=True, return_counts=True)
        # a begin word counts as the more common of its two pairs
        order = np.lexsort((-count[of], place, item))
        item_, place_ = item[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (item_[1:] != item_[:-1]) | (place_[1:] != place_[:-1])
        begin = np.cumsum(new) - 1
        of_item, common = item_[new], count[of][order][new]
        by = np.lexsort((-common, of_item))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - np.searchsorted(of_item, of_item[by])
        out = (common > COMMON) & (rank < self.need[of_item] - 1)
        np.subtract.at(self.need, of_item[out], 1)
        kept = ~out[begin]
        return h[order][kept], item_[kept]


class Finder:
    """Finds and aligns the index's items in documents."""

    def __init__(self, index: Index):
        self.index = index
        self.bits = max(10, min(FILTER_BITS, 32 * max(1, len(index.hash))).bit_length() - 1)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(index.hash >> U(64 - self.bits)).astype(np.int64)] = True

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of a pair, number of its hash in the index), ordered by place."""
        out = []
        for apart in (0, 1, 2) if self.index.single else (1, 2):
            h, place = pair_hashes(w, apart)
            likely = np.flatnonzero(self.table[(h >> U(64 - self.bits)).astype(np.int64)])
            h, place = h[likely], place[likely]
            at = np.minimum(np.searchsorted(self.index.hash, h), len(self.index.hash) - 1)
            same = self.index.hash[at] == h
            out.append((place[same], at[same]))
        place, at = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], at[order]

    def candidates(self, w: Words) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, last word) of each run of places with enough pairs of the item within its span."""
        place, at = self.hits(w)
        if not len(place):
            return
        total = np.cumsum(self.index.held[at])
        ends = np.append(np.flatnonzero(w.doc[place[1:]] != w.doc[place[:-1]]) + 1, len(place))
        lo = 0
        while lo < len(place):
            fits = ends[(ends > lo) & (total[ends - 1] <= MEETINGS + (total[lo - 1] if lo else 0))]
            hi = int(fits[-1]) if len(fits) else int(ends[ends > lo][0])
            yield from self.runs(w, place[lo:hi], at[lo:hi])
            lo = hi

    def runs(self, w: Words, place: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        x = self.index
        n = x.held[at]
        which = np.repeat(x.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, place = x.item[which], np.repeat(place, n)
        order = np.lexsort((place, item, w.doc[place]))
        item, place = item[order], place[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1])
        item, place = item[new], place[new]
        doc = w.doc[place]
        # the place that is `need` - 1 further on in the same document and item lies within the span
        far = np.arange(len(item)) + x.need[item] - 1
        end = np.minimum(far, len(item) - 1)
        good = np.flatnonzero((far < len(item)) & (item[end] == item) & (doc[end] == doc) & (place[end] - place < x.span[item]))
        for k in good:
            i, d, reach = int(item[k]), int(doc[k]), int(x.span[item[k]])
            yield d, i, max(int(w.first[d]), int(place[k]) - reach), min(int(w.first[d + 1]) - 1, int(place[end[k]]) + 1 + reach)

    def passages(self, w: Words) -> Iterator[tuple[int, int, int, int, set[int]]]:
        """(document, item id, first word, last word, items): candidates of one document and item id that touch are one."""
        ids = self.index.ids
        found = sorted((d, int(ids[i]), lo, hi, i) for d, i, lo, hi in self.candidates(w))
        run: tuple[int, int, int, int, set[int]] | None = None
        for d, key, lo, hi, i in found:
            if run and run[:2] == (d, key) and lo <= run[3] + 1:
                run = (d, key, run[2], max(run[3], hi), run[4] | {i})
            else:
                if run:
                    yield run
                run = (d, key, lo, hi, {i})
        if run:
            yield run

    def rows(self, w: Words) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, item id, score, first word, last word) of the passages that reach the threshold."""
        for d, key, lo, hi, items in self.passages(w):
            best = (-1.0, 0, 0)
            for i in sorted(items):
                words = self.index.words[i]
                s, x, y = align(w.hash[lo : hi + 1], words)
                if s / (MATCH * len(words)) > best[0]:
                    best = (s / (MATCH * len(words)), x, y)
            if best[0] >= self.index.threshold:
                at = lo - int(w.first[d])
                yield d, key, best[0], at + best[1], at + best[2]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word hashes with linear gaps: best score, and the first and last word of it in `a`.

    One numpy pass over `a` for each word of `b`. Ties take the alignment that ends, then starts, first.
    """
    n = len(a)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    fall = -GAP * np.arange(n + 1)
    best = (0, 0, 0)
    for word in b:
        diag = score[:-1] + np.where(a == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        s = np.concatenate([[0], np.maximum(np.maximum(diag, up), 0)])
        f = np.concatenate([[0], np.where(diag >= up, start[:-1], start[1:])])
        f = np.where(s > 0, f, np.arange(n + 1))
        # gaps along a: the best earlier cell, less the distance to it
        lifted = s + fall
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score, start = top - fall, f[source]
        empty = score <= 0
        score[empty], start[empty] = 0, np.arange(n + 1)[empty]
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k - 1)
    return best


def passes(items: DataFrame, threshold: float) -> Iterator[Index]:
    """The items as indexes of about ITEM_WORDS words; texts of one item id stay together."""
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = -(-size // ITEM_WORDS)
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).select("item_id", "text").distinct().collect()
        index = Index([r.item_id for r in rows], [r.text for r in rows], threshold)
        if len(index.hash):
            yield index


def contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, item_id, score, first_word, last_word: a row for each passage of a document that scores >= threshold.

    Words count from 0. Null or empty texts and items match nothing. Repeated items with one id are aligned each, and the
    best score is kept. Repeated documents give a row each. Empty tables: no rows. `threshold` is above 0 and at most 1.
    """
    spark = docs.sparkSession
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    schema = "doc_id long, text_key long, item_id long, score double, first_word long, last_word long"

    def found(index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value)
            for b in it:
                for lo, _, data, at in slices(b.column(1)):
                    rows = list(finder.rows(Words(data, at)))
                    if rows:
                        doc, item, score, first, last = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([lo + d for d in doc])), b.column(2).take(pa.array([lo + d for d in doc])), pa.array(item, pa.int64()), pa.array(score, pa.float64()),
                             pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                            names=["doc_id", "text_key", "item_id", "score", "first_word", "last_word"],
                        )

        return docs.mapInArrow(batches, schema)

    parts = [found(index) for index in passes(items, threshold)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
