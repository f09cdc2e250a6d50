"""Toxicity by two class-conditional Kneser-Ney models over the bytes of words.

Counts come from distinct words: every document adds to the corpus counts, and labelled training rows add to the counts
of their class. The long orders (SHARED + 1 to ORDER) are counted for each class, the short ones for the whole corpus, so
both classes back off to the same counts and a rare expression differs only by what its class has seen of it. Below the
highest order, and except at the start of a word, an n-gram counts the different bytes that come before it.

The n-gram tables are Spark tables and grow with the corpus. What is sent to the tasks are their exact counts, as far as an
order is read: they grow with the different n-grams of the labelled rows, and no n-gram reads the count of another. A text's
log-likelihoods are computed where the text is, once for each different word of a batch.

The class log-likelihoods are compared per byte over the whole text and over its most toxic word and run of PASSAGE
words, since a long text may be toxic in a few words. On training rows kept out of the counts, a logistic curve through a
bounded sample of them (`sample` rows, the ones with the smallest hash) turns the comparisons into a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.rows import text_key
from barwright.llm.tables import written
from barwright.llm.words import U, Words, mix, slices

ORDER, SHARED, DISCOUNT = 6, 3, 0.75
SPACE = 32
CLASSES = ("toxic", "plain")
PASSAGE = 8
#: bytes of text worked on at a time in a task, beside the model's tables
SLICE = 1 << 19
#: a word counts as toxic by so much in log-likelihood
MARGIN = 2.0
LIKELIHOODS = ["toxic_ll", "plain_ll", "n_bytes", "n_words", "peak", "passage", "excess"]


def stream(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, each between two spaces, with the word of each byte and its place in the word."""
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.int64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    return data, word, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)


def gram_codes(data: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes up to each position as one number, -1 where the word has fewer before it."""
    code = np.zeros(len(data), np.int64)
    for j in range(k):
        code[j:] |= data[: len(data) - j] << (8 * j)
    return np.where(place >= k - 1, code, -1)


def word_table(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """word, toxic, plain, whole: how often the rows of each class and the corpus have it.

    classes: doc_id, toxic (0 or 1), a bounded number of counted training documents; they are sent to the tasks, so texts
    stay where they are. Words are counted in each slice before they leave the task.
    """
    marks = classes.toPandas().sort_values("doc_id")
    sent = docs.sparkSession.sparkContext.broadcast((marks["doc_id"].to_numpy(np.int64), marks["toxic"].to_numpy(np.int64)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = sent.value
        for b in it:
            doc_id = b.column(0).fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, doc_id), max(0, len(ids) - 1))
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False) & (ids[at] == doc_id if len(ids) else False)
            kind = np.where(known, toxic[at] if len(ids) else 0, 2)
            for lo, hi, data, offsets in slices(b.column(1), SLICE):
                w = Words(data, offsets)
                _, first, inverse, whole = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
                if not len(first):
                    continue
                of = kind[lo:hi][w.doc]
                each = [np.bincount(inverse[of == k], minlength=len(first)) for k in (1, 0)]
                low = data.tobytes().lower()  # bytes.lower() changes A-Z only
                yield pa.RecordBatch.from_arrays(
                    [pa.array([low[w.start[i] : w.end[i]] for i in first], pa.binary()).cast(pa.string()), *(pa.array(x.astype(np.int64)) for x in (*each, whole))],
                    names=["word", *CLASSES, "whole"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = rows.mapInArrow(batches, "word string, toxic long, plain long, whole long")
    return written(counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in (*CLASSES, "whole")]), "words")


def gram_table(words: DataFrame) -> DataFrame:
    """order, code, toxic, plain, whole: Kneser-Ney counts of every order."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                data, word, place = stream([w.encode() for w in part.column(0).to_pylist()])
                counts = [part.column(k).to_numpy() for k in (1, 2, 3)]
                for k in range(1, ORDER + 1):
                    # shorter n-grams are counted here only at the start of a word
                    at = np.flatnonzero((place >= k - 1) & (place > 0) if k == ORDER else place == k - 1)
                    at = at[place[at] > 0]
                    if len(at):
                        code = gram_codes(data, place, k)[at]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), k, np.int32)), pa.array(code), *(pa.array(c[word[at]]) for c in counts)],
                            names=["order", "code", *CLASSES, "whole"],
                        )

    raw = words.select("word", *CLASSES, "whole").mapInArrow(batches, "order int, code long, toxic long, plain long, whole long")
    sums = [F.sum(c).alias(c) for c in (*CLASSES, "whole")]
    raw = written(raw.groupBy("order", "code").agg(*sums), "raw")
    level = raw.where(F.col("order") == ORDER)
    levels = [level]
    for k in range(ORDER - 1, 0, -1):
        less = level.select(F.col("code").bitwiseAND((1 << (8 * k)) - 1).alias("code"), *CLASSES, "whole")
        less = less.groupBy("code").agg(*(F.count_if(F.col(c) > 0).alias(c) for c in (*CLASSES, "whole")))
        both = less.select(F.lit(k).alias("order"), "code", *CLASSES, "whole").unionByName(raw.where(F.col("order") == k))
        level = written(both.groupBy("order", "code").agg(*sums), f"order{k}")
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


class Table:
    """Exact counts by key in an open-addressed table; an absent key reads zeros. Its size follows the number of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.slots = np.zeros(self.mask + 1, np.int32)  # number of the key and one, 0: free
        # a key and a row of zeros stand for absent keys
        self.keys = np.concatenate([[-1], keys]).astype(np.int64)
        self.values = np.concatenate([np.zeros((1, values.shape[1]), np.float32), values.astype(np.float32)])
        left = np.arange(1, len(keys) + 1)
        at = self.home(keys)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]  # of several keys the last one stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(U) * U(0x9E3779B97F4A7C15)) & U(self.mask)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of `values` for each key."""
        at = self.home(keys)
        out = self.slots[at]
        left = np.flatnonzero((out > 0) & (self.keys[out] != keys))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            out[left] = self.slots[at[left]]
            left = left[(out[left] > 0) & (self.keys[out[left]] != keys[left])]
        return out


def gathered(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a table with a column `key`; packed arrays come to the driver, not rows."""
    def packs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                values = np.stack([b.column(k).to_numpy() for k in range(1, len(columns) + 1)], axis=1).astype(np.float32)
                blobs = [b.column(0).to_numpy().astype(np.int64).tobytes(), values.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x, 1)], pa.binary()) for x in blobs], names=["keys", "counts"])

    keys, values = [np.zeros(0, np.int64)], [np.zeros((0, len(columns)), np.float32)]
    for r in df.select("key", *columns).mapInArrow(packs, "keys binary, counts binary").toLocalIterator():
        keys.append(np.frombuffer(zlib.decompress(r.keys), np.int64))
        values.append(np.frombuffer(zlib.decompress(r.counts), np.float32).reshape(-1, len(columns)))
    return np.concatenate(keys), np.concatenate(values)


class Model:
    """Counts of n-grams, and of contexts (total, kinds), for the classes and the corpus, as far as an order reads them.

    Keys are the bytes of an n-gram or context with its order above them, so different ones never meet.
    """

    def __init__(self, grams: DataFrame):
        read = [*CLASSES, "whole"]
        grams = grams.where(
            f"(order <= {SHARED} AND whole > 0) OR (order > {SHARED} AND ({' + '.join(CLASSES)}) > 0)"
        )
        order = F.shiftleft(F.col("order").cast("long"), 48)
        both = [c for r in read for c in (F.sum(r).alias(r), F.count_if(F.col(r) > 0).alias(f"{r}_kinds"))]
        contexts = grams.groupBy((order + F.shiftright("code", 8)).alias("key")).agg(*both)
        self.grams = Table(*gathered(grams.select((order + F.col("code")).alias("key"), *read), read))
        self.contexts = Table(*gathered(contexts, [*read, *(f"{r}_kinds" for r in read)]))

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """words x 2: log-likelihood of each word's bytes and its end under both classes."""
        data, word, place = stream(words)
        p = np.full((len(data), 2), 1 / 256)
        for k in range(1, ORDER + 1):
            code = gram_codes(data, place, k)
            at = np.flatnonzero((code >= 0) & (place > 0))
            order = np.int64(k << 48)
            counts = self.contexts.values[self.contexts.rows((code[at] >> 8) + order)]
            # an n-gram is looked up only where its context was seen
            some = np.flatnonzero(counts[:, 2] > 0 if k <= SHARED else counts[:, 0] + counts[:, 1] > 0)
            at, counts = at[some], counts[some]
            t, kinds = counts[:, :3], counts[:, 3:]
            c = self.grams.values[self.grams.rows(code[at] + order)]
            for j in range(2):
                col = 2 if k <= SHARED else j
                total = np.maximum(t[:, col], 1e-9)
                q = (np.maximum(c[:, col] - DISCOUNT, 0) + DISCOUNT * kinds[:, col] * p[at, j]) / total
                p[at, j] = np.where(t[:, col] > 0, np.clip(q, 1e-12, 1.0), p[at, j])
        logs = np.where((place > 0)[:, None], np.log(p), 0.0)
        return np.stack([np.bincount(word, logs[:, j], len(words)) for j in range(2)], axis=1)


class KnownWords:
    """Log-likelihoods of the words a task has met, ordered by word hash; forgotten when there are more than `most`."""

    def __init__(self, model: Model, most: int = 1 << 17):
        self.model, self.most = model, most
        self.hashes, self.logs = np.zeros(0, U), np.zeros((0, 2))

    def of(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """hashes x 2, for different words in the order of their hashes, with their bytes' begins and ends in `data`."""
        if len(self.hashes) + len(hashes) > self.most:
            self.hashes, self.logs = self.hashes[:0], self.logs[:0]
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = np.flatnonzero(at < len(self.hashes))
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        out = np.zeros((len(hashes), 2))
        out[known] = self.logs[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            low = data.tobytes().lower()  # bytes.lower() changes A-Z only
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                out[part] = self.model.word_logs([low[start[i] : end[i]] for i in part])
            self.hashes, self.logs = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.logs, at[new], out[new], axis=0)
        return out


def largest(values: np.ndarray, words: Words, texts: int) -> np.ndarray:
    """The largest value of each text's words; 0 without words."""
    out = np.zeros(texts)
    some = words.count > 0
    if some.any():
        out[some] = np.maximum.reduceat(values, words.first[:-1][some])
    return out


def log_likelihoods(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key and LIKELIHOODS for every row; no shuffle.

    peak and passage: the largest difference of a word, and of PASSAGE words in a row (or all, if fewer); excess: the sum
    of what the differences of single words exceed MARGIN by.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownWords(sent.value)
        for b in it:
            for lo, hi, data, at in slices(b.column(1), SLICE):
                w = Words(data, at)
                different, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
                logs = known.of(different, data, w.start[first], w.end[first])
                n = hi - lo
                ll = [np.bincount(w.doc, logs[inverse, j], n) for j in range(2)]
                size = np.bincount(w.doc, (w.end - w.start + 1).astype(float), n)
                more = logs[inverse, 0] - logs[inverse, 1]
                total = np.concatenate([[0.0], np.cumsum(more)])
                begin = np.arange(len(more))
                run = total[np.minimum(begin + PASSAGE, w.first[1:][w.doc])] - total[begin]
                excess = np.bincount(w.doc, np.maximum(more - MARGIN, 0.0), n)
                columns = (*ll, size, w.count.astype(float), largest(more, w, n), largest(run, w, n), excess)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), b.column(2).slice(lo, n), *(pa.array(x) for x in columns)],
                    names=["doc_id", "text_key", *LIKELIHOODS],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key")).mapInArrow(
        batches, ", ".join(["doc_id long", "text_key long", *(f"{c} double" for c in LIKELIHOODS)])
    )


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Ridge logistic weights by Newton steps; the first column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        w = w - step / max(1.0, size / 5)
        if size < 1e-8:
            break
    return w


def contrast() -> list[Column]:
    """The log-likelihood difference per byte, the same in units of its spread, which falls with the root of length, and
    the differences of the most toxic words, which grow with the number of words."""
    per_byte = (F.col("toxic_ll") - F.col("plain_ll")) / F.greatest(F.col("n_bytes"), F.lit(1.0))
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1.0)))
    return [per_byte * 10, per_byte * root, F.log1p("n_words"), F.col("peak"), F.col("passage"), F.log1p("excess")]


def toxicity_scores(docs: DataFrame, labelled: DataFrame, *, sample: int = 20_000, counted: int = 200_000) -> DataFrame:
    """doc_id, text_key, score (0 to 1), predicted (score >= 0.5), n_words, for every row of docs.

    labelled: doc_id, toxic (0 or 1); other values and null keys are left out, and of a repeated key one row counts, the
    toxic one. A quarter of its rows, by a hash of the id, sets the curve, the rest the class counts (at most `counted` rows,
    those with the smallest hash; the corpus counts are those of all rows of docs). Null and empty texts get
    the curve's value for no evidence. Without labels, or with one class only, every score is the share of toxic labels
    (0 without labels). Repeated rows get equal scores. Empty table: no rows.
    """
    marks = labelled.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    late = F.pmod(F.xxhash64(F.lit("curve"), F.col("doc_id")), F.lit(4)) == 0
    marks = written(marks.withColumn("late", late), "marks")
    early = marks.where("NOT late").orderBy(F.xxhash64("doc_id"), "doc_id").limit(counted).select("doc_id", "toxic")
    model = Model(gram_table(word_table(docs, early)))
    ll = written(log_likelihoods(docs, model), "likelihoods")
    features = contrast()
    rows = ll.join(marks.where("late"), "doc_id").select(
        F.xxhash64("doc_id").alias("h"), "doc_id", "toxic", *(f.alias(f"f{k}") for k, f in enumerate(features))
    ).orderBy("h", "doc_id").limit(sample).toPandas()
    y = rows["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        z = F.lit(float(y.mean()) if len(y) else 0.0)
    else:
        x = np.column_stack([np.ones(len(y)), *(rows[f"f{k}"].to_numpy(float) for k in range(len(features)))])
        w = logistic(x, y)
        total = F.lit(float(w[0]))
        for v, f in zip(w[1:], features, strict=True):
            total = total + F.lit(float(v)) * f
        z = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))
    out = ll.select("doc_id", "text_key", z.cast("double").alias("score"), F.col("n_words").cast("long").alias("n_words"))
    return out.select("doc_id", "text_key", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words")
