"""Repeats at block borders, against brute force; the inside of long repeats is settled without names of its starts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barwright.llm import repeats

L = repeats.LENGTH


def noise(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("abcdefghij é", k=n))


def removed(texts: list[str]) -> list[tuple[int, int, bytes]]:
    raw = [t.encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - L + 1):
            seen[r[i : i + L]] = seen.get(r[i : i + L], 0) + 1
    out = []
    for r in raw:
        cut = np.zeros(len(r), bool)
        for i in range(len(r) - L + 1):
            if seen[r[i : i + L]] > 1:
                cut[i : i + L] = True
        spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
        out.append((int(cut.sum()), spans, np.frombuffer(r, np.uint8)[~cut].tobytes()))
    return out


def test_overlapping_repeats_of_all_lengths(spark):
    rng = random.Random(5)
    long_ = noise(rng, 3000)
    texts = [long_, noise(rng, 77) + long_[400:2600], long_[:700] + noise(rng, 3) + long_[700:1500], "x" * 900, "x" * 199, "", long_[1000:1300] * 3]
    for n in (150, 199, 200, 201, 218, 219, 250, 331, 332, 333, 480):
        a = rng.randrange(0, 2400)
        texts.append(noise(rng, rng.randrange(0, 300)) + long_[a : a + n] + noise(rng, rng.randrange(0, 300)))
    texts += [texts[1], noise(rng, 500), noise(rng, 10) + texts[-1][:210]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts)


def test_the_inside_of_a_long_repeat_is_settled(spark):
    rng = random.Random(7)
    shared = noise(rng, 6000)
    texts = [noise(rng, 1000) + shared + noise(rng, 900), noise(rng, 333) + shared + noise(rng, 50)]
    d = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    size = len(shared.encode())
    marks = repeats.repeated_places(repeats.cover_names(d, L), "cover")
    firsts = marks.select("key", F.transform("places", lambda p: p - (repeats.PERIOD - 1)).alias("places"))
    large = repeats.settled_blocks(d.join(firsts, "key"), repeats.PERIOD, 1, L)
    small = repeats.settled_blocks(d.join(large.where(F.size("places") > 0).drop("settled"), "key"), repeats.SMALL, repeats.PERIOD // repeats.SMALL, L)
    named = repeats.start_names(d.join(small.where(F.size("places") > 0).drop("settled"), "key"), repeats.SMALL, L).count()
    assert large.agg(F.sum(F.size("settled"))).first()[0] * repeats.PERIOD > 1.8 * (size - 1000)
    assert named < 0.05 * size  # all starts of both repeats before


def test_bundles_come_back_whole():
    rng = np.random.default_rng(1)
    name, key, place = rng.integers(0, 40, 500), rng.integers(0, 5, 500), rng.integers(0, 20, 500)
    b = repeats.bundle(name.astype(np.uint64), key, place)
    parts = [b, b.slice(3, 20), b.slice(5, 0)]
    for part in parts[:2]:
        names, row, keys, places = repeats.unbundled(part)
        want = {(n, k, p) for n, k, p in zip(name.tolist(), key.tolist(), place.tolist()) if n in set(part.column(0).to_pylist())}
        assert set(zip(names[row].tolist(), keys.tolist(), places.tolist())) == want and len(row) == len(want)
    assert pa.types.is_binary(b.column(3).type)


def test_long_texts_go_to_tasks_in_small_batches(spark):
    def sizes(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    long_ = 40_000
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.rpad(F.col("id").cast("string"), long_, "abc de ").alias("text"))
    out = repeats.without_repeats(docs.limit(0))
    seen = docs.mapInArrow(sizes, "size long, n long").collect()
    assert max(r["size"] for r in seen) <= repeats.BATCH_BYTES + 2 * long_ and sum(r["n"] for r in seen) == 200
    assert out.count() == 0
    spark.conf.unset(name)
