"""Incremental line dedup against plain Python, over insertions and deletions."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import line_dedup
from barwright.llm.cuckoo import Chain, CuckooFilter, buckets_for
from barwright.llm.line_dedup import LineIndex

SCHEMA = "doc_id long, text string, h long, key string, drops string, mark int, top long"
BLANKS = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows: list[tuple], minimum: int = 3, chars: int = 20) -> list[tuple]:
    """The rule as the contract words it: holders by doc_id, lines by row."""
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= chars:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < minimum or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def result(index: LineIndex, docs) -> list[tuple]:
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in index.cleaned(docs).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(autouse=True)
def few_shards(monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 8)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    pool = [f"a line that several documents hold, number {k}" for k in range(12)]
    pool += ["Ünïcode LINE with İ and ẞ, thrice or more", " \t padded line of twenty chars\x0b ", "short", "exactly-20-chars-....", ""]
    out: list[tuple] = []
    for i in range(40):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 9))] + [f"a line of document {i} alone, not repeated"]
        rnd.shuffle(lines)
        out.append((i * 3, "\n".join(x.upper() if rnd.random() < 0.3 and x.isascii() else x for x in lines)))
    out += [(500, None), (501, ""), (502, "\n\n"), (503, pool[0] + "\r\n" + pool[0]), (504, "\n".join([pool[1]] * 3000 + ["tail " * 20000]))]
    out += [(6, out[2][1]), (6, "another text under a repeated id\n" + pool[2]), (None, pool[0] + "\n" + pool[1]), (None, None)]
    return out


def test_equals_brute_force(spark, rows):
    docs = frame(spark, rows)
    assert result(LineIndex.empty(spark).insert(docs), docs) == brute(rows)


def test_increments_and_deletions_equal_a_fresh_index(spark, rows):
    """After every change the state answers as one built from the documents present, and its counts are exact."""
    rnd = random.Random(7)
    ids = sorted({i for i, _ in rows if i is not None})
    parts = [set(ids[::2]), set(ids[1::2])]
    out = set(rnd.sample(sorted(parts[0]), 8)) | {max(parts[0])}
    steps = [("in", parts[0]), ("in", parts[1]), ("out", out), ("in", set(sorted(out)[:4]))]
    present: set = set()
    index = LineIndex.empty(spark)
    for what, who in steps:
        mine = [r for r in rows if r[0] in who]
        if what == "in":
            index, present = index.insert(frame(spark, mine)), present | who
        else:
            index = index.delete(spark.createDataFrame([(i,) for i in sorted(who)] + [(None,), (12345,)], "doc_id long"))
            present -= who
        if who == parts[0]:
            continue
        now = [r for r in rows if r[0] in present]
        assert result(index, frame(spark, now)) == brute(now)
        holders = defaultdict(set)
        for i, t in now:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 20:
                    holders[key(x)].add(i)
        assert sorted((r.docs, r.top) for r in index.counts().collect()) == sorted((len(v), max(v)) for v in holders.values())


def test_taking_everything_out_leaves_nothing(spark, rows):
    docs = frame(spark, rows)
    index = LineIndex.empty(spark).insert(docs)
    before = result(index, docs)
    bare = index.delete(docs.select("doc_id"))
    assert bare.counts().count() == 0
    filters = bare.shard_filters().collect()
    assert not any(np.frombuffer(r.blob, np.uint16).any() for r in filters)
    assert result(bare.insert(docs), docs) == before == result(index, docs)


def test_the_same_document_twice_is_refused(spark):
    docs = frame(spark, [(1, "a line that is long enough to count")])
    with pytest.raises(ValueError, match="already"):
        LineIndex.empty(spark).insert(docs).insert(docs)


def test_filters_that_do_not_fit_the_bound_let_lines_pass(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 100)
    docs = frame(spark, rows)
    assert result(LineIndex.empty(spark).insert(docs), docs) == brute(rows)


def test_empty_table(spark):
    docs = frame(spark, [])
    index = LineIndex.empty(spark)
    assert index.cleaned(docs).count() == 0
    index = index.insert(docs)
    assert index.cleaned(docs).count() == 0 and index.counts().count() == 0
    assert index.delete(docs).counts().count() == 0


def test_only_held_documents_and_thresholds_are_parameters(spark):
    rows = [(1, "same words here"), (2, "same words here"), (3, "other words")]
    docs = frame(spark, rows)
    index = LineIndex.empty(spark, min_docs=2, min_chars=5).insert(docs)
    assert result(index, docs) == brute(rows, 2, 5)


def test_filter_never_denies_and_forgets():
    rnd = np.random.default_rng(1)
    h = rnd.integers(-(2**63), 2**63 - 1, 20000, np.int64)
    f = CuckooFilter.sized(len(h))
    assert len(f.insert(h)) == 0 and f.contains(h).all()
    assert len(f.table) == buckets_for(len(h))
    strangers = rnd.integers(-(2**63), 2**63 - 1, 100000, np.int64)
    assert f.contains(strangers).mean() < 0.001
    assert len(f.delete(h[:15000])) == 0
    assert f.contains(h[15000:]).all() and f.contains(h[:15000]).mean() < 0.001
    assert len(f.delete(h[15000:])) == 0 and not f.table.any()


def test_chain_grows_and_gives_up_any_part():
    rnd = np.random.default_rng(2)
    h = rnd.integers(-(2**63), 2**63 - 1, 5000, np.int64)
    c = Chain()
    for k in range(0, 5000, 500):
        c.insert(h[k : k + 500], expected=600)
    assert len(c.parts) > 1 and c.contains(h).all()
    c = Chain.load(c.dump())
    c.delete(h[::2])
    assert c.contains(h[1::2]).all()
    c.delete(h[1::2])
    assert not any(p.table.any() for p in c.parts)
    with pytest.raises(ValueError):
        c.delete(h[:1])


def test_equal_prints_keep_their_number():
    f = CuckooFilter(np.zeros((4, 4), np.uint16))
    same = np.repeat(np.int64(77), 8)
    assert len(f.insert(same)) in (0, 4)  # 8 slots in two buckets, or 4 if both buckets are one
    assert len(f.delete(same[:3])) == 0 and f.contains(same[:1])[0]


def test_query_equals_sql_text(spark, rows):
    """The SQL beside the query says the same on rows with nulls, copies and repeated ids."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    documents = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows]})  # noqa: F841
    got = con.execute(line_dedup.CLEANED_SQL).fetchall()
    docs = frame(spark, rows)
    mine = LineIndex.empty(spark).insert(docs).cleaned(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in mine.collect())
