"""Fingerprints, page extraction and URL filter against plain versions, with nulls, empty values and repeated rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barwright.llm import extract, fingerprints, urls

SCHEMA = "doc_id long, text string, fingerprint string, bucket int"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(["lo", "mi", "ra", "ten"]) + rnd.choice(["na", "sü", "ki", "por"]) + str(rnd.randint(0, 99)) for _ in range(n))


def test_fingerprint_report_equals_a_walk_over_the_rows(spark):
    rnd = random.Random(3)
    texts = [prose(rnd, rnd.randint(1, 200)) for _ in range(60)]
    texts[7], texts[20], texts[21], texts[40] = None, "", " \n", texts[39]
    rows = [(3 * i, t, "clash", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(got) == 60
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % 60] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        assert got[3 * i].n_chars == len(t)
        assert got[3 * i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[3 * i].near_edited <= 1 and 0 <= got[3 * i].near_next <= 1
    assert got[3 * 39].fingerprint == got[3 * 40].fingerprint and got[3 * 39].near_next == 1.0
    assert got[3 * 7].fingerprint == "" and got[3 * 20].near_next == 1.0


def test_buckets_do_not_change_the_report(spark):
    rnd = random.Random(8)
    rows = [(i * i, prose(rnd, 12), "x", 0) for i in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    follows = {}
    for r in fingerprints.with_next(d, per_bucket=16).groupBy("bucket").agg(F.sort_array(F.collect_list("ord")).alias("o")).collect():
        follows |= dict(zip(r.o, r.o[1:]))
    ids = [i * i for i in range(400)]
    assert all(follows[a] == b for a, b in zip(ids, ids[1:]))


def test_likeness_is_near_the_true_similarity(spark):
    rnd = random.Random(1)
    words = prose(rnd, 600).split()
    for share in (0.2, 0.5, 0.9):
        cut = int(600 * share)
        other = words[:cut] + prose(rnd, 600 - cut).split()
        a, b = ({tuple(w[k : k + 5]) for k in range(596)} for w in (words, other))
        fp, has = fingerprints.fingerprints([" ".join(words), " ".join(other)])
        got = fingerprints.likeness(fp[:1], has[:1], fp[1:], has[1:])[0]
        assert got == pytest.approx(len(a & b) / len(a | b), abs=0.1)


def test_fingerprints_of_an_empty_table(spark):
    assert fingerprints.fingerprint_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fingerprints.fingerprint_report(spark.createDataFrame([(5, "one two", "", 0)], SCHEMA)).first().near_next == 1.0


PAGE = (
    "<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
    "<script>var a = '<p>not text</p>';</script><article><h1>Caf&eacute; &amp; bar</h1>\n<p>The  council met\n on Tuesday to talk "
    "about <b>the</b> bridge and its cost.</p><p>It rained.</p></article><div class='comments'><p>I do not agree with any of "
    "this, said one reader who wrote a long letter.</p></div><footer>&copy; 2024</footer></body></html>"
)


def test_extraction(spark):
    rows = [(1, "u", PAGE, "clash"), (2, None, None, None), (3, "v", "", ""), (4, "w", PAGE * 40, "x"), (1, "u", PAGE, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(extract.extract_text(pages).collect(), key=lambda r: r.page_id)
    main = "Café & bar\nThe council met on Tuesday to talk about the bridge and its cost.\nIt rained."
    assert [r.text for r in got[:4]] == [main, main, "", ""] and got[0].n_chars == len(main)
    assert got[4].text.count("It rained.") == 40
    assert extract.extract_text(pages.limit(0)).count() == 0


def test_url_rules_and_terms(spark):
    cases = {
        "https://Example.org/es/a": ("example.org", "/es/a", "example.org/es/", "block"),
        "https://www.example.org/en/12?x": ("www.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"),
        "http://a.com/fr/casino": ("a.com", "/fr/casino", "com/fr/", "allow"),
        "http://best-casino.net/x": ("best-casino.net", "/x", None, "block"),
        "http://casinoland.net/x": ("casinoland.net", "/x", None, "allow"),
        "http://free.net/free": ("free.net", "/free", None, "allow"),
        "http://free.net/win": ("free.net", "/win", None, "block"),
        "http://a.net#/casinos": ("a.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    rows = [(i, u, "h", "v") for i, u in enumerate(cases)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()}
    for i, (url, want) in enumerate(cases.items()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, url
