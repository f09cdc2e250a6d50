"""URL filters: host and path rules first, else a weighted vocabulary found by an Aho-Corasick automaton.

A term counts where it stands between characters other than a-z and 0-9 (or the URL's ends). One strict term rejects;
soft terms reject when the weights of the distinct ones add up to the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Term -> weight. Weight 2 and more is strict.
VOCABULARY = {
    "casino": 2, "porn": 2, "xxx": 2, "sex": 2, "escort": 2, "viagra": 2, "malware": 2, "phishing": 2, "spam": 2, "warez": 2,
    "adult": 2, "gambling": 2, "betting": 2, "torrent": 2, "keygen": 2,
    "win": 1, "bets": 1, "bet": 1, "free": 1, "ads": 1, "ad": 1, "track": 1, "tracker": 1, "farm": 1, "clicks": 1, "click": 1,
    "poker": 1, "slots": 1, "loan": 1, "loans": 1, "pills": 1, "crack": 1, "cheap": 1, "bonus": 1, "nude": 1, "dating": 1,
}
LIMIT = 2
#: Fixed values: (verdict, host, path)
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_EDGE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path. Null, or no `://`: both empty."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_A_TO_Z), slash + path


def rule_table(rules: list[tuple[str, str, str]]) -> dict[str, list[tuple[int, str, str, str]]]:
    """Rules by host, the longest path first; of two equal rules the blocking one holds."""
    by: dict[str, list[tuple[int, str, str, str]]] = {}
    for verdict, host, path in rules:
        by.setdefault(host, []).append((len(host) + len(path), path, f"{host}{path}", verdict))
    return {h: sorted(r, key=lambda x: (-x[0], x[3] != "block")) for h, r in by.items()}


def fitting_rule(host: str, path: str, by: dict) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits the host or a parent domain, or None."""
    best = None
    labels = host.split(".")
    for k in range(len(labels)):
        for length, start, rule, verdict in by.get(".".join(labels[k:]), ()):
            if path.startswith(start):
                if best is None or length > best[0]:
                    best = (length, rule, verdict)
                break
    return best and best[1:]


def automaton(vocabulary: dict[str, int]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def term_weights(url: str, find) -> tuple[int, int]:
    """(strict terms found, weight of the distinct soft terms found)."""
    low = url.translate(_A_TO_Z)
    strict, soft = set(), {}
    for end, (term, weight) in find.iter(low):
        begin = end - len(term) + 1
        if (begin == 0 or low[begin - 1] not in _EDGE) and (end + 1 == len(low) or low[end + 1] not in _EDGE):
            if weight >= LIMIT:
                strict.add(term)
            else:
                soft[term] = weight
    return len(strict), sum(soft.values())


def judge_urls(pages: DataFrame, *, vocabulary: dict[str, int] | None = None, rules: list | None = None,
               key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, strict, soft for every row, without a shuffle.

    Vocabulary and rules are parameters in the code, sent to each task. A null or odd URL has empty host and path,
    fits no rule and is judged by its terms: null is allowed.
    """
    vocabulary, by = vocabulary or VOCABULARY, rule_table(rules or RULES)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(vocabulary)
        for b in it:
            out: list[list] = [[], [], [], [], [], []]
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                strict, soft = term_weights(u, find) if u else (0, 0)
                hit = fitting_rule(host, path, by)
                verdict = hit[1] if hit else "block" if strict or soft >= LIMIT else "allow"
                for column, x in zip(out, (host, path, hit[0] if hit else None, verdict, strict, soft), strict=True):
                    column.append(x)
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=[key, "host", "path", "rule", "verdict", "strict", "soft"],
            )

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url).mapInArrow(
        batches, f"`{key}` {kind}, host string, path string, rule string, verdict string, strict int, soft int"
    )


def judge_urls_sql() -> str:
    """The same verdicts in SQL: terms by regular expressions, rules by a list ordered by length."""
    strict = "|".join(t for t, w in VOCABULARY.items() if w >= LIMIT)
    soft = " + ".join(
        f"{w} * (regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))::INT" for t, w in VOCABULARY.items() if w < LIMIT
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '^[\\s\\S]*?://([^?#]*)', 1) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low,
         translate(CASE WHEN instr(rest, '/') > 0 THEN rest[1:instr(rest, '/') - 1] ELSE rest END, '{upper}', '{lower}') AS host,
         CASE WHEN instr(rest, '/') > 0 THEN rest[instr(rest, '/'):] ELSE '' END AS path
  FROM cut),
terms AS (
  SELECT *, regexp_matches(low, '(^|[^a-z0-9])({strict})([^a-z0-9]|$)') AS bad, ({soft})::INT AS soft FROM parts)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {said} WHEN bad OR soft >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM terms"""
