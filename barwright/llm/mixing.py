"""Mixing documents to target domain weights. DataFrame functions only.

A Gaussian naive Bayes classifier, fitted on a labelled table by one grouped aggregate, gives each document a
probability for each domain. Document rates r >= floor then minimise

    1/2 * sum_d (sum_i r_i * tokens_i * p_id - target_d)**2 / size_d,      size_d = sum_i tokens_i * p_id

by projected gradient steps from r = 1. In the metric where document i counts tokens_i the step length 1 is safe: the
matrix of the problem is row-stochastic. Each step is one distributed sum of as many numbers as there are domains; the
rates themselves are a column, written after every few steps, and are never collected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.tables import written

#: Substrings whose frequency tells languages and junk apart
MARKS = ["é", "è", "ñ", "ó", "ü", "ä", "|", "!!", "%", "$", " the ", "th", "en", "os"]
TEMPER = 0.25


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a substring that does not overlap itself."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part.encode()))


def statistics(text: Column) -> list[Column]:
    """Frequencies per character, on a root scale; one pass for each mark."""
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    stats = [F.sqrt(count_of(text, m) / n) for m in MARKS]
    stats.append(F.sqrt((F.octet_length(text) - F.char_length(text)) / n))
    stats.append(F.sqrt(count_of(text, " ") / n))
    return stats


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("double")


class DomainModel:
    """Prior, mean and variance of each statistic for each domain."""

    def __init__(self, domains: list[str], prior: list[float], mean: list[list[float]], var: list[list[float]]):
        self.domains, self.prior, self.mean, self.var = domains, prior, mean, var

    def posteriors(self, x: str) -> list[Column]:
        """Probabilities from the array column of statistics; they add up to 1."""
        logs = []
        for k in range(len(self.domains)):
            terms = [F.lit(math.log(self.prior[k]))]
            for j, (m, v) in enumerate(zip(self.mean[k], self.var[k], strict=True)):
                d = F.col(x)[j] - F.lit(m)
                terms.append(F.lit(-0.5 * math.log(v)) - d * d / F.lit(2 * v))
            logs.append(reduce(lambda a, b: a + b, terms))
        return logs


def fit_domains(stats: DataFrame, labelled: DataFrame, domains: list[str], smallest: float = 1e-4) -> DomainModel:
    """stats: doc_id, x (array). labelled: doc_id, domain. A domain without labelled rows gets the pooled distribution.

    Sums only; the result has as many numbers as domains times statistics. Rows with a null key or another domain are
    left out; repeated labels of a document count once each.
    """
    width = len(MARKS) + 2
    rows = stats.join(labelled.where(F.col("domain").isin(domains)), "doc_id")
    aggs = [F.count("*").alias("n")]
    aggs += [F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(width)]
    aggs += [F.sum(F.col("x")[j] * F.col("x")[j]).alias(f"q{j}") for j in range(width)]
    found = {r["domain"]: r for r in rows.groupBy("domain").agg(*aggs).collect()}
    total = sum(r["n"] for r in found.values())
    pooled = [[sum(r[f"{c}{j}"] for r in found.values()) / max(1, total) for j in range(width)] for c in "sq"]
    prior, mean, var = [], [], []
    for d in domains:
        r = found.get(d)
        n = r["n"] if r else 0
        prior.append((n + 1) / (total + len(domains)))
        mean.append([r[f"s{j}"] / n for j in range(width)] if n else pooled[0])
        second = [r[f"q{j}"] / n for j in range(width)] if n else pooled[1]
        var.append([max(smallest, q - m * m) for q, m in zip(second, mean[-1], strict=True)])
    return DomainModel(domains, prior, mean, var)


def posteriors_of(d: DataFrame, model: DomainModel, kept: list[str], temper: float) -> DataFrame:
    """Columns `kept` of d and p0..pk from its statistics `x`, row by row."""
    names = [f"l{k}" for k in range(len(model.domains))]
    d = d.select(*kept, *(p.alias(n) for p, n in zip(model.posteriors("x"), names, strict=True)))
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    d = d.select(*kept, *(F.exp((F.col(n) - top) * temper).alias(n) for n in names))
    total = reduce(lambda a, b: a + b, (F.col(n) for n in names))
    return d.select(*kept, *((F.col(n) / total).alias(f"p{k}") for k, n in enumerate(names)))


def with_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], *, temper: float = TEMPER) -> tuple[DataFrame, DomainModel]:
    """doc_id, text_key, tokens, p0..pk, for every row of docs, written once, and the model; text itself is not kept.

    `temper` flattens the classifier's log odds, as statistics of one text are not independent.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    stats = written(
        docs.select("doc_id", F.xxhash64(text).alias("text_key"), token_count(text).alias("tokens"),
                    F.array(*statistics(text)).alias("x")),
        "statistics",
    )
    model = fit_domains(stats.select("doc_id", "x"), labelled, domains)
    return written(posteriors_of(stats, model, ["doc_id", "text_key", "tokens"], temper), "posteriors"), model


def rate_column(steps: list[list[float]], floor: float) -> Column:
    """The rate after some steps from column `rate`: each moves along the posteriors and is cut off at the floor."""
    r = F.col("rate")
    for s in steps:
        r = F.greatest(F.lit(floor), r + reduce(lambda a, b: a + b, (F.col(f"p{k}") * F.lit(x) for k, x in enumerate(s))))
    return r


def rate_after(steps: list[list[float]], floor: float) -> Column:
    """The rate after all steps from 1, as a loop over them: a row needs nothing but its posteriors."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*(F.array(*map(F.lit, s)) for s in steps))

    def moved(rate: Column, step: Column) -> Column:
        return F.greatest(F.lit(float(floor)), rate + reduce(lambda a, b: a + b, (F.col(f"p{k}") * step[k] for k in range(len(steps[0])))))

    return F.aggregate(table, F.lit(1.0), moved)


#: steps held as one expression before the rates are written; compiling longer ones costs more than writing
HELD_STEPS = 4


def with_rates(d: DataFrame, targets: list[float], *, floor: float = 0.0, budget: float | None = None, most: int = 40,
               close: float = 1e-6) -> tuple[DataFrame, list[list[float]]]:
    """d with `rate`, and the steps that led to it: expected domain totals are targets * budget, to a relative `close` or after `most` steps.

    targets are shares that add up to 1; budget is the wanted number of tokens: all there are by default, or the least
    with which no domain shrinks where floor is 1.
    """
    names = [f"p{k}" for k in range(len(targets))]
    share = sum(targets)
    if not targets or min(targets) <= 0:
        raise ValueError("targets must be positive")
    size = d.agg(*(F.coalesce(F.sum(F.col("tokens") * F.col(n)), F.lit(0.0)).alias(n) for n in names)).first()
    d = d.withColumn("rate", F.lit(1.0))
    if not sum(size):
        return d, []
    if budget is None:
        budget = max(s * share / t for s, t in zip(size, targets, strict=True)) if floor >= 1 else sum(size)
    want = [t / share * budget for t in targets]
    taken: list[list[float]] = []
    steps: list[list[float]] = []  # those not yet in the column
    now = list(size)
    for _ in range(most):
        miss = [(w - n) / s if s > 0 else 0.0 for w, n, s in zip(want, now, size, strict=True)]
        if max(abs(m) * s / w for m, s, w in zip(miss, size, want, strict=True)) < close:
            break
        taken.append(miss)
        steps.append(miss)
        if len(steps) == HELD_STEPS:
            d, steps = written(d.withColumn("rate", rate_column(steps, floor)), "rates"), []
        r = d.withColumn("rate", rate_column(steps, floor))
        now = list(r.agg(*(F.sum(F.col("rate") * F.col("tokens") * F.col(n)) for n in names)).first())
    return d.withColumn("rate", rate_column(steps, floor)), taken


def fraction_of(*key: Column) -> Column:
    """A fixed number in [0, 1) for a record."""
    return F.pmod(F.xxhash64(F.lit("rate"), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def copies_of() -> Column:
    """`rate` rounded up or down by a fixed number of the record."""
    u = fraction_of(F.col("doc_id"), F.col("text_key"))
    return (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, floor: float = 0.0,
          budget: float | None = None) -> DataFrame:
    """doc_id, text_key, tokens, p0..pk (domains in the order of `targets`), rate, copies; a row for each row of docs.

    `copies` is the rate rounded up or down by a fixed number of the record, so its expectation is the rate. Null or
    empty text: no tokens, which no total depends on. Without tokens at all every rate is 1. Repeated rows get the same
    rate. Empty table: no rows.
    """
    d, _ = with_posteriors(docs, labelled, list(targets))
    d, _ = with_rates(d, list(targets.values()), floor=floor, budget=budget)
    return d.withColumn("copies", copies_of())


def repeated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, floor: float = 0.0,
             budget: float | None = None) -> DataFrame:
    """The rows of docs, each as often as `mixed` has it in `copies`. No text is shuffled or written.

    The model and the steps are a few hundred numbers, from which each row finds its rate where it is, by a second look at
    its text.
    """
    posteriors, model = with_posteriors(docs, labelled, list(targets))
    _, steps = with_rates(posteriors, list(targets.values()), floor=floor, budget=budget)
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = ["row", "doc_id", "text_key"]  # docs may have columns of any name
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.xxhash64(text).alias("text_key"),
        F.array(*statistics(text)).alias("x"),
    )
    d = posteriors_of(d, model, kept, TEMPER).select(*kept, rate_after(steps, floor).alias("rate"))
    d = d.select("row", F.explode(F.array_repeat(F.lit(0), copies_of())).alias("time"))
    return d.select(*[F.col("row")[c].alias(c) for c in docs.columns])
