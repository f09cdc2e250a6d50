"""Trade summaries of many sets of signals from one pass over the predictions.

A row says with a bit mask which sets (thresholds reached, entry policies) it belongs to. All sets are valued together
where a group's session is, as columns of one matrix: the day-trade cap, the economics and the curve with its highest
and lowest points. No row is repeated for a set. A session leaves one row of totals, and sessions are linked in order.

The cap looks across sessions, but only at counts: candidates per session and set are added up first, the recurrence of
`operators.risk` turns them into the number each session may accept, and those numbers return to the session's rows.
The predictions are shuffled once, by group and session; both passes read that shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.config import ExperimentConfig
from barwright.functions.expr import ratio_or_zero
from barwright.operators.labels import OUTCOMES, TAKE_PROFIT
from barwright.operators.risk import allowance_of_counts

MOST_SETS = 62
STEP = 1 << 16
COUNTS = [
    "n_raw", "n_raw_take_profit", "n_signals", "n_trades_taken", "n_trades_blocked_day_trade_cap",
    "n_trades_skipped_missing_label", *[f"n_taken_{o}" for o in OUTCOMES],
]
#: a session's part of the curve: its sum, highest point, deepest fall inside, lowest point
CURVE = ["total", "top", "inside", "bottom"]


def session_totals(rows: pd.DataFrame, allowed: np.ndarray, sets: int) -> dict[str, np.ndarray]:
    """All sets' totals of one session; `allowed` candidates of each set may be accepted, the first in time.

    A set without a taken trade has NaN for its curve.
    """
    rows = rows.sort_values([c for c in ("entry_time", "symbol") if c in rows], kind="stable")
    out = {c: np.zeros(sets, np.int64) for c in COUNTS}
    used, run = np.zeros(sets, np.int64), np.zeros(sets)
    top, inside, bottom = np.full(sets, -np.inf), np.full(sets, np.inf), np.full(sets, np.inf)
    for lo in range(0, len(rows), STEP):
        part = rows.iloc[lo : lo + STEP]
        member = (part["mask"].to_numpy(np.int64)[:, None] >> np.arange(sets)) & 1 == 1
        code, pnl = part["outcome"].to_numpy(), np.nan_to_num(part["pnl"].to_numpy(float))
        labelled, missing, candidate = (part[c].to_numpy(bool) for c in ("labelled", "missing", "candidate"))
        signal = member & labelled[:, None]
        wants = signal & candidate[:, None]
        place = used + np.cumsum(wants, axis=0)
        over = wants & (place > allowed)
        used = place[-1]
        taken = signal & ~missing[:, None] & ~over
        values = [
            member, member & (code == OUTCOMES.index(TAKE_PROFIT))[:, None], signal, taken, over, signal & missing[:, None],
            *[taken & (code == k)[:, None] for k in range(len(OUTCOMES))],
        ]
        for c, v in zip(COUNTS, values, strict=True):
            out[c] += v.sum(axis=0)
        curve = run + np.cumsum(np.where(taken, pnl[:, None], 0.0), axis=0)
        high = np.maximum(np.maximum.accumulate(np.where(taken, curve, -np.inf), axis=0), top)
        inside = np.minimum(inside, np.where(taken, curve - high, np.inf).min(axis=0))
        bottom = np.minimum(bottom, np.where(taken, curve, np.inf).min(axis=0))
        run, top = curve[-1], high[-1]
    none = out["n_trades_taken"] == 0
    curve_of = dict(zip(CURVE, (run, top, inside, bottom), strict=True))
    return out | {c: np.where(none, np.nan, v) for c, v in curve_of.items()}


def narrow_rows(facts: DataFrame, member: Column, base: list[str]) -> DataFrame:
    """What the summaries read of a prediction, dealt out by group and session."""

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    same_day = ~F.col("missing_exit") & (F.col("exit_session_date") == F.col("session_date"))
    outcome = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("y_true")).cast("int") - 1
    extra = [c for c in ("symbol",) if c in facts.columns and c not in base]
    return facts.select(
        *base, "session_date", "entry_time", *extra, F.coalesce(member, F.lit(0)).cast("bigint").alias("mask"),
        F.coalesce(outcome, F.lit(-1)).alias("outcome"), yes(F.col("has_label")).alias("labelled"),
        yes(F.col("missing_exit")).alias("missing"), yes(F.col("has_label") & same_day).alias("candidate"), F.col("pnl").cast("double").alias("pnl"),
    ).repartition(*base, "session_date")


def session_allowances(rows: DataFrame, base: list[str], sets: int, cfg: ExperimentConfig) -> DataFrame:
    """(base..., session_date, allowed): how many candidates of each set the cap accepts in each session."""
    cells = (
        rows.groupBy(*base, "session_date", "mask").agg(F.count_if("candidate").alias("n"))
        .groupBy(*base, "session_date").agg(F.collect_list(F.struct("mask", "n")).alias("cells"))
    )
    per_set = F.transform(
        F.sequence(F.lit(0), F.lit(sets - 1)),
        lambda i: F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + c["n"] * F.call_function("getbit", c["mask"], i).cast("bigint")),
    )
    counts = cells.select(*base, "session_date", F.posexplode(per_set).alias("set_", "n"))
    allowed = allowance_of_counts(counts, [*base, "set_"], cfg.max_day_trades, cfg.rolling_business_days)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("set_", "allowed"))), lambda x: x["allowed"])
    out = allowed.groupBy(*base, "session_date").agg(in_order.alias("allowed"))
    return out.select(*[F.col(c).alias(c) for c in out.columns])  # columns of its own, to stand beside `rows`


def summarize_sets(
    facts: DataFrame, member: Column, sets: int, cfg: ExperimentConfig, base: list[str], *, enforce_day_trade_cap: bool = True
) -> DataFrame:
    """One summary row for each `base` group and set number `set_`, for sets without a signal too.

    `facts` are rows of `with_trade_facts`; bit i of `member` says whether a row signals in set i.
    """
    if not 1 <= sets <= MOST_SETS:
        raise ValueError(f"1 to {MOST_SETS} sets, got {sets}")
    rows = narrow_rows(facts, member, base)
    keys = [*base, "session_date"]
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    schema = ", ".join([types, "n_predictions bigint", "n_take_profit bigint", *[f"{c} array<bigint>" for c in COUNTS], *[f"{c} array<double>" for c in CURVE]])

    def row_of(pdf: pd.DataFrame, allowed: np.ndarray) -> pd.DataFrame:
        made = session_totals(pdf, allowed, sets)
        own = {c: [pdf[c].iloc[0]] for c in keys}
        tp = int((pdf["outcome"] == OUTCOMES.index(TAKE_PROFIT)).sum())
        return pd.DataFrame(own | {"n_predictions": [len(pdf)], "n_take_profit": [tp]} | {c: [v] for c, v in made.items()})

    if enforce_day_trade_cap:
        def capped(pdf: pd.DataFrame, may: pd.DataFrame) -> pd.DataFrame:
            return row_of(pdf, np.asarray(may["allowed"].iloc[0], np.int64))

        allowed = session_allowances(rows, base, sets, cfg)
        days = rows.groupBy(*keys).cogroup(allowed.groupBy(*keys)).applyInPandas(capped, schema)
    else:
        def free(pdf: pd.DataFrame) -> pd.DataFrame:
            return row_of(pdf, np.full(sets, len(pdf)))

        days = rows.groupBy(*keys).applyInPandas(free, schema)
    return _linked(days, base)


def _linked(days: DataFrame, base: list[str]) -> DataFrame:
    """Sessions' totals to one row for each group and set. The first peak is the first point of the curve."""
    each = days.select(
        *base, "session_date", "n_predictions", "n_take_profit", F.posexplode(F.arrays_zip(*COUNTS, *CURVE)).alias("set_", "v")
    ).select(*base, "session_date", "n_predictions", "n_take_profit", "set_", "v.*")
    each = each.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in CURVE})
    before = Window.partitionBy(*base, "set_").orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    each = each.withColumn("peak0", F.max(F.col("start") + F.col("top")).over(before))
    fall = F.least(F.col("inside"), F.col("start") + F.col("bottom") - F.col("peak0"))
    out = each.groupBy(*base, "set_").agg(
        *[F.sum(c).alias(c) for c in ("n_predictions", "n_take_profit", *COUNTS)],
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("gross_return_sum"),
        F.coalesce(F.min(fall), F.lit(0.0)).alias("max_drawdown_cumulative_sum"),
    )
    return out.select(
        *base, "set_", "n_predictions", *COUNTS[2:6], F.col("n_raw_take_profit").alias("n_signal_take_profit"), *COUNTS[6:],
        ratio_or_zero(f"n_taken_{TAKE_PROFIT}", "n_trades_taken").alias("hit_rate_take_profit_on_taken"),
        "gross_return_sum", ratio_or_zero("gross_return_sum", "n_trades_taken").alias("gross_return_mean"),
        "max_drawdown_cumulative_sum", ratio_or_zero("n_raw_take_profit", "n_raw").alias("precision_take_profit"),
        ratio_or_zero("n_raw_take_profit", "n_take_profit").alias("recall_take_profit"),
    )
