"""Triple-barrier labels: which barrier does each sampled entry touch first?

The search walks a two-level envelope index over bar positions with equi-joins:

* `blocks`  - 64 bars each, the bars' highs and lows in one array;
* `supers`  - 64 blocks each, the blocks' extremes in one array.

An entry first looks at its own block, which it already travels with. If that settles nothing,
one join with the supers inside its horizon finds the first later block whose extremes reach a
barrier, and one join with that block finds the bar. An entry therefore sees at most two blocks
and horizon/4096 + 1 supers. Arrays hold at most 64 elements, join keys are (symbol, block) or
(symbol, super), and no entry-by-bar pairs are formed, so a symbol that holds a third of all
bars spreads like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.config import ExperimentConfig
from barwright.functions.expr import clip
from barwright.operators.positions import session_table, slot_table, with_positions, with_session
from barwright.operators.volatility import (
    daily_volatility,
    reference_stat,
    with_daily_returns,
    with_rolling_vol,
)

TAKE_PROFIT, STOP_LOSS, VERTICAL, END_OF_DATA = "take_profit", "stop_loss", "vertical", "end_of_data"
OUTCOMES = (TAKE_PROFIT, STOP_LOSS, VERTICAL, END_OF_DATA)

BLOCK = 64
SUPER = 64

LABEL_COLUMNS = [
    "symbol", "entry_time", "session_date", "entry_pos", "entry_close", "barrier_outcome", "bars_forward",
    "sigma_ann_at_entry", "sigma_ref", "vol_scale_ratio", "tp_move_effective", "sl_move",
    "upper_barrier", "lower_barrier",
]


def barrier_geometry(entries: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Add the scaled barrier moves and price levels to rows with close, sigma and sigma_ref."""
    sigma, ref = F.col("sigma_ann_at_entry"), F.col("sigma_ref")
    ratio = F.when((ref == 0) & (sigma > 0), F.lit(float(cfg.barrier_vol_scale_max))).otherwise(
        clip(F.try_divide(sigma, ref), cfg.barrier_vol_scale_min, cfg.barrier_vol_scale_max)
    )
    return (
        entries.withColumn("vol_scale_ratio", ratio)
        .withColumn(
            "tp_move_effective",
            F.greatest(F.lit(cfg.min_profit_per_trade_pct), F.col("vol_scale_ratio") * cfg.profit_barrier_base),
        )
        .withColumn("sl_move", F.col("vol_scale_ratio") * cfg.stop_loss_base)
        .withColumn("upper_barrier", F.col("entry_close") * (1.0 + F.col("tp_move_effective")))
        .withColumn("lower_barrier", F.col("entry_close") * (1.0 - F.col("sl_move")))
    )


def _touch_code(rows: Column, end: Column, upper: Column, lower: Column) -> Column:
    """2 * position of the first touching bar of `rows` before `end`, plus 1 for a take-profit touch."""
    touching = F.filter(rows, lambda r: ((r["high"] >= upper) | (r["low"] <= lower)) & (r["pos"] < end))
    return F.array_min(F.transform(touching, lambda r: r["pos"] * 2 + F.when(r["low"] <= lower, 0).otherwise(1)))


def _after(array: Column, index: Column, size: int) -> Column:
    """The elements after the 0-based `index` of a full, ordered block."""
    return F.slice(array, (index + 2).cast("int"), size)


def bar_blocks(bars: DataFrame, *entry_columns: str) -> DataFrame:
    """Bars grouped by 64 positions: `rows` holds pos, high, low and, for entries, `entry`.

    `bars` needs symbol, pos, high, low and a boolean `is_entry`.
    """
    row = F.struct(
        "pos", "high", "low", F.when(F.col("is_entry"), F.struct(*entry_columns)).alias("entry")
    )
    blocks = bars.groupBy("symbol", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    )
    # Stated here, the key filters that joins would add to one branch are the same in all
    # branches, and their shuffle is made once and reused.
    return blocks.where(F.col("symbol").isNotNull() & F.col("block").isNotNull())


def block_envelopes(blocks: DataFrame) -> DataFrame:
    """Per 64 blocks, the extremes of each block."""
    return (
        blocks.select(
            "symbol",
            F.floor(F.col("block") / SUPER).alias("sup"),
            F.struct(
                "block",
                F.array_max(F.col("rows.high")).alias("hi"),
                F.array_min(F.col("rows.low")).alias("lo"),
            ).alias("kid"),
        )
        .groupBy("symbol", "sup")
        .agg(F.sort_array(F.collect_list("kid")).alias("kids"))
    )


def first_touch(blocks: DataFrame, geometry: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All entries of the blocks with `touch_pos` and `touched_stop`.

    Both are null when neither barrier is reached before `end_pos` (exclusive). `geometry` adds
    upper_barrier and lower_barrier to the flattened entry columns. A bar that reaches both
    barriers counts as a stop.
    """
    pos, end = F.col("entry_pos"), F.col("end_pos")
    upper, lower = F.col("upper_barrier"), F.col("lower_barrier")
    slim = F.transform("rows", lambda r: F.struct(r["pos"].alias("pos"), r["high"].alias("high"), r["low"].alias("low")))
    entries = blocks.select(
        "symbol", "block", slim.alias("rows"), F.filter("rows", lambda r: r["entry"].isNotNull()).alias("found")
    )
    entries = entries.select("symbol", "block", "rows", F.explode("found").alias("r")).select(
        "symbol", "block", "rows", F.col("r.pos").alias("entry_pos"), "r.entry.*"
    )
    rest_of_block = _after(F.col("rows"), pos % BLOCK, BLOCK)
    entries = (
        geometry(entries).withColumn("own_code", _touch_code(rest_of_block, end, upper, lower)).drop("rows")
    )
    carried = [c for c in entries.columns if c not in ("symbol", "entry_pos")]

    # An entry settled in its own block keeps a valid key but looks no further.
    settled = F.col("own_code").isNotNull()
    own_sup = F.floor(F.col("block") / SUPER)
    last_sup = F.when(settled, own_sup).otherwise(F.floor((end - 1) / (BLOCK * SUPER)))
    later_kids = F.when(F.col("sup") == own_sup, _after(F.col("kids"), F.col("block") % SUPER, SUPER)).otherwise(F.col("kids"))
    reaching = F.filter(later_kids, lambda k: (k["hi"] >= upper) | (k["lo"] <= lower))
    ahead = (
        entries.withColumn("sup", F.explode(F.sequence(own_sup, last_sup)))
        .join(block_envelopes(blocks), ["symbol", "sup"], "left")
        .withColumn("later", F.when(~settled, F.array_min(F.transform(reaching, lambda k: k["block"]))))
        .groupBy("symbol", "entry_pos")
        .agg(F.min("later").alias("later"), *[F.any_value(c).alias(c) for c in carried])
    )
    target = blocks.select("symbol", F.col("block").alias("target"), slim.alias("rows"))
    found = (
        ahead.withColumn("target", F.coalesce("later", "block"))
        .join(target, ["symbol", "target"], "left")
        .withColumn(
            "code",
            F.coalesce(
                "own_code", F.when(F.col("later").isNotNull(), _touch_code(F.col("rows"), end, upper, lower))
            ),
        )
    )
    return (
        found.withColumn("touch_pos", F.floor(F.col("code") / 2))
        .withColumn("touched_stop", F.col("code") % 2 == 0)
        .drop("rows", "code", "own_code", "later", "target", "block")
    )


def horizon_table(slots: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Per session: its volatility, the symbol's reference and the first position past the horizon."""
    vol_col = f"vol_{cfg.vol_lookback_trading_days}d_ann"
    by_rank = Window.partitionBy("symbol").orderBy("session_date")
    days = with_rolling_vol(with_daily_returns(session_table(slots)), cfg.vol_lookback_trading_days)
    return days.select(
        "symbol",
        "session_date",
        F.col(vol_col).alias("sigma_ann_at_entry"),
        reference_stat(vol_col, cfg.vol_ref_method, Window.partitionBy("symbol")).alias("sigma_ref"),
        F.lead("first_pos", cfg.vertical_max_trading_days).over(by_rank).alias("vertical_pos"),
    )


def label_bars(bars: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """One labelled row per sampled entry of session-dated bars.

    Entries are every `stride`-th bar except the last, where close and volatility are known.
    """
    slots = slot_table(bars)
    entry_columns = ["ts", "session_date", "close", "sigma_ann_at_entry", "sigma_ref", "vertical_pos", "n_bars"]
    positioned = with_positions(
        bars,
        slots.join(horizon_table(slots, cfg), ["symbol", "session_date"]),
        "sigma_ann_at_entry", "sigma_ref", "vertical_pos",
    ).withColumn(
        "is_entry",
        (F.col("pos") % cfg.label_entry_stride == 0)
        & (F.col("pos") < F.col("n_bars") - 1)
        & (F.col("n_bars") >= 3)
        & F.col("close").isNotNull()
        & F.col("sigma_ann_at_entry").isNotNull(),
    )

    def geometry(entries: DataFrame) -> DataFrame:
        renamed = entries.withColumnsRenamed({"ts": "entry_time", "close": "entry_close"})
        return barrier_geometry(
            renamed.withColumn("end_pos", F.coalesce("vertical_pos", "n_bars")), cfg
        )

    found = first_touch(bar_blocks(positioned, *entry_columns), geometry)
    hit = F.col("touch_pos").isNotNull()
    return (
        found.withColumn(
            "barrier_outcome",
            F.when(hit & F.col("touched_stop"), STOP_LOSS)
            .when(hit, TAKE_PROFIT)
            .when(F.col("vertical_pos").isNotNull(), VERTICAL)
            .otherwise(END_OF_DATA),
        )
        .withColumn(
            "bars_forward",
            F.coalesce("touch_pos", "vertical_pos", F.col("n_bars") - 1) - F.col("entry_pos"),
        )
        .select(*LABEL_COLUMNS)
    )


def entry_geometry(bars: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Barrier geometry of every bar with a known volatility, outcome unknown (for live scoring)."""
    slots = slot_table(bars)
    d = bars.join(horizon_table(slots, cfg), ["symbol", "session_date"]).where(
        F.col("close").isNotNull() & F.col("sigma_ann_at_entry").isNotNull()
    )
    named = d.select(
        "symbol", F.col("ts").alias("entry_time"), F.col("close").alias("entry_close"), "sigma_ann_at_entry", "sigma_ref"
    )
    return barrier_geometry(named, cfg).withColumn("barrier_outcome", F.lit(None).cast("string"))


def label_issues(bars: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Symbols that cannot be labelled, and why (fewer than 3 bars, or no finite volatility)."""
    vol_col = f"vol_{cfg.vol_lookback_trading_days}d_ann"
    days = daily_volatility(bars, cfg.vol_lookback_trading_days)
    per_symbol = days.groupBy("symbol").agg(
        F.sum("session_bars").alias("n_bars"), F.count(vol_col).alias("n_vol")
    )
    issue = F.when(F.col("n_bars") < 3, "fewer than 3 bars").when(F.col("n_vol") == 0, "no finite volatility")
    return per_symbol.withColumn("issue", issue).where(F.col("issue").isNotNull())


def outcome_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("symbol", "barrier_outcome").agg(F.count(F.lit(1)).alias("n"))


def label_job(bars: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Raw bars of any symbols to labels: slice to the data range, date the sessions, label."""
    dated = with_session(bars, cfg.exchange_timezone)
    if cfg.data_start is not None and cfg.data_end is not None:
        dated = dated.where(F.col("session_date").between(F.lit(cfg.data_start), F.lit(cfg.data_end)))
    return label_bars(dated, cfg)
