"""Exponential averages, relative strength and MACD.

The averages are recurrences over all earlier bars, missing closes included; `operators.scan` says how they are cut into
blocks. Bars are not moved for them: only (symbol, pos, close, prev_close) go through the scan, a block's averages come
back as one row of arrays, and the bars, already dealt out by the same blocks for their trailing frames, pick their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.config import FeatureConfig
from barwright.functions.expr import EPS, clip_lower, div
from barwright.operators import scan
from barwright.operators.features.group import Group
from barwright.operators.scan import Average, span_alpha

LINE = "_macd"


def first_averages(fc: FeatureConfig) -> list[Average]:
    n = fc.rsi_window_bars
    spans = sorted({*fc.ema_windows_bars, fc.macd_fast_bars, fc.macd_slow_bars})
    return [Average(f"_ema_{w}", "close", span_alpha(w), w) for w in spans] + [
        Average("_avg_gain", "gain", 1.0 / n, n), Average("_avg_loss", "loss", 1.0 / n, n),
    ]


def signal_average(fc: FeatureConfig) -> list[Average]:
    return [Average("_macd_signal", LINE, span_alpha(fc.macd_signal_bars), fc.macd_signal_bars)]


def price_series(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """Close, gain and loss of a block's rows; a row that only leads a continued series has none of its own."""
    close, before = pdf["close"].to_numpy(float), pdf["prev_close"].to_numpy(float)
    move = close - before
    out = {"close": close.copy(), "gain": np.maximum(move, 0.0), "loss": np.maximum(-move, 0.0)}
    leads = pdf["leads"].to_numpy(bool)
    for x in out.values():
        x[leads] = np.nan
    return out


def average_columns(fc: FeatureConfig) -> list[str]:
    return [s.name for s in first_averages(fc)] + [LINE, "_macd_signal"]


class _Scan:
    """Both levels of averages over bars in blocks: rows, and the states before each block."""

    def __init__(self, closes: DataFrame, fc: FeatureConfig, size: int, start: DataFrame | None):
        first, second = self.first, self.second = first_averages(fc), signal_average(fc)
        fast, slow = self.fast, self.slow = f"_ema_{fc.macd_fast_bars}", f"_ema_{fc.macd_slow_bars}"
        macd = [i for i, s in enumerate(first) if s.name in (fast, slow)]
        rows = closes.select("symbol", "pos", "close", "prev_close")
        if start is None:
            rows = rows.withColumn("leads", F.lit(False))
        else:
            begun = start.select("symbol", F.lit(True).alias("_begun"))
            rows = rows.join(begun, "symbol", "left").withColumn("leads", F.coalesce("_begun", F.lit(False)) & (F.col("pos") == 0)).drop("_begun")
        self.rows = scan.in_blocks(rows, size)
        self.keys = scan.key_types(self.rows)
        values, line = self.values, self.line

        def line_maps(pdf: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos")
            x = line(pdf, values(pdf, scan.state_before(block, first, "before"), macd))
            run = scan.run_map(x, int(pdf["pos"].iloc[0]), second[0].alpha)
            return block.assign(run=[run])[["symbol", "chunk", "before", "run"]]

        def begin(column: str) -> DataFrame | None:
            return None if start is None else start.select("symbol", F.col(column).alias("start"))

        one = scan.states(scan.block_maps(self.rows, first, price_series), first, "before", start=begin("first"))
        lines = self.by_block(one, line_maps, f"{self.keys}, before array<double>, run array<double>")
        self.before = scan.states(lines, second, "before_line", "before", start=begin("line"))

    def by_block(self, blocks: DataFrame, f, schema: str) -> DataFrame:
        return self.rows.groupBy("symbol", "chunk").cogroup(blocks.groupBy("symbol", "chunk")).applyInPandas(f, schema)

    @property
    def values(self):
        first = self.first

        def of(pdf: pd.DataFrame, before: np.ndarray, which: list[int]) -> dict[str, np.ndarray]:
            x, start = price_series(pdf), int(pdf["pos"].iloc[0])
            return {first[i].name: scan.run_values(x[first[i].value], start, first[i], before[:, i]) for i in which}

        return of

    @property
    def line(self):
        fast, slow = self.fast, self.slow
        return lambda pdf, v: np.where(pdf["leads"].to_numpy(bool), np.nan, v[fast] - v[slow])


def technical_blocks(closes: DataFrame, fc: FeatureConfig, size: int, start: DataFrame | None = None) -> DataFrame:
    """(symbol, chunk, one array for each average): from bars with pos, close and prev_close, `size` rows a block.

    `start` continues series that began earlier: (symbol, first, line) as `technical_state` gives them, the states after
    the symbol's first row here, which then only leads the others.
    """
    s = _Scan(closes, fc, size, start)
    first, second, values, line = s.first, s.second, s.values, s.line
    fast, slow = s.fast, s.slow

    def fill(pdf: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v = values(pdf, scan.state_before(block, first, "before"), list(range(len(first))))
        before = scan.state_before(block, second, "before_line")
        v["_macd_signal"] = scan.run_values(line(pdf, v), int(pdf["pos"].iloc[0]), second[0], before[:, 0])
        v[LINE] = v[fast] - v[slow]
        return block[["symbol", "chunk"]].assign(**{k: [x] for k, x in v.items()})

    return s.by_block(s.before, fill, ", ".join([s.keys, *[f"{c} array<double>" for c in average_columns(fc)]]))


def technical_state(closes: DataFrame, fc: FeatureConfig, size: int, start: DataFrame | None = None) -> DataFrame:
    """(symbol, first, line): the states after the last of the bars, with positions counted from that bar."""
    s = _Scan(closes, fc, size, start)
    first, second, values, line = s.first, s.second, s.values, s.line
    macd = [i for i, a in enumerate(first) if a.name in (s.fast, s.slow)]

    def after(pdf: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        begin, last = int(pdf["pos"].iloc[0]), int(pdf["pos"].iloc[-1])
        before, x = scan.state_before(block, first, "before"), price_series(pdf)
        of_line = line(pdf, values(pdf, before, macd))
        ends = []
        for averages, state, series in ((first, before, x), (second, scan.state_before(block, second, "before_line"), {LINE: of_line})):
            run = np.array([scan.run_map(series[a.value], begin, a.alpha) for a in averages]).T
            state = scan.advanced(state, run, scan.alphas(averages))
            state[1] -= last
            ends.append(state.ravel())
        return block[["symbol", "chunk"]].assign(first=[ends[0]], line=[ends[1]])

    ends = s.by_block(s.before, after, f"{s.keys}, first array<double>, line array<double>")
    return ends.groupBy("symbol").agg(F.max_by(F.struct("first", "line"), "chunk").alias("e")).select("symbol", "e.*")


def with_technical_columns(d: DataFrame, blocks: DataFrame, fc: FeatureConfig, size: int) -> DataFrame:
    """Add the averages behind the indicators to bars with pos and `chunk`, the block they lie in."""
    names = {c: f"{c}_block" for c in average_columns(fc)}
    d = d.join(blocks.withColumnsRenamed(names), ["symbol", "chunk"])
    return d.withColumns({c: scan.place(b, size) for c, b in names.items()}).drop(*names.values())


def technical_indicators(fc: FeatureConfig) -> Group:
    """Row arithmetic on the columns of `with_technical_columns`."""
    n = fc.rsi_window_bars
    strength = div("_avg_gain", clip_lower("_avg_loss", EPS))
    ema = {
        f"ema_dist_{w}m": div(F.col("close") - F.col(f"_ema_{w}"), clip_lower(f"_ema_{w}", EPS))
        for w in fc.ema_windows_bars
    }
    return Group(
        {
            **ema,
            f"rsi_{n}m": (100.0 - 100.0 / (1.0 + strength)) / 100.0,
            "macd_line": F.col("_macd"),
            "macd_signal": F.col("_macd_signal"),
            "macd_hist": F.col("_macd") - F.col("_macd_signal"),
        },
        warmup=max(*fc.ema_windows_bars, n, fc.macd_slow_bars + fc.macd_signal_bars),
    )
