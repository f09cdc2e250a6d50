"""Exponential averages of series with gaps, as an associative scan of affine maps.

An observation x that follows the last one k rows later takes an average from y to

    (q y + alpha x) / (q + alpha),    q = (1 - alpha)^k,

and a missing value leaves it as it is (`ewm(adjust=False)` in pandas). Each step is an affine map of y, and so is any run
of steps: six numbers say what a run of rows does to an average, whatever came before it,

    n, first, last   observations, and the positions of the first and last one
    x                value at `first`
    a, b             the steps after `first`: y -> a y + b

Series are cut into blocks of rows. A block's map is computed where its rows are, the maps of a symbol are applied one
after the other, which is a stream of one small row for each `BLOCK_ROWS` bars, and each block then starts from the exact
average before it. Nothing old is left out, however far back, and no task holds more than the rows of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
MAP, STATE = 6, 3


@dataclass(frozen=True)
class Average:
    """Average of column `value` with weight `alpha`, null before `min_periods` observations, into `name`."""

    name: str
    value: str
    alpha: float
    min_periods: int


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def alphas(averages: list[Average]) -> np.ndarray:
    return np.array([s.alpha for s in averages])


def recursion(x: np.ndarray, alpha: float) -> np.ndarray:
    """The average along consecutive rows, from the first value on; NaN is a missing value."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def step(y: np.ndarray, x: np.ndarray, rows: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The average after the observation x that comes `rows` rows after the last one."""
    q = np.power(1.0 - alpha, rows)
    return (q * y + alpha * x) / (q + alpha)


def run_map(x: np.ndarray, start: int, alpha: float) -> list[float]:
    """The map of consecutive rows that begin at position `start`."""
    seen = np.flatnonzero(~np.isnan(x))
    if not len(seen):
        return [0.0] * MAP
    first, last = int(seen[0]), int(seen[-1])
    gaps = np.diff(seen)
    a = float(np.exp(np.sum(gaps * np.log1p(-alpha) - np.log(np.power(1.0 - alpha, gaps) + alpha)))) if alpha < 1 else float(len(seen) == 1)
    rest = x[first : last + 1].copy()
    rest[0] = 0.0
    return [float(len(seen)), start + first, start + last, float(x[first]), a, float(recursion(rest, alpha)[-1])]


def advanced(state: np.ndarray, run: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """(n, last, y) after a run of rows; (3, averages) arrays."""
    n, last, y = state
    m, first, end, x, a, b = run
    at_first = np.where(n == 0, x, step(y, x, np.maximum(first - last, 0.0), alpha))
    return np.where(m == 0, state, np.stack([n + m, end, a * at_first + b]))


def run_values(x: np.ndarray, start: int, average: Average, state: np.ndarray) -> np.ndarray:
    """The average at each of consecutive rows, given (n, last, y) before them; NaN before `min_periods`."""
    n, last, y = state
    out = np.full(len(x), y if n else np.nan)
    there = ~np.isnan(x)
    seen = np.flatnonzero(there)
    if len(seen):
        first = int(seen[0])
        rest = x[first:].copy()
        if n:
            rest[0] = step(y, x[first], np.float64(start + first - last), np.float64(average.alpha))
        out[first:] = recursion(rest, average.alpha)
    out[n + np.cumsum(there) < average.min_periods] = np.nan
    return out


#: the values an average reads, from the rows of one block (ordered by pos)
Series = Callable[[pd.DataFrame], dict[str, np.ndarray]]


def key_types(rows: DataFrame) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("symbol", "chunk"))


def block_maps(rows: DataFrame, averages: list[Average], series: Series) -> DataFrame:
    """(symbol, chunk, run): what each block of rows (symbol, chunk, pos, ...) does to the averages."""

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x, start = series(pdf), int(pdf["pos"].iloc[0])
        run = np.array([run_map(x[s.value], start, s.alpha) for s in averages]).T
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "run": [run.ravel()]})

    return rows.groupBy("symbol", "chunk").applyInPandas(maps, f"{key_types(rows)}, run array<double>")


def states(maps: DataFrame, averages: list[Average], name: str, *kept: str, start: DataFrame | None = None) -> DataFrame:
    """(symbol, chunk, `kept`, `name`): the state of the averages before each block, from the maps `run` in order.

    `start` (symbol, start) holds the states before the first block of symbols whose series began earlier.
    """
    alpha, count = alphas(averages), len(averages)
    maps = maps.join(start, "symbol", "left") if start is not None else maps.withColumn("start", F.lit(None).cast("array<double>"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, now = None, np.zeros((STATE, count))
        for pdf in batches:
            out = []
            for s, r, begun in zip(pdf["symbol"], pdf["run"], pdf["start"], strict=True):
                if s != symbol:
                    symbol, now = s, np.zeros((STATE, count)) if begun is None else np.asarray(begun, float).reshape(STATE, count)
                out.append(now.ravel())
                now = advanced(now, np.asarray(r, float).reshape(MAP, count), alpha)
            yield pdf.drop(columns=["run", "start"]).assign(**{name: out})[["symbol", "chunk", *kept, name]]

    schema = ", ".join([key_types(maps), *[f"{c} {maps.schema[c].dataType.simpleString()}" for c in kept], f"{name} array<double>"])
    ordered = maps.select("symbol", "chunk", *kept, "run", "start").repartition("symbol").sortWithinPartitions("symbol", "chunk")
    return ordered.mapInPandas(walk, schema)


def state_before(block: pd.DataFrame, averages: list[Average], name: str) -> np.ndarray:
    """(3, averages): the states before a block, from its row of `states`."""
    return np.asarray(block[name].iloc[0], float).reshape(STATE, len(averages))


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col("pos") / size))


def place(column: str, size: int):
    """The element of a block's array that belongs to the row; NaN, a value not there yet, is null."""
    x = F.get(F.col(column), F.pmod(F.col("pos"), F.lit(size)).cast("int"))
    return F.when(~F.isnan(x), x)


def with_averages(df: DataFrame, averages: list[Average], *, size: int = BLOCK_ROWS) -> DataFrame:
    """Add one column for each average to a frame with symbol, a gap-free `pos` and the value columns."""
    values = sorted({s.value for s in averages})

    def read(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {v: pdf[v].to_numpy(float) for v in values}

    def fill(pdf: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x, start, before = read(pdf), int(pdf["pos"].iloc[0]), state_before(block, averages, "before")
        out = {"symbol": pdf["symbol"].iloc[:1].to_list(), "chunk": pdf["chunk"].iloc[:1].to_list()}
        return pd.DataFrame(out | {s.name: [run_values(x[s.value], start, s, before[:, i])] for i, s in enumerate(averages)})

    rows = in_blocks(df.select("symbol", "pos", *values), size)
    before_ = states(block_maps(rows, averages, read), averages, "before")
    schema = ", ".join([key_types(rows), *[f"{s.name} array<double>" for s in averages]])
    blocks = rows.groupBy("symbol", "chunk").cogroup(before_.groupBy("symbol", "chunk")).applyInPandas(fill, schema)
    names = {s.name: f"_{s.name}_block" for s in averages}
    joined_ = in_blocks(df, size).join(blocks.withColumnsRenamed(names), ["symbol", "chunk"])
    return joined_.withColumns({k: place(v, size) for k, v in names.items()}).drop("chunk", *names.values())
