"""What a feature group contributes to the plan.

Spark evaluates a window over a window only in separate projections, so a group names its
columns by stage: `lags` are plain lags, `base` may use both, `frames` summarises base columns over trailing rows,
`final` is plain row arithmetic. All groups share one projection per stage, hence one sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.config import FeatureConfig
from barwright.functions.expr import full, trailing

CHUNK_KEYS = ["symbol", "chunk"]
#: longest frame (rows) that is read row by row
SHORT = 16


@dataclass(frozen=True)
class Frame:
    """Mean, sample deviation or median of a base column over the last `rows` bars.

    Null unless all of the rows hold a value. Frames run across sessions.
    """

    kind: str
    column: str
    rows: int


def mean_of(column: str, rows: int) -> Frame:
    return Frame("mean", column, rows)


def deviation_of(column: str, rows: int) -> Frame:
    return Frame("deviation", column, rows)


def median_of(column: str, rows: int) -> Frame:
    return Frame("median", column, rows)


@dataclass(frozen=True)
class Group:
    final: dict[str, Column]
    lags: dict[str, Column] = field(default_factory=dict)
    base: dict[str, Column] = field(default_factory=dict)
    frames: dict[str, Frame] = field(default_factory=dict)
    #: rows before the current one that any chained frame of the group can reach
    reach: int = 0
    #: bars an entry must have before it for the group to be complete
    warmup: int = 0


Builder = Callable[[FeatureConfig], Group]


def back(c: str, k: int) -> Column:
    return F.lag(c, k).over(Window.partitionBy(*CHUNK_KEYS).orderBy("pos"))


def with_frames(d: DataFrame, frames: dict[str, Frame]) -> DataFrame:
    """Add the frames' columns to rows split by `with_halo`.

    Means and deviations come from two stacks: positions are cut into tiles as long as the frame, so a frame is the rest
    of one tile, from its first row on, and the begin of the next. Both parts are running (count, mean, squared
    deviation) and merge into those of the frame. A row costs the same for any length, nothing is subtracted, and no
    value outside the frame takes part. Medians need the frame's values; short frames are plain windows.
    """
    moments: dict[int, dict[str, bool]] = {}
    for f in frames.values():
        if f.kind != "median" and f.rows > SHORT:
            spread = moments.setdefault(f.rows, {})
            spread[f.column] = spread.get(f.column, False) or f.kind == "deviation"
    tiles = {f"_tile{n}": F.floor(F.col("pos") / n) for n in moments}
    made, rest = list(tiles), {}
    d = d.withColumns(tiles) if tiles else d
    for n, columns in moments.items():
        for side, order in (("p", F.asc("pos")), ("s", F.desc("pos"))):
            w = Window.partitionBy(*CHUNK_KEYS, f"_tile{n}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            parts = {}
            for c, deviation in columns.items():
                kinds = {"n": F.count(c), "m": F.avg(c)} | ({"v": F.var_pop(c)} if deviation else {})
                parts |= {f"_{side}{k}{n}{c}": agg.over(w) for k, agg in kinds.items()}
                if side == "s":
                    rest |= {f"_l{k}{n}{c}": back(f"_s{k}{n}{c}", n - 1) for k in kinds}
            d = d.withColumns(parts)
            made += parts
    d = d.withColumns(rest) if rest else d
    made += rest

    def moment(f: Frame) -> Column:
        n, c = f.rows, f.column
        whole = F.pmod(F.col("pos"), F.lit(n)) == n - 1  # the frame is one tile
        n1 = F.when(whole, F.lit(0)).otherwise(F.coalesce(f"_ln{n}{c}", F.lit(0)))
        n2 = F.col(f"_pn{n}{c}")
        m1, m2 = F.when(n1 > 0, F.col(f"_lm{n}{c}")).otherwise(0.0), F.coalesce(f"_pm{n}{c}", F.lit(0.0))
        if f.kind == "mean":
            return F.when(n1 + n2 == n, (n1 * m1 + n2 * m2) / n)
        v1, v2 = F.when(n1 > 0, F.col(f"_lv{n}{c}")).otherwise(0.0), F.coalesce(f"_pv{n}{c}", F.lit(0.0))
        squares = n1 * v1 + n2 * v2 + (m2 - m1) * (m2 - m1) * n1 * n2 / n
        return F.when(n1 + n2 == n, F.sqrt(F.try_divide(squares, F.lit(n - 1.0))))

    def median(f: Frame) -> Column:
        n = f.rows
        w = Window.partitionBy(*CHUNK_KEYS).orderBy("pos").rowsBetween(1 - n, 0)
        seen = F.sort_array(F.collect_list(f.column).over(w))
        return F.when(F.size(seen) == n, (F.get(seen, F.lit((n - 1) // 2)) + F.get(seen, F.lit(n // 2))) / 2.0)

    def short(f: Frame) -> Column:
        agg = F.avg(f.column) if f.kind == "mean" else F.stddev_samp(f.column)
        return full(agg, f.column, trailing(CHUNK_KEYS, "pos", f.rows), f.rows)

    def of(f: Frame) -> Column:
        return median(f) if f.kind == "median" else short(f) if f.rows <= SHORT else moment(f)

    return d.withColumns({k: of(f) for k, f in frames.items()}).drop(*made)
