"""Session clock and distance from the session's volume-weighted price.

The session's bounds and the volume totals of its earlier slots come from the slot table, so
only bars of one clock hour are ordered together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.config import FeatureConfig
from barwright.functions.expr import EPS, clip_lower, div
from barwright.operators.features.group import Group
from barwright.operators.positions import SLOT_KEYS

#: slot-table columns these groups read
SLOT_COLUMNS = ("open_ts", "end_ts", "pv0", "vol0")


def _minutes(later: str, earlier: str) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60e6)


def session_time(fc: FeatureConfig) -> Group:
    """Minutes from the first and to the last bar observed in the session, and its phase."""
    since, to = _minutes("ts", "open_ts"), _minutes("end_ts", "ts")
    phase = since / clip_lower(_minutes("end_ts", "open_ts"), 1.0) * (2.0 * math.pi)
    return Group(
        {
            "minutes_since_open": since,
            "minutes_to_close": to,
            "sin_time": F.sin(phase),
            "cos_time": F.cos(phase),
        }
    )


def with_session_vwap(positioned: DataFrame) -> DataFrame:
    """Add `session_vwap`, through the current bar."""
    w = Window.partitionBy(*SLOT_KEYS).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    pv = (F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume")
    cum_pv = F.when(pv.isNotNull(), F.col("pv0") + F.sum(pv).over(w))
    cum_v = F.when(F.col("volume").isNotNull(), F.col("vol0") + F.sum("volume").over(w))
    return positioned.withColumn("session_vwap", div(cum_pv, clip_lower(cum_v, EPS)))


def vwap_distance(fc: FeatureConfig) -> Group:
    v = F.col("session_vwap")
    return Group({"vwap_session_dist_pct": div(F.col("close") - v, clip_lower(v, EPS))})
