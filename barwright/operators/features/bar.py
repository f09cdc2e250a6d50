"""Groups that need only the entry bar."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barwright.config import FeatureConfig
from barwright.functions.expr import EPS, clip_lower, div
from barwright.operators.features.group import Group


def log_entry_close(fc: FeatureConfig) -> Group:
    return Group({"log_entry_close": F.ln(clip_lower("entry_close", EPS))})


def label_geometry(fc: FeatureConfig) -> Group:
    names = ("sigma_ann_at_entry", "vol_scale_ratio", "tp_move_effective", "sl_move")
    return Group({c: F.col(c).cast("double") for c in names})


def intraday_range_pct(fc: FeatureConfig) -> Group:
    return Group({"intraday_range_pct": div(F.col("high") - F.col("low"), clip_lower("entry_close", EPS))})


def log1p_volume(fc: FeatureConfig) -> Group:
    return Group({"log1p_volume": F.log1p(clip_lower("volume", 0.0))})


def bar_microstructure(fc: FeatureConfig) -> Group:
    span = clip_lower(F.col("high") - F.col("low"), EPS)
    c = F.col("entry_close")
    return Group(
        {
            "close_loc_value": div(c - F.col("low"), span),
            "bar_body_pct": div(c - F.col("open"), clip_lower(c, EPS)),
        }
    )


def session_day_of_week(fc: FeatureConfig) -> Group:
    """Cyclical weekday; a weekend session date stops the job."""
    day = F.weekday("session_date")
    day = F.when(
        day > 4, F.raise_error(F.concat(F.lit("entry on a weekend session date: "), F.col("session_date")))
    ).otherwise(day)
    angle = day / F.lit(5.0) * (2.0 * math.pi)
    return Group({"sin_dow": F.sin(angle), "cos_dow": F.cos(angle)})
