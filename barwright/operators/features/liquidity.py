"""Spread and illiquidity proxies from bars alone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barwright.config import FeatureConfig
from barwright.functions.expr import EPS, clip_lower, div, ln, ln_ratio
from barwright.operators.features.group import Group, back, mean_of, median_of

CS_K = 3.0 - 2.0 * math.sqrt(2.0)


def _corwin_schultz(beta: Column, gamma: Column) -> Column:
    """Spread from the mean two-bar sum of squared log ranges and the squared two-bar log range."""
    a = (F.sqrt(2.0 * beta) - F.sqrt(clip_lower(beta, 0.0))) / CS_K - F.sqrt(clip_lower(gamma / CS_K, 0.0))
    e = F.exp(clip_lower(a, 0.0))
    return 2.0 * (e - 1.0) / (1.0 + e)


def order_flow_proxies(fc: FeatureConfig) -> Group:
    w, wa = fc.roll_window_bars, fc.amihud_window_bars
    low = clip_lower("low", EPS)
    prev_low = clip_lower("_prev_low", EPS)
    sq, prev_sq = F.pow(ln(div("high", low)), 2), F.pow(ln(div("_prev_high", prev_low)), 2)
    has_prev = F.col("_prev_high").isNotNull() & F.col("_prev_low").isNotNull()
    two_range = F.when(has_prev, ln(div(F.greatest("high", "_prev_high"), F.least(low, prev_low))))
    ret, prev_ret = ln_ratio("close", "_prev_close"), ln_ratio("_prev_close", "_prev_close_2")
    dollars = F.col("close") * F.col("volume")

    span = clip_lower(F.col("high") - F.col("low"), EPS)
    covariance = F.col("_r_lag_mean") - F.col("_r_mean") * F.col("_lag_mean")
    rel_vol = div("volume", clip_lower("_flow_vol_med", EPS))
    return Group(
        lags={
            "_prev_close": back("close", 1), "_prev_close_2": back("close", 2),
            "_prev_high": back("high", 1), "_prev_low": back("low", 1),
        },
        base={
            "_cs_beta": sq + prev_sq,
            "_cs_gamma": F.pow(two_range, 2),
            "_r": ret,
            "_lag_r": prev_ret,
            "_r_lag": ret * prev_ret,
            "_illiq": div(F.abs(ret), F.when(dollars != 0, dollars)),
        },
        frames={
            "_cs_beta_mean": mean_of("_cs_beta", w),
            "_r_mean": mean_of("_r", w),
            "_lag_mean": mean_of("_lag_r", w),
            "_r_lag_mean": mean_of("_r_lag", w),
            "_illiq_mean": mean_of("_illiq", wa),
            "_flow_vol_med": median_of("volume", w),
        },
        final={
            "corwin_schultz_spread": _corwin_schultz(F.col("_cs_beta_mean"), F.col("_cs_gamma")),
            # an infinite return has no covariance: 0 * inf is NaN
            "roll_implied_spread": 2.0 * F.sqrt(clip_lower(-covariance, 0.0)) + 0.0 * F.col("_r_lag_mean"),
            "amihud_illiq": F.col("_illiq_mean"),
            "signed_volume_proxy": div(F.col("close") - F.col("open"), span) * rel_vol,
            "upper_wick_pct": div(F.col("high") - F.greatest("open", "close"), span),
            "lower_wick_pct": div(F.least("open", "close") - F.col("low"), span),
        },
        reach=max(w + 1, wa + 1),
        warmup=max(w, wa),
    )
