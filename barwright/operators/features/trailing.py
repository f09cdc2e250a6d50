"""Returns, realised volatility, range volatility and relative volume over trailing bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barwright.config import FeatureConfig
from barwright.functions.expr import EPS, clip_lower, div, ln, ln_ratio
from barwright.operators.features.group import Group, back, deviation_of, mean_of, median_of

PARKINSON_SCALE = 1.0 / (4.0 * math.log(2.0))


def returns_multi_horizon(fc: FeatureConfig) -> Group:
    hs = fc.returns_horizons_bars
    return Group(
        base={f"_close_{h}": back("close", h) for h in hs},
        final={f"ret_{h}m": ln_ratio("close", f"_close_{h}") for h in hs},
        reach=max(hs),
        warmup=max(hs),
    )


def realized_vol_multi(fc: FeatureConfig) -> Group:
    ws = fc.realized_vol_windows_bars
    final = {f"rv_{w}m": F.col(f"_rv_{w}") for w in ws}
    if fc.realized_vol_include_ratio and len(ws) >= 2:
        short, long = ws[0], ws[-1]
        final[f"rv_ratio_{short}_{long}m"] = div(f"_rv_{short}", clip_lower(f"_rv_{long}", EPS))
    return Group(
        lags={"_prev_close": back("close", 1)},
        base={"_ret": ln_ratio("close", "_prev_close")},
        frames={f"_rv_{w}": deviation_of("_ret", w) for w in ws},
        final=final,
        reach=max(ws),
        warmup=max(ws),
    )


def range_vol_multi(fc: FeatureConfig) -> Group:
    w = fc.range_vol_window_bars
    hl = ln(div("high", clip_lower("low", EPS)))
    prev = back("close", 1)
    base = {"_park": hl * hl * PARKINSON_SCALE}
    frames = {"_park_mean": mean_of("_park", w)}
    final = {f"parkinson_{w}m": F.sqrt("_park_mean")}
    if fc.range_vol_include_atr_norm:
        # greatest() skips nulls, so the first bar's true range is high - low.
        base["_true_range"] = F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
        )
        frames["_atr"] = mean_of("_true_range", w)
        final[f"atr_norm_{w}m"] = div("_atr", clip_lower("close", EPS))
    return Group(base=base, frames=frames, final=final, reach=w, warmup=w)


def volume_context(fc: FeatureConfig) -> Group:
    w = fc.volume_median_window_bars
    rel = div("volume", clip_lower("_vol_med", EPS))
    return Group(
        frames={"_vol_med": median_of("volume", w)},
        final={"rel_volume": rel, "log_rel_volume": F.ln(clip_lower(rel, EPS))},
        reach=w,
        warmup=w,
    )
