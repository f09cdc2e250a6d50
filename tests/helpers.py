"""Small bar tables for tests."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barwright.operators.positions import with_session

MONDAY = datetime(2024, 1, 8, 14, 30, tzinfo=timezone.utc)


def session_times(days: int, per_day: int, start: datetime = MONDAY, minutes: int = 1) -> list[datetime]:
    """Weekday sessions of `per_day` bars each."""
    out, d = [], start
    while len(out) < days * per_day:
        if d.weekday() < 5:
            out += [d + timedelta(minutes=minutes * i) for i in range(per_day)]
        d += timedelta(days=1)
    return out


def frame(times, close, *, high=None, low=None, open_=None, volume=None, symbol="AAA") -> pd.DataFrame:
    close = np.asarray(close, dtype=float)
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.to_datetime(times, utc=True),
            "open": close if open_ is None else np.asarray(open_, dtype=float),
            "high": close if high is None else np.asarray(high, dtype=float),
            "low": close if low is None else np.asarray(low, dtype=float),
            "close": close,
            "volume": np.full(len(close), 1000.0) if volume is None else np.asarray(volume, dtype=float),
        }
    )


def walk(days: int, per_day: int, seed: int, symbol="AAA", scale=0.004) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    n = days * per_day
    close = 100 * np.exp(np.cumsum(rng.normal(0, scale, n)))
    spread = np.abs(rng.normal(0, scale, n))
    open_ = close * (1 + rng.normal(0, scale / 4, n))
    return frame(
        session_times(days, per_day), close, open_=open_,
        high=np.maximum(open_, close) * (1 + spread), low=np.minimum(open_, close) * (1 - spread),
        volume=rng.integers(1, 5000, n), symbol=symbol,
    )


def bars_of(spark, pdf: pd.DataFrame, tz: str = "UTC"):
    """Session-dated bars; NaN in the frame is a missing value."""
    d = spark.createDataFrame(pdf.assign(ts=pdf["ts"].dt.tz_convert("UTC").dt.tz_localize(None)))
    doubles = [f.name for f in d.schema.fields if f.dataType.typeName() == "double"]
    return with_session(d.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in doubles}), tz)
