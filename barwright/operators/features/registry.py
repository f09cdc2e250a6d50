"""Feature flags to group builders, in output column order."""

from __future__ import annotations

from barwright.config import FEATURE_GROUPS, FeatureConfig
from barwright.operators.features import bar, liquidity, market, session, technical, trailing
from barwright.operators.features.group import Builder, Group

_MODULES = (bar, trailing, session, market, technical, liquidity)

BUILDERS: dict[str, Builder] = {
    name: next(getattr(m, name) for m in _MODULES if hasattr(m, name)) for name in FEATURE_GROUPS
}


def groups(fc: FeatureConfig) -> dict[str, Group]:
    return {name: BUILDERS[name](fc) for name in fc.enabled()}


def feature_columns(fc: FeatureConfig) -> list[str]:
    return [c for g in groups(fc).values() for c in g.final]


def warmup_bars(fc: FeatureConfig) -> int:
    return max((g.warmup for g in groups(fc).values()), default=0)
