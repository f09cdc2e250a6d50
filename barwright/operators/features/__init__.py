"""Point-in-time feature groups and the feature matrix."""

from barwright.operators.features.matrix import feature_matrix, feature_table, split_by_session
from barwright.operators.features.registry import feature_columns, warmup_bars

__all__ = ["feature_columns", "feature_matrix", "feature_table", "split_by_session", "warmup_bars"]
