"""Bar labelling, features, weights and strategy evaluation as Spark DataFrame operators."""

from barwright.config import ExperimentConfig
from barwright.session import build_session, require_utc

__all__ = ["ExperimentConfig", "build_session", "require_utc"]
