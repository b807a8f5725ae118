"""All registered queries; importing this module fills the registry."""

from threadwatch.plans import q_annotate, q_collect, q_eval, q_figures, q_files, q_gold, q_privacy, q_risk, q_threads  # noqa: F401
from threadwatch.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
