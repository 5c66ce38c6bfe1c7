"""All registered queries of the engine's own operators: importing the parts fills the registry."""

from . import q_audit, q_changes, q_events, q_gates, q_leads, q_normalize, q_scoring, q_streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
