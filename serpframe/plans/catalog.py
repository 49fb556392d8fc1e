"""All checked queries, registered by the ``q_*`` modules."""

from serpframe.plans import q_io, q_ops, q_platforms, q_results, q_text  # noqa: F401
from serpframe.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "flatten_organic"
