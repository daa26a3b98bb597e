"""All registered queries."""

from pairlens.plans import agreement_queries, contract_queries, control_queries, pairwise_queries, quality_queries, run_queries, stream_queries, text_queries, trace_queries  # noqa: F401
from pairlens.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
