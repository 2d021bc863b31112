"""All named queries."""

from __future__ import annotations

from splitlane.plans import drilldowns, exclusions, experiments, foundation, inference, measures, rollups, sequences, sequential
from splitlane.plans.common import Query

QUERIES: dict[str, Query] = {
    **foundation.QUERIES,
    **measures.QUERIES,
    **experiments.QUERIES,
    **drilldowns.QUERIES,
    **sequential.QUERIES,
    **inference.QUERIES,
    **sequences.QUERIES,
    **rollups.QUERIES,
    **exclusions.QUERIES,
}
