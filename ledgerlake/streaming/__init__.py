"""Streaming entry points.

The reference has no streams (its "real-time" wording names future work), so
no operator here keeps state of its own. What the package offers is the same
positions → risk plan run incrementally: ``live_risk`` takes a *streaming*
facts DataFrame, keeps the per-entity sums in Structured Streaming state
(a streaming aggregation, update mode) and derives the risk columns as plain
projections on every micro-batch. Nothing else changes, so batch and stream
results agree on the same facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlake.operators.positions import rollup_positions
from ledgerlake.operators.risk import risk_factors, risk_summary


def live_risk(facts_stream: DataFrame, by=("entity_id",)) -> DataFrame:
    """Streaming positions rollup (stateful sums) followed by R1/R2 (stateless)."""
    return risk_summary(risk_factors(rollup_positions(facts_stream, by=by)))
