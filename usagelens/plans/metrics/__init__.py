"""The usage metrics. ``METRICS`` maps each name to its declaration."""

from __future__ import annotations

from usagelens.plans.metrics.model import MetricResult, MetricSpec, run_metric
from usagelens.plans.metrics import derived, volumes

METRICS: dict[str, MetricSpec] = {s.name: s for s in (*volumes.SPECS, *derived.SPECS)}

__all__ = ["METRICS", "MetricResult", "MetricSpec", "run_metric"]
