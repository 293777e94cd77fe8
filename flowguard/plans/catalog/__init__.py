"""Registered queries, one module per area."""

from flowguard.plans.catalog import artifacts, detection, detectors, evaluation, flows, monitoring, preparation, sources, streams, telemetry  # noqa: F401
