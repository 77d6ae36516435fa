"""Registered queries. Importing this package fills the registry."""

from metricloom.plans import (  # noqa: F401
    aggregates, bindings, cleaning, experiments, filters, inference, joins, metrics_billing, metrics_catalog,
    metrics_product, metrics_revenue, outliers, profile, projections, reshape, scalars, sources, windows,
)
from metricloom.plans.registry import REGISTRY  # noqa: F401
