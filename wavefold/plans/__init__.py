"""Registered queries over the driver's tables, grouped as their operators are."""

from wavefold.plans import cleaning, features, ingestion, models, signals, streams  # noqa: F401
from wavefold.plans.registry import ORACLES, QUERIES  # noqa: F401
