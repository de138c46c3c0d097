"""Business policies as plain parameters.

Every threshold, window and vocabulary choice a question may override lives here. The defaults are
the stated standard definitions; windows have no sensible default and must be given.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Vocabulary members the standard definitions name.
HIGH_SEVERITIES = ("High", "Critical")
EXPANSION_TYPES = ("Expansion", "Project")
DELIVERED_TYPES = ("demo", "meeting")


@dataclass(frozen=True)
class SlipPolicy:
    """When an open opportunity is likely to miss its expected close."""

    window_start: date
    window_end: date  # exclusive
    as_of: date
    base: date  # notes and tickets count from `signal_days` before this day
    activity_days: int = 14
    stagnant_days: int = 21
    signal_days: int = 60
    severities: tuple[str, ...] = HIGH_SEVERITIES
    exact_tag: str | None = None  # None: any tag text containing "risk"
    product_id: object | None = None
    policy_id: str = "default"


@dataclass(frozen=True)
class RenewalPolicy:
    """When a renewal is at risk."""

    window_start: date
    window_end: date  # exclusive
    expansion_limit: float = 100_000.0  # strictly below is low
    incident_min: int = 3
    severities: tuple[str, ...] = HIGH_SEVERITIES
    expansion_types: tuple[str, ...] = EXPANSION_TYPES
    low_csat_max: int = 2
    open_only: bool = False
    product_id: object | None = None
    policy_id: str = "default"


@dataclass(frozen=True)
class AcceleratePolicy:
    """Which open opportunities can be pulled forward."""

    window_start: date
    window_end: date  # exclusive
    stage: str = "Proposal"
    delivered_types: tuple[str, ...] = DELIVERED_TYPES
    min_delivered: int = 1
    blocking_signal: str = "risk"
    require_forecast: bool = False
    product_id: object | None = None
    policy_id: str = "default"
