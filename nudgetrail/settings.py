"""Everything a study takes as an argument: dates, labels, cutoffs and options.

The library holds no label, cutoff, message type or date of its own.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class StudyDates:
    """The dates one study shares between all its stages.

    ``nudge_end`` is the first day after the nudge window; ``obs_end`` is the last day of the
    observation window. ``as_of`` closes the last cycle of every item, so that a study gives the
    same result on whatever day it is run.
    """

    campaign_date: date
    nudge_start: date
    nudge_end: date
    obs_start: date
    obs_end: date
    as_of: date

    def __post_init__(self) -> None:
        if self.nudge_start >= self.nudge_end:
            raise ValueError("nudge_start must be before nudge_end")
        if self.obs_start > self.obs_end:
            raise ValueError("obs_start must not be after obs_end")


@dataclass(frozen=True)
class CampaignSpec:
    """Which messages make up the campaign, and what counts as opening one."""

    message_types: tuple[str, ...]
    provider_key: str
    open_events: tuple[str, ...]
    internal_address: str | None = None
    """LIKE pattern; a message to a matching (or missing) address is left out."""
    day_slack: int = 1
    """Days before and after the campaign date that still count as the campaign."""
    environment: str | None = None
    """Only read by the row-count roster: tracking events of other environments are left out."""
    region_remap: Mapping[str, str] = field(default_factory=dict)
    """Only read by the row-count roster: tracking region code -> message region code."""


@dataclass(frozen=True)
class NudgeSpec:
    """Which messages are nudges, and which of them belong to the study."""

    message_types: tuple[str, ...]
    provider_key: str
    item_key: str
    exclude_pattern: str | None = None
    exclude_on: str = "msg_id"
    """Column the LIKE pattern is tested on: the message id, or ``"address"``."""
    match_region: bool = False
    """Also match message and context rows on region, for ids that repeat across regions."""
    member: str = "listed"
    """``"listed"`` keeps every campaign recipient, ``"opened"`` only those who opened."""

    def __post_init__(self) -> None:
        if self.member not in ("listed", "opened"):
            raise ValueError("member must be 'listed' or 'opened'")


@dataclass(frozen=True)
class Bands:
    """Score cutoffs of one country, ascending, and the bound a score must stay within."""

    cutoffs: tuple[float, ...]
    bound: float

    def __post_init__(self) -> None:
        if list(self.cutoffs) != sorted(set(self.cutoffs)):
            raise ValueError("cutoffs must be ascending")


@dataclass(frozen=True)
class RatingRules:
    """How ratings are relabelled, displayed and banded."""

    special_country: str
    """The country whose ratings come from the second model."""
    relabel: Mapping[str, str]
    """Second-model rating -> rating."""
    display: Mapping[str, str]
    """Rating codes with a display label of their own; others are title-cased."""
    top_label: str
    """Display label that cannot be improved on."""
    bands: Mapping[str, Bands]
    """Country -> score bands."""
    launch_date: date
    """First day the bands are valid."""


@dataclass(frozen=True)
class ReportLabels:
    """Country code -> label. A missing country counts as ``home_country``."""

    countries: Mapping[str, str]
    home_country: str
    other: str = "Other"
