"""Parameters of the extract and of the reports.

Lists of people, telephone numbers, centres and table names are deployment
configuration and have no defaults here.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Thresholds, labels and names that results depend on.
SHORT_CALL_SECONDS = 30
TENURE_LIMITS = (
    (30, "0-30 day Tenure"),
    (60, "31-60 day Tenure"),
    (90, "61-90 day Tenure"),
    (120, "91-120 day Tenure"),
    (150, "121-150 day Tenure"),
)
TENURE_VETERAN = "Vet"
POINTS_BEFORE_CHANGE = 28
POINTS_FROM_CHANGE = 25
POINTS_CHANGE_DATE = date(2023, 6, 1)
PREPAID_COUNTS_AFTER = date(2023, 10, 9)
PREPAID_PRODUCT = "12 Month - Prepaid"
ORDER_TIME_ZONE = "America/New_York"
INBOUND = "INBOUND"
MANUAL_OUTBOUND = "MANUAL_OUTBOUND"
UNKNOWN = "UNKNOWN"
BUCKET_OTHER = "Other"
CALL_TYPE_LEASE = "Permalease"
CALL_TYPE_SITE = "Site Session"
INTENT_LABELS = {"MOVING": "mover", "SWITCHING": "switcher"}
INTENT_NONE = "Uncollected"
COST_PER_MINUTE = 0.4
NEUTRAL_CHANGE_PCT = 1.5
LOWER_IS_BETTER = ("Talk Time", "Sold Talk Time", "Unsold Talk Time", "tt")


@dataclass(frozen=True)
class Labels:
    """Names of the two populations; the extract and the lift data may differ."""

    treatment: str = "treatment"
    control: str = "control"


@dataclass(frozen=True)
class ExtractConfig:
    """What the call-mart extract needs to know besides its input tables."""

    from_date: date
    labels: Labels = field(default_factory=Labels)
    excluded_agents: tuple[str, ...] = ()
    excluded_centers: tuple[str, ...] = ()
    non_lease_numbers: tuple[str, ...] = ()
    prepaid_product: str = PREPAID_PRODUCT
    order_time_zone: str = ORDER_TIME_ZONE
    anchor_bucket_seconds: int = 3600
    # Calls from this day on may be anchors of short calls from from_date on; without it only calls
    # from from_date on are, as in one run over all data. An incremental run sets it some days back.
    anchor_from: date | None = None
    # Sessions and orders from this day on belong to the calls; without it those from from_date on. An incremental run
    # names the day of the first run, so that it sees what one run over all days would.
    related_from: date | None = None
    # "all": a short call is repeated for each of its tied anchors; "one": the smallest id among them counts.
    anchor_ties: str = "all"


@dataclass(frozen=True)
class CallFilters:
    """Selections of a report user; an empty selection keeps everything."""

    start: date | None = None
    end: date | None = None
    center_location: tuple[str, ...] = ()
    marketing_bucket: tuple[str, ...] = ()
    mover_switcher: tuple[str, ...] = ()
    tenure_bucket: tuple[str, ...] = ()
    call_type: tuple[str, ...] = ()

    def without_dates(self) -> "CallFilters":
        return CallFilters(
            center_location=self.center_location,
            marketing_bucket=self.marketing_bucket,
            mover_switcher=self.mover_switcher,
            tenure_bucket=self.tenure_bucket,
            call_type=self.call_type,
        )


@dataclass(frozen=True)
class LiftWindow:
    """Which lift rows to compare.

    The baseline dates bound the fixed baseline. The post dates are what a user
    picked; open ends take all post rows there are.
    """

    pre_start: date
    pre_end: date
    post_from: date | None = None
    post_to: date | None = None
    excluded_week: str | None = None


@dataclass(frozen=True)
class LiftCentre:
    """Where a centre's lift files are, and its announced test dates.

    The announced post dates are for display: which post rows count is decided
    by the rows themselves and by the user's choice.
    """

    file_base: str
    pre_start: date
    pre_end: date
    post_start: date
    post_end: date

    def window(
        self, post_from: date | None = None, post_to: date | None = None, excluded_week: str | None = None
    ) -> LiftWindow:
        return LiftWindow(self.pre_start, self.pre_end, post_from, post_to, excluded_week)
