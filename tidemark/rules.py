"""Values the results depend on: headers, labels, sentences, thresholds and point tables.

Everything here is a fixed value that decides a result.  ``Rules`` carries the
ones a caller may want to change; its defaults are the standard rule set.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: source file headers and the column each one feeds -----------------------
HEADER_TO_COLUMN = {
    "Company Name": "company_name",
    "Team ID": "team_id",
    "Total Clicks": "total_clicks",
    "Total Clicks without API": "total_clicks_wo_api",
    "Non-Jobs Clicks": "non_jobs_clicks",
    "View Candidate": "view_candidates",
    "Active Coddlers": "active_coddlers",
    "Montly Fee": "monthly_fee",
    "Number of Candidate Emails": "number_candidate_emails",
    "Number of Contact Emails": "number_contact_emails",
    "Salesperson": "salesperson",
    "Latest Contract End date": "latest_contract_end_date",
    "# of active harvester accounts": "active_harvester_accounts",
    "# of active users now": "active_users",
    "Total # of resumes": "total_resumes",
    "Total # of jobs": "total_jobs",
    "# of hires within the past year": "hires_in_past_year",
}

# --- fixed values: field texts that a CSV reader of the pandas family takes as missing ------
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: labels ------------------------------------------------------------------
SIZE_MICRO, SIZE_SMALL, SIZE_MEDIUM, SIZE_LARGE, SIZE_UNKNOWN = (
    "micro", "small", "medium", "large", "unknown")
TREND_NEW, TREND_GROWING, TREND_SHRINKING, TREND_FLAT = "new", "growing", "shrinking", "flat"
TREND_DECLINING = "Declining"  # tested by two rules, produced by none
CONTRACT_EXPIRED = "Expired"
CONTRACT_RENEGOTIATE = "Renegotiate (0-30 days)"
CONTRACT_RENEWAL = "Renewal window (31-90 days)"
CONTRACT_ACTIVE = "Active"
STAGE_ONBOARDING, STAGE_ESTABLISHED = "Onboarding", "Established"
RISK_HIGH, RISK_MEDIUM, RISK_LOW, RISK_MONITOR = "High", "Medium", "Low", "Monitor"
BANDS = ["Critical", "At Risk", "Watch", "Healthy"]
ACTION_URGENT = "Urgent outreach – disengaging"
ACTION_COMMERCIAL = "Commercial check-in"
ACTION_RENEWAL = "Renewal conversation"
ACTION_ADOPTION = "Adoption review"
ACTION_PROACTIVE = "Proactive value review"
ACTION_MONITOR = "Monitor"
AGE_BANDS = ((1, "Month 0–1"), (3, "Month 1–3"), (6, "Month 3–6"))
AGE_BAND_LATER = "6+ Months"

# --- fixed values: narrative sentences -----------------------------------------------------
SAY_ENGAGEMENT_LONG = "Engagement has declined for several consecutive months."
SAY_ENGAGEMENT_SHORT = "Engagement is trending down compared to previous months."
SAY_USERS = "Active user numbers have reduced over recent periods."
SAY_SHARP = "A significant drop in active users was recorded recently."
SAY_JOBS = "Job posting activity has decreased compared to earlier months."
SAY_PRICE_HIGH = "Cost per user is relatively high for the current licence base."
SAY_PRICE_LOW = "Account appears cost-efficient given current usage."

# --- fixed values: display texts -----------------------------------------------------------
FEE_UNKNOWN = "Unknown"
DAYS_UNKNOWN = "Unknown. Please check"
CURRENCY_BY_REGION = {"UK": "£"}
CURRENCY_OTHER = "$"


@dataclass(frozen=True)
class Rules:
    """Thresholds and point tables (defaults: the standard rule set)."""

    # points by streak length 1, 2, 3 ...; the last entry covers every longer streak
    engagement_points: tuple[int, ...] = (0, 10, 20, 40)
    user_points: tuple[int, ...] = (0, 5, 10, 20)
    jobs_points: tuple[int, ...] = (0, 5, 15, 30, 45)
    # worst monthly user change of the last three months at or below this: sharp decline
    sharp_decline_pct: float = -0.20
    sharp_decline_points: int = 10
    # score at or above the bound: band
    band_bounds: tuple[tuple[int, str], ...] = ((80, "Healthy"), (60, "Watch"), (40, "At Risk"))
    band_lowest: str = "Critical"
    # narrative
    long_engagement_streak: int = 4
    short_engagement_streak: int = 2
    fee_per_user_high: float = 100.0
    fee_per_user_low: float = 30.0
    # two-signal score
    engagement_delta_floor: float = -0.05
    engagement_delta_cap: float = 50.0
    user_change_points: tuple[tuple[float, int], ...] = ((-0.20, 25), (-0.10, 15), (-0.05, 5))
    # contract windows, days
    renegotiate_days: int = 30
    renewal_days: int = 90
    # onboarding limits differ between the risk rules and the overview
    risk_onboarding_months: int = 3
    overview_onboarding_months: int = 6
    days_per_month: int = 30
    # next actions
    urgent_below: int = 40
    value_review_range: tuple[int, int] = (50, 65)
    # serving
    at_risk_at_most: int = 40
    growth_above: int = 70
    paid_users_fee_above: float = 80.0


STANDARD = Rules()
