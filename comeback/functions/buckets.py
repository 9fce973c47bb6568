"""Label ladders: numeric value to the name of the step it falls on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from comeback.config import Settings

# Report labels.
AGENT_SPEED_LABELS = (
    "1_Within 2 Hours",
    "2_Within 24 Hours",
    "3_After 24 Hours",
    "4_Never Used Agent",
)
VALUE_LABELS = ("1_Under 1h", "2_Under 24h", "3_Under 72h", "4_After 72h", "5_Never")
PERIOD_LABELS = (
    "🌅 Morning (6-12)",
    "☀️ Afternoon (12-18)",
    "🌆 Evening (18-24)",
    "🌙 Night (0-6)",
)
UNKNOWN = "Unknown"
RISK_LABELS = ("🔴 High Risk", "🟡 Medium Risk", "🟢 Likely Success")


def ladder(conditions: Sequence[Column], labels: Sequence[str]) -> Column:
    """First matching condition wins; the last label is the fallback."""
    chain = F.when(conditions[0], labels[0])
    for condition, label in zip(conditions[1:], labels[1:]):
        chain = chain.when(condition, label)
    return chain.otherwise(labels[-1])


def agent_speed(hours: Column, settings: Settings) -> Column:
    fast, same_day = settings.agent_hours
    within, day, later, never = AGENT_SPEED_LABELS
    return F.when(hours.isNull(), never).otherwise(
        ladder([hours <= fast, hours <= same_day], [within, day, later])
    )


def time_to_value(hours: Column, settings: Settings) -> Column:
    steps = [hours <= limit for limit in settings.value_hours]
    return F.when(hours.isNull(), VALUE_LABELS[-1]).otherwise(ladder(steps, VALUE_LABELS[:-1]))


def signup_period(hour: Column) -> Column:
    steps = [hour.between(first, first + 5) for first in (6, 12, 18)]
    return F.when(hour.isNull(), UNKNOWN).otherwise(ladder(steps, PERIOD_LABELS))


def risk_level(probability: Column, settings: Settings) -> Column:
    return ladder([probability < cut for cut in settings.risk_cutoffs], RISK_LABELS)
