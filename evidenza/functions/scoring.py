"""Numeric functions of ranking, trust and feedback as column expressions, all in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trust, weight and authority by source, and the ranks of visibility.
INITIAL_TRUST = {"import": 0.9, "manual": 0.9, "vault": 0.8, "hindsight": 0.7, "conversation": 0.6, "dream": 0.6}
SOURCE_WEIGHT = {"conversation": 1.3, "manual": 1.3, "import": 1.3, "hindsight": 1.3, "dream": 1.1, "cron": 1.1, "sensor": 1.1, "email": 1.1, "vault": 0.7}
AUTHORITY = {"manual": 1.0, "conversation": 0.9, "import": 0.8, "vault": 0.85, "hindsight": 0.7, "dream": 0.55, "cron": 0.6, "sensor": 0.65, "email": 0.7}
CALIBRATION = {"vault": 0.15, "import": 0.05, "manual": 0.10, "conversation": 0.0, "hindsight": -0.05}
SIGNALS = {
    "explicit_useful": (1, 1.0, "explicit"), "explicit_wrong": (-1, 1.0, "explicit"), "explicit_correction": (-1, 0.9, "explicit"), "tool_contradiction": (-1, 0.85, "inferred"),
    "tool_supported": (1, 0.6, "inferred"), "counterfactual_support": (1, 0.4, "inferred"), "counterfactual_harm": (-1, 0.5, "inferred"), "support_assessment": (1, 0.2, "inferred"),
}
VISIBILITY = {"private": 0, "shared": 1, "fleet": 2}


def lookup(values: dict, c: Column, otherwise: object) -> Column:
    """The value of a fixed table, as a chain of comparisons that stays in generated code."""
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def source_name(c: Column) -> Column:
    """Sources in one spelling; null and blank become null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def valid_trust(c: Column) -> Column:
    """Null outside 0 to 1."""
    return F.when((c >= 0) & (c <= 1) & ~F.isnan(c), c)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, unlike lengths and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = dot(a, a) * dot(b, b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / F.sqrt(norm)).otherwise(F.lit(0.0))


def decayed(value: Column, age: Column, half_life: float) -> Column:
    """value * 0.5 ** (age / half_life); 0 for values up to 0."""
    return F.when(value > 0, value * F.pow(F.lit(0.5), age / half_life)).otherwise(0.0)


def decayed_trust(value: Column, age_days: Column, half_life: float = 30.0, floor: float = 0.3) -> Column:
    """Decay that never falls below the floor, and lifts what is below it to it."""
    return F.greatest(decayed(value, age_days, half_life), F.lit(floor))


def or_half(c: Column) -> Column:
    """A missing value, and 0, count as 0.5."""
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.5))


def calibrated_trust(source: Column, confidence: Column, verified: Column, age_days: Column) -> Column:
    """The confidence with steps for the source, verification and age since the last update; at most 0.95, two places."""
    t = or_half(confidence) + lookup(CALIBRATION, source, 0.0) + F.when(verified, 0.1).otherwise(0.0)
    t = t + F.when(age_days < 1, 0.05).when(age_days < 7, 0.03).when(age_days < 30, 0.01).otherwise(0.0)
    return F.bround(F.least(t, F.lit(0.95)), 2)


def age_days(at: Column, now: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at)) / F.lit(86_400_000_000.0)
