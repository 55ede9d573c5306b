"""Bands, scores, rates, prices and clocks as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

#: Ranks and scores of statuses; a lower rank is worse.
STATUS_RANK = {"maintenance": 0, "unhealthy": 1, "warning": 2, "degraded": 3, "unknown": 4, "healthy": 5}
STATUS_SCORE = {"healthy": 100.0, "degraded": 75.0, "warning": 50.0, "unhealthy": 25.0, "maintenance": 0.0, "unknown": 0.0}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
FINDING_BASE = {"critical": 90.0, "high": 70.0, "medium": 45.0, "low": 20.0, "informational": 5.0}
CREDIT = {"pass": 1.0, "warn": 0.5, "fail": 0.0}


def lookup(values: dict, key: Column, default: object = None) -> Column:
    """A small literal table; NULL (or ``default``) for other keys."""
    found = F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def banded(c: Column, bands: Sequence[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """The first band whose bound the value reaches (``strict``: exceeds), highest bound first."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for bound, name in bands:
        out = out.when(c > bound if strict else c >= bound, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def risk_bucket(score: Column) -> Column:
    return banded(score, [(75, "critical"), (50, "high"), (25, "medium")], "low")


def threshold_level(value: Column, levels: Sequence[tuple[str, float]]) -> Column:
    """The highest level reached, levels in rising order; NULL below all."""
    out = F.lit(None).cast("string")
    for name, bound in levels:
        out = F.when(value >= bound, F.lit(name)).otherwise(out)
    return out


def utilization(total: Column, used: Column) -> Column:
    return F.try_divide(used.cast("double"), F.nullif(total, F.lit(0)))


def utilization_level(share: Column, warning: float, critical: float) -> Column:
    return F.when(share.isNull(), F.lit("unknown")).otherwise(banded(share, [(critical, "critical"), (warning, "warning")], "ok"))


def budget_status(spend: Column, amount: Column, warning: float, critical: float) -> Column:
    return banded(spend / amount, [(1.0, "exceeded"), (critical, "critical"), (warning, "warning")], "ok")


def forecast_spend(spend: Column, elapsed: Column) -> Column:
    return F.try_divide(spend.cast("double"), F.nullif(elapsed, F.lit(0.0)))


def rightsizing(share: Column, low: float, high: float) -> Column:
    return F.when(share.isNull(), "none").when(share <= low, "downsize").when(share >= high, "upsize").otherwise("none")


def lag_level(lag_seconds: Column, warning: float, critical: float) -> Column:
    """Replication lag: no reading is a warning, bounds included."""
    return F.when(lag_seconds.isNull(), "warning").otherwise(banded(lag_seconds, [(critical, "critical"), (warning, "warning")], "healthy"))


def risk_assessment(likelihood: Column, impact: Column) -> Column:
    """likelihood x impact of the 5 x 5 matrix, on 0 to 100."""
    return F.bround(likelihood * impact / 25.0 * 100.0, 2)


def finding_risk(severity: Column, detections: Column) -> Column:
    return F.bround(F.least(F.lit(99.0), lookup(FINDING_BASE, severity) + F.least(F.lit(9.0), F.greatest(F.lit(0), detections - 1) * 0.5)), 2)


def change_score(likelihood: Column, impact: Column, dimensions: Sequence[Column], top_likelihood: int = 5, top_impact: int = 5) -> Column:
    """The matrix score or the worst dimension's, whichever is higher."""
    worst = F.greatest(*dimensions) if len(dimensions) > 1 else dimensions[0]
    return F.greatest(likelihood * impact / float(top_likelihood * top_impact), worst / float(top_impact))


def change_risk_level(score: Column) -> Column:
    return banded(score, [(0.75, "critical"), (0.5, "high"), (0.25, "medium")], "low")


def composite_score(health: Column, availability: Column, sla: Column) -> Column:
    return health * 0.5 + availability * 0.3 + sla * 0.2


def percent_change(baseline: Column, current: Column) -> Column:
    """Against the baseline's size; from zero it is 0, 100 or -100."""
    return F.when(baseline == 0, F.when(current == 0, 0.0).when(current > 0, 100.0).otherwise(-100.0)).otherwise((current - baseline) / F.abs(baseline) * 100.0)


def regression_severity(percent: Column, critical: float) -> Column:
    if critical <= 0:
        return F.lit("critical")
    return banded(percent / critical, [(1.0, "critical"), (0.75, "high"), (0.5, "medium")], "low")


def rate(part: Column, whole: Column, empty: float | None = None, scale: float = 1.0) -> Column:
    """part / whole x scale; what an empty whole gives differs by use, so it is stated."""
    out = F.try_divide(part.cast("double"), whole.cast("double")) * scale
    return out if empty is None else F.coalesce(out, F.lit(empty))


def churn_rate(churned: Column, active: Column) -> Column:
    """NULL without active customers; more churned than active is an error."""
    return F.when(churned > active, F.raise_error(F.lit("churned exceeds active"))).otherwise(rate(churned, active))


def project_value(current: Column, growth_percent: Column, periods: Column) -> Column:
    return current * F.pow(1.0 + growth_percent / 100.0, periods)


def periods_until(current: Column, growth_percent: Column, threshold: Column) -> Column:
    """0 if already there, NULL if it never grows there."""
    return F.when(current >= threshold, 0.0).when((growth_percent <= 0) | (current <= 0), F.lit(None)).otherwise(F.ln(threshold / current) / F.ln(1.0 + growth_percent / 100.0))


def growth_per_day(previous: Column, current: Column, days: Column) -> Column:
    return (current - previous) / days


def forecast_value(current: Column, per_day: Column, days: Column) -> Column:
    return F.greatest(F.lit(0.0), current + per_day * days)


def tiered_price(quantity: Column, tiers: Sequence[tuple[float, float]]) -> Column:
    """Graduated tiers (size, unit price); what is left over costs the last tier's price."""
    total, below = F.lit(0.0), 0.0
    for size, price in tiers:
        total = total + F.greatest(F.lit(0.0), F.least(quantity - below, F.lit(float(size)))) * price
        below += size
    return total + F.greatest(F.lit(0.0), quantity - below) * (tiers[-1][1] if tiers else 0.0)


def monthly_recurring(amount: Column, model: Column) -> Column:
    return F.when(model == "monthly", amount).when(model == "quarterly", amount / 3).when(model == "annual", amount / 12).otherwise(0.0)


def percentage_discount(subtotal: Column, percent: Column) -> Column:
    return subtotal * (1 - percent / 100.0)


def fixed_discount(subtotal: Column, amount: Column) -> Column:
    return F.greatest(F.lit(0.0), subtotal - amount)


def request_allowed(used: Column, requested: Column, limit: Column, kind: Column, burst: Column) -> Column:
    """A soft limit always allows; a hard one up to limit and burst."""
    return F.when(kind == "soft", True).otherwise(used + requested <= limit + F.coalesce(burst, F.lit(0)))


def semantic_version(label: Column) -> Column:
    """MAJOR.MINOR.PATCH (an optional v before, anything after) as an array that compares; else an error."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)"
    parts = F.array(*(F.regexp_extract(label, pattern, k).cast("int") for k in (1, 2, 3)))
    return F.when(label.rlike(pattern), parts).otherwise(F.raise_error(F.concat(F.lit("not a semantic version: "), label)).cast("array<int>"))


def backoff_seconds(attempt: Column, base: float, cap: float, multiplier: float = 2.0) -> Column:
    """Without jitter: base x multiplier^(attempt - 1), capped."""
    return F.least(F.lit(base) * F.pow(F.lit(multiplier), attempt - 1), F.lit(cap))


def elapsed_seconds(started: Column, now: Column, paused_total: Column, paused_at: Column, met_at: Column, breached_at: Column) -> Column:
    """A clock's running seconds without its pauses; 0 before the start."""
    end = F.coalesce(met_at, breached_at, now)
    paused = paused_total + F.coalesce(seconds(end) - seconds(paused_at), F.lit(0.0))
    return F.when(started.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), seconds(end) - seconds(started) - paused))


def breached(due: Column, now: Column, paused_at: Column, met_at: Column, breached_at: Column) -> Column:
    return F.when(met_at.isNotNull() | breached_at.isNotNull(), breached_at.isNotNull()).when(due.isNull() | paused_at.isNotNull(), False).otherwise(now >= due)


def should_warn(started: Column, due: Column, now: Column, percent: float, met_at: Column, breached_at: Column) -> Column:
    at = seconds(started) + (seconds(due) - seconds(started)) * (percent / 100.0)
    return F.when(met_at.isNotNull() | breached_at.isNotNull(), False).otherwise(F.coalesce(seconds(now) >= at, F.lit(False)))


def seconds(moment: Column) -> Column:
    """Seconds since 1970 as a double, of a timestamp in UTC (with or without zone)."""
    return F.unix_micros(moment.cast("timestamp")) / 1e6


def sla_status(actual: Column, target: Column, margin: float = 1.0) -> Column:
    return F.when(actual >= target, "compliant").when(actual >= target - margin, "at_risk").otherwise("violated")


def slo_status(budget_left: Column) -> Column:
    return F.when(budget_left <= 0, "violated").when(budget_left <= 20, "at_risk").otherwise("compliant")


def z_test(n1: Column, k1: Column, n2: Column, k2: Column) -> Column:
    """Pooled two-proportion z; 0 for fewer than two trials in an arm or no variance."""
    pooled = (k1 + k2) / (n1 + n2)
    spread = F.sqrt(pooled * (1 - pooled) * (1.0 / n1 + 1.0 / n2))
    return F.when((n1 < 2) | (n2 < 2) | (spread == 0), 0.0).otherwise((k2 / n2 - k1 / n1) / spread)


#: The published rational approximation of the normal tail, off by 7.5e-8 at most.
TAIL_STEP, TAIL = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, by a rational approximation (Spark has no erf)."""
    t = 1 / (1 + TAIL_STEP * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def precedence(earlier: Column, later: Column, same_clock: Column) -> Column:
    """Which of two moments came first, within 2 s on one clock and 30 s across clocks."""
    gap = seconds(later) - seconds(earlier)
    tolerance = F.when(same_clock, 2.0).otherwise(30.0)
    return F.when(F.abs(gap) <= tolerance, "indeterminate").when(gap > 0, "precedes").otherwise("follows")


def resolve_sync(strategy: str, client_at: Column, server_at: Column) -> Column:
    """Who wins a conflict; equal times go to the server, ``manual`` stays open."""
    fixed = {"client_wins": "client", "server_wins": "server", "manual": "unresolved"}
    return F.lit(fixed[strategy]) if strategy in fixed else F.when(client_at > server_at, "client").otherwise("server")
