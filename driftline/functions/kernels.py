"""Arithmetic kernels as Column expressions. Missing is null; rounding is half up, as SQL's."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SATURATION = 2.5
CHANGE_FLOOR = 8.0
RATE_FLOOR = 0.05


def rounded(x: Column, digits: int) -> Column:
    """Scaled, rounded to a whole number, scaled back, as SQL rounds doubles. F.round goes by the decimals that a double
    prints, so it takes another neighbour where the product comes to lie on a half or leaves it."""
    return F.round(x * 10.0**digits) / 10.0**digits


def saturating_strength(net: Column, k: float = SATURATION) -> Column:
    return F.round(100 * (1 - F.exp(-F.abs(net) / k)), 4)


def independence_gate(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(1 - F.exp(-n / 2.5))


def confidence(n: Column, diversity: Column, primary: Column, quality: Column) -> Column:
    mixed = 0.45 + 0.55 * (0.30 * diversity + 0.35 * primary + 0.35 * quality / 100)
    value = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * independence_gate(n) * mixed)), 4)
    return F.when(n == 0, F.lit(0.0)).otherwise(value)


def bounded_change(observed: Column, baseline: Column, floor: float = CHANGE_FLOOR) -> Column:
    """Change against the own baseline, -100..100. Adding zero turns a negative zero into zero."""
    return F.round(100 * F.tanh((observed - baseline) / F.greatest(baseline, F.lit(floor))), 4) + F.lit(0.0)


def saturating_count(n: Column) -> Column:
    return F.round(100 * (1 - F.exp(-n / 4.0)), 4)


def novelty(mainstream: Column, reaction: Column) -> Column:
    return F.round(100 * F.greatest(F.lit(0.0), 1 - (0.65 * mainstream + F.when(reaction, 0.35).otherwise(0.0))), 4)


def activation_weight(acceleration: Column, strength: Column) -> Column:
    return F.round(F.abs(acceleration) / 100 * strength / 100, 6)


def component_value(x: Column) -> Column:
    """Clamped to 0..100; null stays null, which greatest and least would pass over."""
    return F.when(x.isNotNull(), F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)), 4))


def contribution(magnitude: Column, conf: Column, quality: Column) -> Column:
    return magnitude * conf * quality / 100


def direction(net: Column, band: float = 0.05) -> Column:
    return F.when(net > band, "POSITIVE").when(net < -band, "NEGATIVE").otherwise("NEUTRAL")


def finding_confidence(n: Column, quality: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.25 * F.least(n, F.lit(4)) + 0.3 * quality / 100 * F.when(n > 1, 1.0).otherwise(0.5)), 4)


def exposure_score(weight: Column) -> Column:
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * weight)), 2)


def event_confidence(best: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), F.round(best + F.least(F.lit(0.1), 0.02 * (n - 1)), 4))


def entropy_term(share: Column) -> Column:
    """One class's part of the Shannon entropy; sum and divide by ln 9."""
    return F.when(share > 0, -share * F.log(share)).otherwise(0.0)


def normalised_entropy(total: Column, classes: int = 9) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / math.log(classes)))


def contradiction_ratio(supporting: Column, contradicting: Column) -> Column:
    both = supporting + contradicting
    return F.when(both > 0, F.round(contradicting / both, 4)).otherwise(0.0)
