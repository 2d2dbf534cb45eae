"""Tiers, classifier scores, panel measures and household economics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewise import config as C


def tier(score, below: str | None = None) -> Column:
    """high, candidate, or `below` (null: to be dropped)."""
    return F.when(score >= C.HIGH, "high").when(score >= C.CANDIDATE, "candidate").otherwise(F.lit(below))


def saturation_tier(n_buildings, kwp) -> Column:
    (n2, k2), (n1, k1) = C.SATURATED, C.GROWING
    return F.when((n_buildings >= n2) | (kwp >= k2), "saturated").when((n_buildings >= n1) | (kwp >= k1), "growing").otherwise("early")


def dot(vector, weights) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(vector, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def platt(z, a, b) -> Column:
    return sigmoid(a * z + b)


def linear_score(vector, weights, intercept, a=None, b=None) -> Column:
    """Probability by a linear head; calibrated where a and b are given, raw where either is null."""
    z = dot(vector, weights) + intercept
    return sigmoid(z) if a is None or b is None else F.coalesce(platt(z, a, b), sigmoid(z))


def l2_normalised(vector) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def cosine(a, b) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def combined_confidence(clip, color) -> Column:
    return F.lit(0.6) * clip + F.lit(0.4) * color


def looks_like_panel(r, g, b) -> Column:
    """Whether mean colours lie within the gates on brightness and blue bias."""
    bright = (r + g + b) / 3
    return (bright > C.PANEL_BRIGHTNESS[0]) & (bright < C.PANEL_BRIGHTNESS[1]) & (b - r > C.PANEL_BLUE[0]) & (b - r < C.PANEL_BLUE[1])


def panel_color_score(r, g, b) -> Column:
    """1 for the ideal panel (brightness 70, blue bias 8), less the further off, 0 at least."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.5) * F.abs((r + g + b) / 3 - 70) / 60 - F.lit(0.5) * F.abs(b - r - 8) / 30)


def panel_kwp(area_m2) -> Column:
    return area_m2 * C.KWP_PER_M2


def composite(nir, swir, lst, nightlight) -> Column:
    """Weighted z-scores; a missing one counts as 0."""
    w = C.WEIGHTS
    return sum((F.coalesce(z, F.lit(0.0)) * F.lit(w[k]) for k, z in (("nir", nir), ("swir", swir), ("lst", lst), ("nightlight", nightlight))), F.lit(0.0))


def composite_band(x) -> Column:
    return F.when(x >= 1, "strong").when(x >= 0.5, "above average").when(x > -0.5, "near baseline").when(x > -1, "below baseline").when(x <= -1, "well below baseline").otherwise("no signal")


def shift_verdict(distance, floor) -> Column:
    """How far a region's embeddings have moved from the reference, against what two samples of the reference differ by."""
    return F.when(distance <= floor + 0.005, "within-envelope").when(distance > floor + 0.030, "severe-OOD").otherwise("moderate-shift")


def roof_economics(area_m2, lat, rate, cost_per_kwp=55_000.0, base_yield=1350.0, monthly_kwh=None) -> dict[str, Column]:
    """usable_m2, kwp, annual_kwh, annual_savings, cost, payback_years (null: never), offset (where monthly_kwh is given)."""
    usable = area_m2 * 0.8
    kwp = usable * C.KWP_PER_M2
    kwh = kwp * F.lit(base_yield) * (F.lit(1.0) + (F.lit(14.65) - lat) * 0.015)
    savings, cost = kwh * rate, kwp * F.lit(cost_per_kwp)
    out = {"usable_m2": usable, "kwp": kwp, "annual_kwh": kwh, "annual_savings": savings, "cost": cost, "payback_years": F.when(savings > 0, cost / savings)}
    if monthly_kwh is not None:
        out["offset"] = F.when(monthly_kwh > 0, F.least(F.lit(1.0), kwh / (monthly_kwh * 12)))
    return out


def lifetime_value(annual_savings, cost, years: int = 25, fade: float = 0.005) -> Column:
    """Savings over the years, fading by a constant share, less the cost; not discounted."""
    total = F.aggregate(F.sequence(F.lit(0), F.lit(years - 1)), F.lit(0.0), lambda s, y: s + annual_savings * F.pow(F.lit(1 - fade), y))
    return total - cost


def roof_score(area_m2, lat, aspect) -> Column:
    """0 to 100: half area (on a log scale), three tenths irradiance, two tenths shape."""
    area = F.least(F.lit(100.0), F.lit(30.0) + F.lit(35.0) * F.log10(F.greatest(F.lit(20.0), area_m2) / 50))
    sun = F.lit(70.0) + (F.lit(14.65) - lat) * 1.5
    shape = F.greatest(F.lit(40.0), F.lit(90.0) - F.greatest(F.lit(0.0), aspect - 3) * 5)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.lit(0.5) * area + F.lit(0.3) * sun + F.lit(0.2) * shape + 0.5)))


def score_band(x) -> Column:
    return F.when(x >= 80, "excellent").when(x >= 65, "good").when(x >= 50, "fair").when(x >= 35, "limited").otherwise("poor fit")


def aspect_ratio(width_m, height_m) -> Column:
    return F.greatest(width_m, height_m) / F.greatest(F.lit(0.1), F.least(width_m, height_m))


def roof_verdict(has_panels, area_m2, usable_m2, inside, saturation) -> Column:
    """First rule that holds."""
    return (
        F.when(has_panels, "already-has").when(area_m2 > 500, "commercial").when(usable_m2 < 25, "too-small").when(~inside, "outside-franchise")
        .when(saturation == "saturated", "saturated").when(saturation == "growing", "growing").otherwise("early")
    )


def hsv(r, g, b) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value of colours in 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, 0.0).when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return hue, F.when(top > 0, d / top).otherwise(0.0), top


def size_word(kwp: Column) -> Column:
    return F.when(kwp >= 500, "utility").when(kwp >= 100, "large").when(kwp >= 30, "medium").otherwise("small")
