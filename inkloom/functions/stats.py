"""Statistical expressions: order statistics by their place among n sorted values, bounds, statuses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The calibration policy.
LARGE_N, MIN_N, TUKEY_K, ARTICLE_ALPHA = 100, 10, 1.5, 0.01
FAIL_CAPABLE_CHECKS = 29
ALPHA = ARTICLE_ALPHA / FAIL_CAPABLE_CHECKS


def outward_index(n: Column, q: float, upper: bool) -> Column:
    """Place (from 0) of the order statistic at q, rounded away from the middle."""
    at = F.lit(q) * (n - 1)
    return F.greatest(F.lit(0), F.least(F.ceil(at - 1e-12) if upper else F.floor(at + 1e-12), n - 1))


def bound_index(n: Column, upper: bool, two_sided: bool = False) -> Column:
    """Place of the hard bound: the extreme below LARGE_N values, from there on an outward quantile."""
    alpha = ALPHA / 2 if two_sided else ALPHA
    return F.when(n < LARGE_N, n - 1 if upper else F.lit(0)).otherwise(outward_index(n, 1 - alpha if upper else alpha, upper))


def hard_range(least: Column, lower: Column, upper: Column, q1: Column, q3: Column) -> tuple[Column, Column, Column]:
    """(lo, hi, sided) of the two-sided range: extreme bounds widened to Tukey's fences, cut at 0 for values never negative."""
    lo = F.least(lower, q1 - TUKEY_K * (q3 - q1))
    lo = F.when(least >= 0, F.greatest(lo, F.lit(0.0))).otherwise(lo)
    sided = F.when((lo <= 0) & (least >= 0), "upper_only").otherwise("two_sided")
    return lo, F.greatest(upper, q3 + TUKEY_K * (q3 - q1)), sided


def band_notes(warn_lo: Column, warn_hi: Column, hard_lo: Column, hard_hi: Column, sided: Column) -> Column:
    """Array of what makes a band degenerate; without a warn band only that it is missing."""
    notes = F.array_compact(
        F.array(
            F.when(warn_hi - warn_lo <= 0, "warn_band_zero_width"),
            F.when(sided == "upper_only", "lower_bound_degenerate_zero(one_sided_upper)"),
            F.when(hard_hi - hard_lo <= 0, "hard_band_zero_width"),
        )
    )
    return F.when(warn_lo.isNull() | warn_hi.isNull(), F.array(F.lit("warn_band_missing"))).otherwise(notes)


def max_exceed_count(n: int, alpha: float) -> int:
    """How many of n values can lie strictly above the outward quantile at 1 - alpha."""
    if n < LARGE_N:
        return 0
    return max(0, n - 1 - min(math.ceil((1 - alpha) * (n - 1) - 1e-12), n - 1))


def range_status(value: Column, warn_lo: Column, warn_hi: Column, hard_lo: Column, hard_hi: Column) -> Column:
    """pass within the warn band; warn within it widened by half its width, or within the hard range; else fail."""
    half = (warn_hi - warn_lo) * 0.5
    wide = value.between(warn_lo - half, warn_hi + half) | value.between(hard_lo, hard_hi)
    return F.when(value.isNull() | warn_lo.isNull(), F.lit(None)).when(value.between(warn_lo, warn_hi), "pass").when(wide, "warn").otherwise("fail")


def capped(status: Column, severity: Column) -> Column:
    return F.when((status == "fail") & (severity == "warn"), "warn").otherwise(status)


def worst(status: Column) -> Column:
    """Aggregate: the worst status; without any, skipped."""
    rank = F.max(F.when(status == "fail", 2).when(status == "warn", 1).when(status == "pass", 0))
    return F.when(rank == 2, "fail").when(rank == 1, "warn").when(rank == 0, "pass").otherwise("skipped")
