"""Grouped statistics: summaries, weighted medians, effect sizes, stability, seeded bootstraps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions import stats as S


def summary(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, median, quartiles, least and greatest of non-null values."""
    v = F.col(value)
    return values.where(v.isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"), F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi")
    )


def weighted_median(values: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """First value at which the running weight reaches half; without weight the plain median."""
    rows = values.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    w = Window.partitionBy(*group)
    run = rows.withColumn("total", F.sum(weight).over(w)).withColumn("acc", F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*group).agg(
        F.when(F.first("total") <= 0, F.percentile(value, 0.5)).otherwise(F.min(F.when(F.col("acc") >= F.col("total") / 2, F.col(value))).cast("double")).alias("weighted_median")
    )


def ranked(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Non-null values as v (double) with rn, their place from 0 in the group's order, and n, the group's size.

    Groups are sorted by Spark and may spill; no group is held as an array.
    """
    v = F.col(value).cast("double")
    w = Window.partitionBy(*group)
    return values.where(v.isNotNull()).withColumn("v", v).withColumn("rn", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count("*").over(w))


def at(index: Column) -> Column:
    """Aggregate over ranked rows: the value at a place, null outside the group."""
    return F.max(F.when(F.col("rn") == index, F.col("v")))


def bounds(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, least, greatest, nine quantiles p01..p99, outward p95, one-sided bounds, and the two-sided hard range with its side."""
    n, v = F.col("n"), F.col("v")
    shares = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    per = ranked(values, group, value).groupBy(*group).agg(
        F.max("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.percentile(v, F.array(*map(F.lit, shares))).alias("q"), at(S.outward_index(n, 0.95, True)).alias("p95_out"),
        at(S.bound_index(n, True)).alias("upper"), at(S.bound_index(n, False)).alias("lower"), at(S.bound_index(n, True, True)).alias("_hi"), at(S.bound_index(n, False, True)).alias("_lo"),
    )
    named = per.select("*", *(F.col("q")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(shares))).drop("q")
    lo, hi, sided = S.hard_range(F.col("least"), F.col("_lo"), F.col("_hi"), F.col("p25"), F.col("p75"))
    return named.withColumns({"hard_lo": lo, "hard_hi": hi, "sided": sided}).drop("_lo", "_hi")


def hard_bounds(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Outward p95, one-sided bounds and the two-sided hard range per group."""
    return bounds(values, group, value).select(*group, F.col("n").cast("int").alias("n"), "p95_out", "upper", "lower", "hard_lo", "hard_hi")


def caps(p95: Column, upper: Column) -> tuple[Column, Column]:
    """Cap and hard cap of runs: from p95 and the upper hard bound, at least 3 and cap + 2."""
    cap = F.greatest(F.lit(3), F.ceil(p95 - 1e-9))
    return cap, F.greatest(cap + 2, F.ceil(upper - 1e-9))


def run_cap(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """cap and hard_cap of runs per group."""
    cap, hard = caps(F.col("p95"), F.col("upper"))
    return bounds(values, group, value).select(*group, cap.alias("cap"), hard.alias("hard_cap"))


def cliffs_delta(values: DataFrame, group: str, value: str, one: str, other: str) -> DataFrame:
    """Cliff's delta of two groups by ranks: (above - below) / (n * m), without comparing pairs.

    Counts of distinct values are cut into ranges of values; each range adds up its own, and the sums of the
    ranges before it, one row a range, come from a small table. No task sees all values.
    """
    counts = values.where(F.col(value).isNotNull() & F.col(group).isin(one, other)).groupBy(value).agg(F.count_if(F.col(group) == one).alias("a"), F.count_if(F.col(group) == other).alias("b"))
    cut = runtime.materialize(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "ranges")
    parts = cut.groupBy("part").agg(F.sum("b").alias("size"))  # as many rows as shuffle partitions
    before = parts.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("b").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cut.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("below", F.col("inside") + F.col("before"))
    m = F.sum("b")
    return rows.agg(((2 * F.sum(F.col("a") * F.col("below")) + F.sum(F.col("a") * F.col("b")) - F.sum("a") * m) / F.nullif(F.sum("a") * m, F.lit(0))).alias("delta"))


def loao_direction(values: DataFrame, group: list[str], value: str, baseline: float | Column) -> DataFrame:
    """Whether the side of the baseline on which a group's median lies stays when any one value is dropped.

    Dropping a value moves the median between the order statistics next to the middle, so these decide. A
    baseline column is one of the group's keys or functionally dependent on them.
    """
    n = F.col("n")
    half = F.floor(n / 2)
    per = ranked(values, group, value).groupBy(*group).agg(
        F.max("n").alias("n"), at(half - 1).alias("x"), at(half).alias("y"), at(half + 1).alias("z"), F.max(F.lit(baseline) if not isinstance(baseline, Column) else baseline).alias("_base")
    )
    x, y, z, base = (F.col(c) for c in ("x", "y", "z", "_base"))
    odd = n % 2 == 1
    med = F.when(odd, y).otherwise((x + y) / 2)
    # n even: dropping gives one of the two middle values; n odd: the mean of two of the three around the middle.
    low, high = F.when(odd, (x + y) / 2).otherwise(x), F.when(odd, (y + z) / 2).otherwise(y)
    mid = F.when(odd, (x + z) / 2).otherwise(x)
    same = lambda m: (m > base) == (med > base)
    return per.select(*group, n.cast("int").alias("n"), med.alias("median"), F.when(n < 2, False).otherwise(same(low) & same(high) & same(mid)).alias("stable"))


def percentile_rank(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """values with rank_share: the share of the group's values that are not greater."""
    return values.where(F.col(value).isNotNull()).withColumn("rank_share", F.cume_dist().over(Window.partitionBy(*group).orderBy(value)))


def _grouped(values: DataFrame, group: list[str], fn: Callable[[pd.DataFrame], dict], out: str) -> DataFrame:
    fields = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in group)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in group}, **fn(pdf)}])

    return values.groupBy(*group).applyInPandas(run, f"{fields}, {out}")


def bootstrap_ci(values: DataFrame, group: list[str], value: str, order: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Median and 95 % interval of medians of seeded resamples, drawing as a Mersenne Twister would.

    Values are taken in ``order``; a group's values, one per article, fit one task.
    """

    def fn(pdf: pd.DataFrame) -> dict:
        import random
        import statistics

        import numpy as np

        v = pdf.sort_values(order)[value].tolist()
        rng = random.Random(seed)
        medians = [statistics.median([v[rng.randrange(len(v))] for _ in v]) for _ in range(n)]
        return {"median": float(statistics.median(v)), "ci_lo": float(np.quantile(medians, 0.025)), "ci_hi": float(np.quantile(medians, 0.975))}

    return _grouped(values.where(F.col(value).isNotNull()).select(*dict.fromkeys([*group, value, *order])), group, fn, "median double, ci_lo double, ci_hi double")


def weighted_bootstrap_ci(values: DataFrame, group: list[str], value: str, weight: str, order: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Weighted median and 95 % interval of weighted medians of seeded resamples of places; null values take no part.

    The weighted median is the first value at which the running weight reaches half; without weight the plain one.
    """

    def fn(pdf: pd.DataFrame) -> dict:
        import random
        import statistics

        import numpy as np

        pdf = pdf.sort_values(order)
        v, w = pdf[value].to_numpy(dtype=float), pdf[weight].to_numpy(dtype=float)

        def median(x: np.ndarray, y: np.ndarray) -> float:
            by = np.argsort(x, kind="stable")
            run = np.cumsum(y[by])
            return float(x[by][np.searchsorted(run, run[-1] / 2)]) if run[-1] > 0 else float(statistics.median(x))

        rng = random.Random(seed)
        medians = []
        for _ in range(n):
            at = np.array([rng.randrange(len(v)) for _ in v])
            medians.append(median(v[at], w[at]))
        return {"median": median(v, w), "ci_lo": float(np.quantile(medians, 0.025)), "ci_hi": float(np.quantile(medians, 0.975))}

    rows = values.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).select(*dict.fromkeys([*group, value, weight, *order]))
    return _grouped(rows, group, fn, "median double, ci_lo double, ci_hi double")


def direction_agreement(values: DataFrame, group: list[str], value: str, order: list[str], baseline: float, n: int = 1000, seed: int = 42) -> DataFrame:
    """Share of resamples whose median lies on the same side of the baseline as the group's; 0 on the baseline."""

    def fn(pdf: pd.DataFrame) -> dict:
        import random
        import statistics

        v = pdf.sort_values(order)[value].tolist()
        base = statistics.median(v) - baseline
        rng, same = random.Random(seed), 0
        for _ in range(n if base else 0):
            draw = statistics.median([v[rng.randrange(len(v))] for _ in v]) - baseline
            rng.randrange(1)  # the baseline is a sample of one, which is drawn as well
            same += (draw > 0) == (base > 0) and draw != 0
        return {"agreement": same / n}

    return _grouped(values.where(F.col(value).isNotNull()).select(*dict.fromkeys([*group, value, *order])), group, fn, "agreement double")
