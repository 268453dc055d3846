"""Gates and reports: metric rows, slices, thresholds, statuses, claims, feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from . import stats
from .distributions import js_distance, js_term


def metric_rows(records: DataFrame, keys: list[str], metrics: Sequence[str]) -> DataFrame:
    """keys, metric, value: records in long form; null values are left out, not zero."""
    cast = records.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics))
    return cast.unpivot(keys, list(metrics), "metric", "value").where("value is not null")


def slices(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slice: the register and length slices of each article, and its era where records have published_at."""
    register = T.register_of(*(F.col(c) for c in ("desu_masu", "da_dearu", "jotai_verb", "jotai_adj")))
    both = F.array(F.concat(F.lit("register:"), register), F.concat(F.lit("length:"), T.length_stratum_of(F.col("n_chars"))))
    if "published_at" in records.columns:
        both = F.array_compact(F.array_append(both, F.concat(F.lit("era:"), T.era_of(F.col("published_at")))))
    return records.select(*keys, F.explode(both).alias("slice")).distinct()


def warn_ranges(records: DataFrame, group: list[str], metric: str, floor: float, ratio: bool = False) -> DataFrame:
    """Warn band, median and the greater of IQR and ``floor`` around it, and hard range; ratios end at 1."""
    half = F.greatest(F.col("p75") - F.col("p25"), F.lit(floor))
    top = lambda c: F.least(c, F.lit(1.0)) if ratio else c
    per = stats.bounds(records, group, metric)
    return per.select(*group, F.greatest(F.col("p50") - half, F.lit(0.0)).alias("warn_lo"), top(F.col("p50") + half).alias("warn_hi"), F.col("hard_lo"), top(F.col("hard_hi")).alias("hard_hi"))


def range_gate(records: DataFrame, ranges: DataFrame, group: list[str], metric: str) -> DataFrame:
    """records with status against their group's ranges; null where the metric is unavailable."""
    return records.join(ranges, group).withColumn("status", S.range_status(F.col(metric), *(F.col(c) for c in ("warn_lo", "warn_hi", "hard_lo", "hard_hi"))))


def gate_summary(rows: DataFrame, group: list[str]) -> DataFrame:
    """Counts by status and the worst one."""
    count = lambda x: F.count_if(F.col("status") == x)
    return rows.groupBy(*group).agg(count("pass").alias("passed"), count("warn").alias("warned"), count("fail").alias("failed"), S.worst(F.col("status")).alias("worst"))


def channel_status(rows: DataFrame, center: DataFrame, reference: DataFrame, group: list[str], article: list[str], severity: str = "fail") -> DataFrame:
    """group, article, distance, status of distributions against a calibrated channel; unbuilt ones are skipped."""
    d = rows.join(center.select(*group, "key", "mean"), [*group, "key"]).groupBy(*group, *article).agg(F.round(js_distance(js_term(F.col("p"), F.col("mean"))), 9).alias("distance"))
    j = d.join(reference.where("status = 'built'").select(*group, "warn", "fail"), group, "left")
    status = F.when(F.col("warn").isNull(), "skipped").when(F.col("distance") <= F.round("warn", 9), "pass").when(F.col("distance") <= F.round("fail", 9), "warn").otherwise("fail")
    return j.select(*group, *article, "distance", S.capped(status, F.lit(severity)).alias("status"))


def top_deviations(rows: DataFrame, center: DataFrame, group: list[str], article: list[str], k: int = 5) -> DataFrame:
    """The k keys that deviate most from the centroid, ties by key."""
    j = rows.join(center.select(*group, "key", "mean"), [*group, "key"]).withColumn("delta", F.col("p") - F.col("mean"))
    w = Window.partitionBy(*group, *article).orderBy(F.desc(F.round(F.abs("delta"), 9)), "key")
    return j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(*group, *article, "key", "delta")


def claim_candidates(records: DataFrame, group: list[str], metric: str, baseline: float) -> DataFrame:
    """Direction of each group's median against a baseline and the articles that support it; none on the baseline."""
    v = F.col(metric)
    per = records.where(v.isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.percentile(v, 0.5).alias("median"), F.count_if(v > baseline).alias("above"), F.count_if(v < baseline).alias("below"))
    up = F.col("median") > baseline
    return per.where(F.col("median") != baseline).select(*group, "n", "median", F.when(up, "above").otherwise("below").alias("direction"), F.when(up, F.col("above")).otherwise(F.col("below")).alias("support"))


def claim_drift(claims: DataFrame, aggregate: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """claims(metric, value, lo, hi) with kind of drift against aggregate(metric, built, median, lo, hi); null if none."""
    a = aggregate.select("metric", "built", F.col("median").alias("now"), F.col("lo").alias("now_lo"), F.col("hi").alias("now_hi"))
    j = claims.join(a, "metric", "left")
    inside = F.col("now").between(F.col("lo") - tolerance, F.col("hi") + tolerance) | ((F.col("now_lo") <= F.col("hi") + tolerance) & (F.col("now_hi") >= F.col("lo") - tolerance))
    return j.withColumn("kind", F.when(F.col("built").isNull(), "metric_not_in_schema").when(~F.col("built"), "not_evaluable").when(~inside, "value_drift"))


def feedback_deltas(pairs: DataFrame, records: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """author_id, a, b, metric, delta from version a to version b of pairs, four digits; metrics null on a side are left out."""
    long = metric_rows(records, ["article_id"], metrics)
    x = long.select(F.col("article_id").alias("a"), "metric", F.col("value").alias("x"))
    y = long.select(F.col("article_id").alias("b"), "metric", F.col("value").alias("y"))
    return pairs.join(x, "a").join(y, ["b", "metric"]).select("author_id", "a", "b", "metric", F.round(F.col("y") - F.col("x"), 4).alias("delta"))


def feedback_report(deltas: DataFrame, least: int = 3, agreement: float = 0.7) -> DataFrame:
    """metric, n, median_delta (upper median), agreement of metrics that moved often enough in one direction."""
    moved = stats.ranked(deltas.where("abs(delta) > 1e-6"), ["metric"], "delta")
    per = moved.groupBy("metric").agg(F.max("n").alias("n"), stats.at(F.floor(F.col("n") / 2)).alias("median_delta"), F.count_if(F.col("delta") > 0).alias("up"))
    share = F.greatest("up", F.col("n") - F.col("up")) / F.col("n")
    return per.where((F.col("n") >= least) & (share >= agreement)).select("metric", "n", "median_delta", share.alias("agreement"))


def regression(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Golden texts whose status differs from what is expected: id, expected, got (null if not evaluated)."""
    j = expected.join(results.select("id", F.col("status").alias("got")), "id", "left")
    return j.where(~F.col("expected").eqNullSafe(F.col("got"))).select("id", "expected", "got")
