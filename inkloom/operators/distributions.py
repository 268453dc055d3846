"""Distributions in long form (keys, article, key, p): centroids, projection, distances, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from . import stats

OTHER = "OTHER"
# Limits of notes on a channel.
OUTLIER_RATIO, OTHER_MOST, NEAR_MARGIN = 2.0, 0.5, 5


def centroid(rows: DataFrame, group: list[str], article: str) -> DataFrame:
    """group, key, mean, n: mean share over the group's articles, absent keys being zero."""
    n = rows.groupBy(*group).agg(F.count_distinct(article).alias("n"))
    return rows.groupBy(*group, "key").agg(F.sum("p").alias("total")).join(n, group).select(*group, "key", (F.col("total") / F.col("n")).alias("mean"), "n")


def top_keys(center: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k keys of greatest mean share, ties by key."""
    w = Window.partitionBy(*group).orderBy(F.desc("mean"), "key")
    return center.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def projected(rows: DataFrame, keys: DataFrame, group: list[str], article: list[str]) -> DataFrame:
    """Shares on the group's keys; all other mass goes to OTHER, so that shares still sum to 1."""
    known = keys.select(*group, F.col("key"), F.lit(True).alias("kept"))
    j = rows.join(known, [*group, "key"], "left")
    return j.groupBy(*group, *article, F.when(F.col("kept"), F.col("key")).otherwise(OTHER).alias("key")).agg(F.sum("p").alias("p"))


def dense(rows: DataFrame, group: list[str], article: list[str]) -> DataFrame:
    """The full grid of a group's articles and keys, absent shares being zero."""
    grid = rows.select(*group, *article).distinct().join(rows.select(*group, "key").distinct(), group)
    return grid.join(rows, [*group, *article, "key"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def js_term(p: Column, q: Column) -> Column:
    """A key's term of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    return part(p) + part(q)


def js_distance(terms: Column) -> Column:
    """Aggregate: square root of the divergence."""
    return F.sqrt(F.greatest(F.lit(0.0), F.sum(terms)))


def loao_distances(rows: DataFrame, group: list[str], article: list[str]) -> DataFrame:
    """group, article, distance: of each article to the centroid of the group's others, in closed form."""
    grid = dense(rows, group, article)
    w = Window.partitionBy(*group, "key")
    n = F.count("*").over(w)
    rest = (F.sum("p").over(w) - F.col("p")) / (n - 1)
    with_rest = grid.withColumn("n", n).withColumn("rest", rest).where("n > 1")
    return with_rest.groupBy(*group, *article).agg(js_distance(js_term(F.col("p"), F.greatest(F.col("rest"), F.lit(0.0)))).alias("distance"))


def calibrate(distances: DataFrame, group: list[str]) -> DataFrame:
    """Thresholds of a distribution channel by leave-one-out distances; fewer than MIN_N articles are skipped."""
    built = F.col("n") >= S.MIN_N
    return stats.bounds(distances, group, "distance").select(
        *group, "n", F.when(built, "built").otherwise("skipped").alias("status"), F.when(built, F.col("p50")).alias("p50"), F.when(built, F.col("p90")).alias("warn"),
        F.when(built, F.greatest("upper", "p90")).alias("fail"),
    )


def channel_notes(n: Column, p50: Column, fail: Column, other: Column, keys: Column, top_k: Column) -> Column:
    """Array of what makes a distribution channel doubtful: outliers set its limit, keys too few or too many, few articles."""
    return F.array_compact(
        F.array(
            F.when((p50 > 0) & (fail / p50 > OUTLIER_RATIO), "fail_threshold_outlier_dominated"),
            F.when(other > OTHER_MOST, "top_k_too_small"),
            F.when(keys < top_k, "top_k_vacuous"),
            F.when(n < S.MIN_N + NEAR_MARGIN, "near_min_calibration_n"),
        )
    )


def calibrate_scalar(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Quantiles, warn band p10 to p90 and hard range of scalars; null values take no part, fewer than MIN_N are skipped."""
    built = F.col("n") >= S.MIN_N
    known = {"warn_lo": "p10", "warn_hi": "p90", "median": "p50", "fail_lo": "hard_lo", "fail_hi": "hard_hi", **{f"q{k}": f"p{k}" for k in ("01", "05", "25", "75", "95", "99")}, "sided": "sided"}
    return stats.bounds(values, group, value).select(*group, "n", F.when(built, "built").otherwise("skipped").alias("status"), *(F.when(built, F.col(c)).alias(k) for k, c in known.items()))


def shrunk(local: DataFrame, whole: DataFrame, group: list[str], slice_: str, pseudo: int = 10) -> DataFrame:
    """Slice centroids drawn to the group's: (local * k + whole * pseudo) / (k + pseudo), six digits."""
    keys = [*group, slice_]
    sizes = local.select(*keys, F.col("n").alias("k")).distinct()
    grid = sizes.join(whole.select(*group, "key", F.col("mean").alias("whole")), group)
    j = grid.join(local.select(*keys, "key", F.col("mean").alias("local")), [*keys, "key"], "left")
    mean = (F.coalesce("local", F.lit(0.0)) * F.col("k") + F.col("whole") * pseudo) / (F.col("k") + pseudo)
    return j.select(*keys, "key", "k", F.round(mean, 6).alias("mean"))


def feature_distance(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b, divergence of pairs(a, b) by rows(article_id, key, p): squared distance of two distributions; null if one is missing."""
    x, y = rows.select(F.col("article_id").alias("a"), "key", F.col("p").alias("_p")), rows.select(F.col("article_id").alias("b"), "key", F.col("p").alias("_q"))
    # Keys of either side, absent shares being zero.
    keys = pairs.join(x.select("a", "key"), "a").unionByName(pairs.join(y.select("b", "key"), "b").select("a", "b", "key")).distinct()
    both = keys.join(x, ["a", "key"], "left").join(y, ["b", "key"], "left")
    terms = both.groupBy("a", "b").agg(F.sum(js_term(F.coalesce("_p", F.lit(0.0)), F.coalesce("_q", F.lit(0.0)))).alias("_d"), F.count("_p").alias("_n"), F.count("_q").alias("_m"))
    d = F.when((F.col("_n") > 0) & (F.col("_m") > 0), F.greatest(F.col("_d"), F.lit(0.0)))
    return pairs.join(terms, ["a", "b"], "left").select("a", "b", d.alias("divergence"))
