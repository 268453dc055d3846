"""Document predicates, claim routing, analyzer compatibility and edit similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def findings(files: DataFrame) -> DataFrame:
    """file, kind, detail of files(file, text): placeholder residue, secrets, dead references, budget."""
    residue = files.select("file", F.lit("placeholder").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(T.PLACEHOLDER_RESIDUE), F.lit(0))).alias("detail"))
    secrets = files.select("file", F.lit("secret").alias("kind"), F.explode(F.array_compact(F.array(*(F.when(F.col("text").rlike(p), k) for k, p in T.SECRETS.items())))).alias("detail"))
    links = files.select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("references/[\\w.\\-/]+"), F.lit(0)))).alias("detail"))
    names = files.select(F.col("file").alias("detail"))
    dead = links.join(names, "detail", "left_anti").select("file", F.lit("dead_reference").alias("kind"), "detail")
    lines = F.size(F.split("text", "\n", -1))
    budget = files.where((lines > 500) | (F.length("text") / 3 > 5000)).select("file", F.lit("budget").alias("kind"), F.concat_ws(" ", lines, F.expr("length(text) div 3")).alias("detail"))
    return residue.unionByName(secrets).unionByName(dead).unionByName(budget).distinct()


#: Most rules that are broadcast.
SENT_RULES = 100_000


def routed(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """claims(id, status, target, metric, condition) with destination by rules(status, target, metric, condition, destination, priority).

    A null in a rule fits anything; of the rules that fit, the one of least priority holds. Without one the claim is
    unmapped. Rules are broadcast where they are few (counted).
    """
    few = rules.count() <= SENT_RULES
    r = rules.select(*(F.col(c).alias(f"_{c}") for c in rules.columns))
    fits = (F.col("status") == F.col("_status")) & (F.col("target") == F.col("_target"))
    j = claims.join(F.broadcast(r) if few else r, fits, "left").where("_status is null or ((_metric is null or _metric = metric) and (_condition is null or _condition = condition))")
    best = j.groupBy("id").agg(F.min_by("_destination", "_priority").alias("destination"))
    return claims.join(best, "id", "left").withColumn("destination", F.coalesce("destination", F.lit("unmapped")))


def incomplete(claims: DataFrame, mapped: DataFrame) -> DataFrame:
    """id, problem: claims that no mapping or exclusion names, and names without a claim."""
    lost = claims.join(mapped, "id", "left_anti").select("id", F.lit("unmapped").alias("problem"))
    return lost.unionByName(mapped.join(claims, "id", "left_anti").select("id", F.lit("unknown").alias("problem")))


def analyzer_match(calibrated_mode: Column, calibrated_version: Column, mode: Column, version: Column) -> Column:
    """How the analyzer at hand fits the one of a calibration."""
    return (
        F.when(calibrated_mode.isNull(), "unknown").when(calibrated_mode != mode, "mode_mismatch").when(calibrated_version.isNotNull() & (calibrated_version != version), "version_mismatch").otherwise("match")
    )


def edit_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with ratio, the matching-block similarity of two texts; null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        for batch in batches:
            both = zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())
            yield batch.append_column("ratio", pa.array([SequenceMatcher(None, x or "", y or "").ratio() for x, y in both], pa.float64()))

    return pairs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", ratio double")


def shifts(deltas: DataFrame, ranges: DataFrame) -> DataFrame:
    """a, b, metric, shift of deltas with values(generated, final): a range left is widened, one entered enforced."""
    j = deltas.join(ranges, "metric")
    inside = lambda c: F.col(c).between(F.col("lo"), F.col("hi"))
    shift = F.when(inside("generated") & ~inside("final"), "widen").when(~inside("generated") & inside("final"), "enforce")
    return j.withColumn("shift", shift).where("shift is not null").select("a", "b", "metric", "shift")


def shift_counts(found: DataFrame) -> DataFrame:
    """metric, shift, n: how often feedback asks to widen or to enforce a metric's range."""
    return found.groupBy("metric", "shift").agg(F.count("*").alias("n"))
