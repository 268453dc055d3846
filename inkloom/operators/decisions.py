"""Thresholds, gates and claims over metrics in long form: group, article, metric, value.

One plan serves all metrics: thresholds are order statistics per group and metric, statuses a join with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from . import stats

# Metric, gate, rule, least width of the warn band (ratios also end at 1), baseline of claims.
METRICS = [
    ("sent_len_median", "G1", "range", 8.0, False, 45.0),
    ("sent_len_max", "G1", "upper", 10.0, False, 120.0),
    ("para_len_median", "G1", "range", 1.0, False, 3.0),
    ("comma_median", "G1", "range", 0.5, False, 1.2),
    ("desu_masu", "G2", "range", 0.08, True, 0.4),
    ("da_dearu", "G2", "range", 0.08, True, 0.3),
    ("taigen", "G2", "range", 0.08, True, 0.1),
    ("question", "G2", "range", 0.08, True, 0.05),
    ("longest_run", "G2", "run", 1.0, False, 3.0),
    ("script_kanji", "G3", "range", 0.08, True, 0.32),
    ("script_hiragana", "G3", "range", 0.08, True, 0.48),
    ("script_katakana", "G3", "range", 0.08, True, 0.08),
    ("script_latin", "G3", "range", 0.08, True, 0.04),
    ("ttr_window", "G4", "lower", 0.05, False, 0.7),
    ("distinct_2", "G4", "lower", 0.05, False, 0.85),
    ("func_word_rate", "G4", "range", 0.05, False, 0.5),
]
# Sizes below which a gate can't fail, and what they count.
LEAST = {"G1": ("n_sents", 10), "G2": ("n_sents", 10), "G3": ("n_chars", 300), "G4": ("n_tokens", 100)}
# Limits of a copy check.
COPY = {"exact": 25, "jaccard": 0.35, "minhash": 0.7, "containment": 0.8}
# What makes a claim hold.
AGREEMENT, MIN_ARTICLES, MIN_STRATA, SURE = 0.7, 3, 2, 0.9
CATALOG = ("sent_len", "para_len", "comma", "desu_masu", "da_dearu", "jotai_", "taigen", "question", "longest_run", "script_", "ttr_window", "distinct_2", "func_word_rate", "morph.")


def metric_table(spark: SparkSession) -> DataFrame:
    """metric, gate, rule, floor, ratio, baseline."""
    return spark.createDataFrame(METRICS, "metric string, gate string, rule string, floor double, ratio boolean, baseline double")


def in_catalog(metric: Column) -> Column:
    """Whether a metric is one of the feature catalog, by its prefix."""
    out = F.lit(False)
    for prefix in CATALOG:
        out = out | metric.startswith(prefix)
    return out


def evaluable(metrics: DataFrame, built: DataFrame) -> DataFrame:
    """metrics(metric, ...) with evaluable: in the catalog, present, and built in built(metric, status)."""
    known = built.select("metric", (F.col("status") == "built").alias("_built")).groupBy("metric").agg(F.max("_built").alias("_built"))
    return metrics.join(known, "metric", "left").withColumn("evaluable", in_catalog(F.col("metric")) & F.coalesce("_built", F.lit(False))).drop("_built")


def thresholds(values: DataFrame, group: list[str]) -> DataFrame:
    """group, metric, gate, rule, n, warn_lo, warn_hi, hard_lo, hard_hi, notes: the rule table of a group's texts.

    range: median and the greater of IQR and floor; upper: p95 and the upper bound; lower: p05 and the lower
    bound; run: cap and hard cap. Sides without a limit are null.
    """
    known = F.broadcast(metric_table(values.sparkSession))
    b = stats.bounds(values, [*group, "metric"], "value").join(known, "metric")
    c = F.col
    half = F.greatest(c("p75") - c("p25"), c("floor"))
    ends = lambda x: F.when(c("ratio"), F.least(x, F.lit(1.0))).otherwise(x)
    cap, hard_cap = stats.caps(c("p95"), c("upper"))
    by = lambda range_, upper, lower, run: F.when(c("rule") == "range", range_).when(c("rule") == "upper", upper).when(c("rule") == "lower", lower).otherwise(run)
    none = F.lit(None).cast("double")
    limits = b.withColumns(
        {
            "warn_lo": by(F.greatest(c("p50") - half, F.lit(0.0)), none, c("p05"), none), "warn_hi": by(ends(c("p50") + half), c("p95"), none, cap.cast("double")),
            "_lo": by(c("hard_lo"), none, c("lower"), none), "_hi": by(ends(c("hard_hi")), c("upper"), none, hard_cap.cast("double")),
        }
    )
    plain = S.band_notes(c("warn_lo"), c("warn_hi"), c("_lo"), c("_hi"), F.lit("two_sided"))
    more = F.array_compact(
        F.array(
            F.when((c("_lo") == 0) & (c("warn_lo") == 0), "lower_bound_degenerate_zero(one_sided_upper)"),
            F.when(c("_hi") - c("_lo") <= F.when(c("ratio"), F.lit(0.08)).otherwise(c("floor")) / 2, "hard_band_narrow"),
        )
    )
    notes = F.when(c("rule") == "range", F.sort_array(F.array_distinct(F.concat(plain, more)))).otherwise(F.array().cast("array<string>"))
    return limits.select(*group, "metric", "gate", "rule", "n", "warn_lo", "warn_hi", c("_lo").alias("hard_lo"), c("_hi").alias("hard_hi"), notes.alias("notes"))


def gates(values: DataFrame, limits: DataFrame, sizes: DataFrame, group: list[str], article: list[str]) -> DataFrame:
    """group, article, metric, gate, value, status, degraded: all metrics of G1 to G4 against their group's limits.

    ``sizes`` has (article, n_sents, n_chars, n_tokens). A text too short for its gate can't fail; ``degraded`` names why.
    """
    c = F.col
    j = values.join(limits, [*group, "metric"]).join(sizes, article)
    above = F.when(c("value") <= c("warn_hi"), "pass").when(c("value") > c("hard_hi"), "fail").otherwise("warn")
    below = F.when(c("value") >= c("warn_lo"), "pass").when(c("value") < c("hard_lo"), "fail").otherwise("warn")
    status = F.when(c("rule") == "range", S.range_status(c("value"), c("warn_lo"), c("warn_hi"), c("hard_lo"), c("hard_hi"))).when(c("rule") == "lower", below).otherwise(above)
    short = F.lit(None).cast("string")
    for gate, (size, least) in LEAST.items():
        short = F.when((c("gate") == gate) & (c(size) < least), F.concat(F.lit(f"insufficient_{size[2:]}("), c(size), F.lit(f"<{least})"))).otherwise(short)
    rows = j.withColumn("_s", status).withColumn("degraded", short)
    capped = F.when(c("degraded").isNotNull() & (c("_s") == "fail"), "warn").otherwise(c("_s"))
    return rows.select(*group, *article, "metric", "gate", "value", capped.alias("status"), "degraded")


def gate_results(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gate, status: the worst status of each gate."""
    return rows.groupBy(*keys, "gate").agg(S.worst(F.col("status")).alias("status"))


def passed(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, passed: whether no gate fails. There is no score made of several gates."""
    return results.groupBy(*keys).agg((~F.max(F.coalesce(F.col("status") == "fail", F.lit(False)))).alias("passed"))


def claims_of_gates(findings: DataFrame, mappings: DataFrame) -> DataFrame:
    """findings(gate, metric, ...) with claim_ids: the claims that mappings(claim_id, metric) trace to a metric; empty if none."""
    of = mappings.groupBy("metric").agg(F.sort_array(F.collect_set("claim_id")).alias("claim_ids"))  # claims of one metric
    return findings.join(of, "metric", "left").withColumn("claim_ids", F.coalesce("claim_ids", F.array().cast("array<string>")))


def claim_gates(values: DataFrame, strata: DataFrame, group: list[str], agreement: DataFrame | None = None) -> DataFrame:
    """group, metric, n, median, direction, effect, articles, strata, support, stable, (agreement,) status, target, confidence.

    A claim says on which side of its baseline a group's median lies; none if it lies on it. Support counts the
    articles on that side and their strata(article_id, stratum). It is core with support, a median that stays on
    its side whatever value is dropped and, where ``agreement(group, metric, agreement)`` is given, resamples
    that agree; without support it is local, else ambiguous.
    """
    c = F.col
    keys = [*group, "metric"]
    base = F.broadcast(metric_table(values.sparkSession).select("metric", "baseline"))
    rows = values.join(base, "metric").join(strata, "article_id", "left")
    loao = stats.loao_direction(rows, keys, "value", c("baseline")).select(*keys, "n", "median", "stable")
    v, b = c("value"), c("baseline")
    sides = rows.groupBy(*keys).agg(
        F.max("baseline").alias("baseline"), F.count_if(v > b).alias("above"), F.count_if(v < b).alias("below"), F.count("*").alias("all"),
        F.count_distinct(F.when(v > b, F.coalesce("stratum", F.lit("unknown")))).alias("strata_above"), F.count_distinct(F.when(v < b, F.coalesce("stratum", F.lit("unknown")))).alias("strata_below"),
    )
    j = loao.join(sides, keys).where(c("median") != c("baseline"))
    up = c("median") > c("baseline")
    j = j.select(
        *keys, "n", "median", F.when(up, "above").otherwise("below").alias("direction"), ((c("above") - c("below")) / c("all")).alias("effect"), F.when(up, c("above")).otherwise(c("below")).alias("articles"),
        F.when(up, c("strata_above")).otherwise(c("strata_below")).alias("strata"), "stable",
    ).withColumn("support", (c("articles") >= MIN_ARTICLES) & (c("strata") >= MIN_STRATA))
    agrees, sure = F.lit(True), F.lit(False)
    if agreement is not None:
        j = j.join(agreement.select(*keys, "agreement"), keys)
        agrees, sure = c("agreement") >= AGREEMENT, c("agreement") >= SURE
    core = c("support") & c("stable") & agrees
    status = F.when(core, "core").when(~c("support"), "local").otherwise("ambiguous")
    target = F.when(core, "always_on_rule").when(~c("support"), "example").otherwise("checklist")
    return j.withColumns({"status": status, "target": target, "confidence": F.when(core & sure, "high").otherwise("medium")})


def evidence(values: DataFrame, clean: DataFrame, group: list[str], claims: DataFrame, most: int = 3) -> DataFrame:
    """group, metric, rank, article_id, char_start, char_end: first body block of the supporting articles farthest from the baseline."""
    base = F.broadcast(metric_table(values.sparkSession).select("metric", "baseline"))
    side = claims.select(*group, "metric", (F.col("direction") == "above").alias("_up"))
    rows = values.join(base, "metric").join(side, [*group, "metric"]).where(((F.col("value") > F.col("baseline")) == F.col("_up")) & (F.col("value") != F.col("baseline")))
    far = F.round(F.abs(F.col("value") - F.col("baseline")), 9)
    w = Window.partitionBy(*group, "metric").orderBy(F.desc("_far"), "article_id")
    chosen = rows.select(*group, "metric", "article_id", far.alias("_far")).distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_far")
    body = F.filter("blocks", lambda b: b["type"] == "body")
    first = clean.where(F.size(body) > 0).select("article_id", body[0]["char_start"].alias("char_start"), body[0]["char_end"].alias("char_end"))
    return chosen.join(first.groupBy("article_id").agg(F.min(F.struct("char_start", "char_end")).alias("s")), "article_id").select(*group, "metric", "rank", "article_id", "s.char_start", "s.char_end")


def slice_statuses(slices: DataFrame, group: list[str], full: int = 10, small: int = 5) -> DataFrame:
    """group, slice, n, status, reason of slices(group, article_id, slice): built from ``full`` articles on, shrunk to the whole from ``small`` on."""
    per = slices.groupBy(*group, "slice").agg(F.count_distinct("article_id").alias("n"))
    n = F.col("n")
    status = F.when(n >= full, "built").when(n >= small, "shrunk").otherwise("skipped")
    reason = F.when(n >= full, None).when(n >= small, F.concat(F.lit("shrunk_to_global(n="), n, F.lit(")"))).otherwise(F.concat(F.lit("insufficient_n("), n, F.lit(f"<{small})")))
    return per.withColumns({"status": status, "reason": reason})


def channel_results(measured: DataFrame, reference: DataFrame, spread: DataFrame, keys: list[str], article: list[str], sample: DataFrame, min_sample: int, severity: str = "fail") -> DataFrame:
    """keys, article, distance, status, percentile, reason of measured(keys, article, distance) against a built channel.

    Reasons to skip come in this order: the reference is not built, the text has no distance, its
    sample(article, sample) is too small. The percentile is the share of spread(keys, distance), the distances of
    the reference's own articles, that are not greater.
    """
    c = F.col
    j = measured.join(reference.select(*keys, c("status").alias("_built"), "warn", "fail"), keys, "left").join(sample, article, "left")
    reason = (
        F.when(c("_built").isNull(), "reference_absent").when(c("_built") != "built", "reference_not_built").when(c("distance").isNull(), "channel_unavailable")
        .when(F.coalesce("sample", F.lit(0)) < min_sample, F.concat(F.lit("insufficient_sample("), F.coalesce("sample", F.lit(0)), F.lit(f"<{min_sample})")))
    )
    status = F.when(c("distance") <= c("warn"), "pass").when(c("distance") <= c("fail"), "warn").otherwise("fail")
    rows = j.withColumn("reason", reason).withColumn("status", F.when(c("reason").isNotNull(), "skipped").otherwise(S.capped(status, F.lit(severity))))
    # Shares by rank: both kinds of distances in one order, the reference's counted up to each measured one.
    both = rows.select(*keys, *article, "distance", F.lit(0).alias("_own")).unionByName(spread.select(*keys, "distance", F.lit(1).alias("_own")), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    upto = F.sum("_own").over(w.orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)) / F.nullif(F.sum("_own").over(w), F.lit(0))
    ranks = both.where("distance is not null").withColumn("percentile", F.round(F.coalesce(upto, F.lit(0.0)), 4)).where("_own = 0").select(*keys, *article, "percentile").distinct()
    out = rows.join(ranks, [*keys, *article], "left")
    return out.select(*keys, *article, "distance", "status", F.when(c("status") != "skipped", c("percentile")).alias("percentile"), "reason")


def worst_slices(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slice, status, percentile: of results(keys, slice, status, percentile) the worst that is not skipped, the whole ('global') first on ties."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(F.desc(rank), F.desc(F.coalesce("percentile", F.lit(0.0))), (F.col("slice") != "global").cast("int"), "slice")
    return results.where("status <> 'skipped'").withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, "slice", "status", "percentile")


def example_sentences(sentences: DataFrame, deviations: DataFrame, article: list[str], has_key: Column, most: int = 2) -> DataFrame:
    """article, key, pos, sentence: the first sentences that hold the key their article uses most above its reference.

    ``has_key`` tells for joined rows whether the sentence holds the key.
    """
    w = Window.partitionBy(*article).orderBy(F.desc(F.round("delta", 9)), "key")
    top = deviations.where("delta > 0").withColumn("r", F.row_number().over(w)).where("r = 1").select(*article, "key")
    hits = sentences.join(top, article).where(has_key).withColumn("r", F.row_number().over(Window.partitionBy(*article).orderBy("pos"))).where(F.col("r") <= most)
    return hits.select(*article, "key", "pos", "sentence")


def paragraphs(texts: DataFrame, key: str, least: int = 30) -> DataFrame:
    """key, para, text: parts of texts between blank lines that have ``least`` characters other than white space."""
    parts = texts.select(key, F.posexplode(F.split("text", "\\n[ \\t\\r]*\\n", -1)).alias("para", "text"))
    return parts.where(F.length(F.regexp_replace("text", T.SPACE + "+", "")) >= least)


def copy_gate(exact: DataFrame, jaccard: DataFrame, minhash: DataFrame, contained: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """key, longest, jaccard, minhash, containment, status: a copy check fails above any of its limits.

    Inputs: exact(key, length), jaccard(key, jaccard), minhash(key, minhash), contained(key, best), the greatest
    containment of a paragraph. What shares nothing is 0.
    """
    most = lambda df, c, name: df.groupBy(key).agg(F.max(c).alias(name))
    parts = (most(exact, "length", "longest"), most(jaccard, "jaccard", "jaccard"), most(minhash, "minhash", "minhash"), most(contained, "best", "containment"))
    out = texts.select(key).distinct()
    for part in parts:
        out = out.join(part, key, "left")
    out = out.select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("longest", "jaccard", "minhash", "containment")))
    over = (F.col("longest") > COPY["exact"]) | (F.col("jaccard") > COPY["jaccard"]) | (F.col("minhash") > COPY["minhash"]) | (F.col("containment") > COPY["containment"])
    return out.withColumn("status", F.when(over, "fail").otherwise("pass"))
