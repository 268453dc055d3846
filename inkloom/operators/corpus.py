"""Corpus assembly: eligibility, validation, chronological splits, leaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Domains of the manifest, and what code-like lines and residual fences look like.
STATUSES = ("eligible", "quarantined", "excluded")
SPLITS = ("train", "dev", "holdout")
BLOCK_TYPES = ("body", "quote", "code", "boilerplate", "editorial")
WORD = "[\\p{L}\\p{N}_]"
CODE_LINE = (
    f"^{T.SPACE}*(?:[$>]{T.SPACE}+|(?:const|let|var|function|class|def|fn|pub|use|import|package|SELECT|INSERT|UPDATE)(?:[^\\p{{L}}\\p{{N}}_]|$)"
    f"|[{{}}\\[\\]();]{{2,}}|(?:{WORD}|[.])+{T.SPACE}*[:=]{T.SPACE}*[^。]+[;,]?)"
)
INDENTED = "^(?: {4}|\t)"
NESTED_ITEM = f"^{T.SPACE}{{4,}}(?:[-*+] |[0-9]+[.)] )"
FENCE = f"^{T.SPACE}{{0,3}}(?:`{{3,}}[^`]*$|~{{3,}})"


def body_text(blocks: Column) -> Column:
    """Body blocks joined by a line feed; null for null blocks."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "body"), lambda b: b["text"]), "\n")


def is_eligible(consent: Column, health: Column) -> Column:
    return F.when(consent.isNotNull() & (F.coalesce(health, F.lit("pass")) != "fail"), "eligible").otherwise("quarantined")


def profile_articles(manifest: DataFrame, splits: DataFrame, allowed: tuple[str, ...] = ("train", "dev")) -> DataFrame:
    """Eligible articles by their subject, no duplicates of others, in the allowed splits."""
    kept = splits.where(F.col("split").isin(*allowed)).select("article_id")
    return manifest.where("status = 'eligible' and authorship = 'subject-authored' and dup_of is null").join(kept, "article_id", "left_semi")


def block_health(bodies: DataFrame, key: str) -> DataFrame:
    """Counts, ratios and status of bodies(key, body) by lines: residue of code or an empty body fails, much Latin warns."""
    body = F.coalesce("body", F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(T.NONSPACE))
    count = lambda p: F.size(F.filter("lines", p))
    n = bodies.select(key, lines.alias("lines"), F.length(F.regexp_replace(body, T.SPACE + "+", "")).alias("body_chars"), F.regexp_count(body, F.lit("[A-Za-z]")).alias("latin"))
    n = n.select(
        key, "body_chars", F.size("lines").alias("body_lines"), "latin",
        count(lambda x: x.rlike(CODE_LINE)).alias("code_like_lines"),
        count(lambda x: x.rlike(FENCE)).alias("fences"),
        count(lambda x: x.rlike(INDENTED) & ~x.rlike(NESTED_ITEM)).alias("indented"),
    )
    code = F.when(F.col("body_lines") > 0, F.col("code_like_lines") / F.col("body_lines")).otherwise(0.0)
    latin = F.when(F.col("body_chars") > 0, F.col("latin") / F.col("body_chars")).otherwise(0.0)
    bad = (F.col("body_chars") == 0) | (F.col("fences") > 0) | (F.col("indented") > 0) | ((F.col("body_lines") >= 10) & (code >= 0.35))
    status = F.when(bad, "fail").when((F.col("body_chars") >= 500) & (latin >= 0.45), "warn").otherwise("pass")
    return n.select(key, "body_chars", "body_lines", "code_like_lines", F.round(code, 4).alias("code_like_line_ratio"), F.round(latin, 4).alias("latin_ratio"), status.alias("status"))


def chronological_split(articles: DataFrame, group: str, unit: str, order: Column, ratio: tuple[int, int, int] = (70, 15, 15)) -> DataFrame:
    """group, unit, split: units in order of their oldest member, cut by ratio; each split has one of three or more.

    Counts round half to even; train takes the rest. ``order`` is the date of an article; ties by unit.
    """
    units = articles.groupBy(group, unit).agg(F.min(order).alias("first"))
    per = Window.partitionBy(group)
    n = F.count("*").over(per)
    share = lambda r: F.when((F.bround(n * r / 100) == 0) & (n >= 3) & (F.lit(r) > 0), 1).otherwise(F.bround(n * r / 100))
    rows = units.withColumn("n", n).withColumn("dev", share(ratio[1])).withColumn("holdout", share(ratio[2])).withColumn("rn", F.row_number().over(per.orderBy("first", unit)))
    train = F.col("n") - F.col("dev") - F.col("holdout")
    return rows.select(group, unit, F.when(F.col("rn") <= train, "train").when(F.col("rn") <= train + F.col("dev"), "dev").otherwise("holdout").alias("split"))


def leak_summary(pairs_above: Callable[[float], DataFrame], limit: float = 0.3, lower: tuple[float, ...] = (0.05, 0.0)) -> DataFrame:
    """max_jaccard, leaks, passed over all cross-split pairs; without a pair that shares anything the maximum is 0.

    ``pairs_above(t)`` gives the pairs(jaccard) above t. As the maximum lies among the pairs above any
    limit that some pair reaches, lower limits, which cost more, are tried only while no pair is found.
    """
    for t in (limit, *lower):
        pairs = pairs_above(t)
        if t == lower[-1] or not pairs.isEmpty():
            break
    return pairs.agg(F.coalesce(F.max("jaccard"), F.lit(0.0)).alias("max_jaccard"), F.count_if(F.col("jaccard") > limit).alias("leaks")).withColumn("passed", F.col("leaks") == 0)


def invalid_rows(rows: DataFrame, key: str, required: list[str], domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """key, problem: rows with null required columns or values outside their domains."""
    checks = [F.when(F.col(c).isNull(), f"missing:{c}") for c in required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*d), f"domain:{c}") for c, d in domains.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("problem")).distinct()


def invalid_blocks(clean: DataFrame, key: str) -> DataFrame:
    """key, problem: articles without blocks, and blocks with an unknown type, no text or spans that don't fit."""
    rows = clean.select(key, F.when(F.col("blocks").isNull(), "missing:blocks").alias("problem")).where("problem is not null")
    b = clean.select(key, F.explode("blocks").alias("b"))
    checks = F.array(
        F.when(F.col("b.type").isNull() | ~F.col("b.type").isin(*BLOCK_TYPES), "domain:type"), F.when(F.col("b.text").isNull(), "missing:text"),
        F.when(F.col("b.char_start").isNull() | F.col("b.char_end").isNull() | (F.col("b.char_end") < F.col("b.char_start")), "span"),
    )
    return rows.unionByName(b.select(key, F.explode(F.array_compact(checks)).alias("problem"))).distinct()


def markers_dense(texts: DataFrame, key: str, marker: str, window: int = 1000, cap: int = 2) -> DataFrame:
    """key, n_marks, status: fail if more than ``cap`` marker starts lie within less than ``window`` characters."""
    parts = texts.select(key, F.split(F.coalesce("text", F.lit("")), marker, -1).alias("p"))
    at = parts.select(key, F.posexplode("p").alias("i", "part"), F.size("p").alias("n"))
    order = Window.partitionBy(key).orderBy("i")
    ends = at.withColumn("start", F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i") * len(marker.replace("\\", "")))
    starts = ends.withColumn("far", F.lead("start", cap).over(order)).where(F.col("i") < F.col("n") - 1)
    far = starts.withColumn("last", F.col("i") + cap < F.col("n") - 1)
    agg = far.groupBy(key).agg(F.count("*").alias("n_marks"), F.max(((F.col("far") - F.col("start")) < window) & F.col("last")).alias("dense"))
    return texts.select(key).join(agg, key, "left").select(key, F.coalesce("n_marks", F.lit(0)).alias("n_marks"), F.when(F.col("dense"), "fail").otherwise("pass").alias("status"))
