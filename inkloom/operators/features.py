"""Per-article style features over texts(author, article, text), from sentences up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def sentence_rows(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, pos, sentence: one row a sentence; null and blank texts give none."""
    return texts.select(*keys, F.posexplode_outer(T.sentences(F.col(column))).alias("pos", "sentence")).where("sentence is not null")


def built_sentences(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, sentence, prose_span, raw_span, masked of segments(keys, text, char_start, raw_map, masked).

    Spans are structs (s, e), ends exclusive: of the sentence in its segment and in the raw text; masked spans
    are clipped to the sentence and count from its start. Null and blank texts give no rows.
    """
    at = segments.select(*keys, "char_start", "raw_map", "masked", F.posexplode_outer(T.sentence_spans(F.col("text"))).alias("pos", "x")).where("x is not null")
    s, e = F.col("x.s"), F.col("x.e")
    return at.select(
        *keys, "pos", F.col("x.text").alias("sentence"), F.struct(s.alias("s"), e.alias("e")).alias("prose_span"),
        T.raw_span(F.col("raw_map"), F.col("char_start"), s, e).alias("raw_span"), T.masked_in(F.col("masked"), s, e).alias("masked"),
    )


def article_counts(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_sents, n_chars of segments(keys, text, n_masked_chars): line ends and masked characters don't count."""
    n = F.length(F.replace("text", F.lit("\n"), F.lit(""))) - F.coalesce("n_masked_chars", F.lit(0))
    return segments.groupBy(*keys).agg(F.sum(F.size(T.sentences(F.col("text"))).cast("bigint")).alias("n_sents"), F.sum(n).cast("bigint").alias("n_chars"))


def sentence_lengths(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_sents, median, quartiles and maximum of sentence lengths."""
    n = F.length("sentence")
    return sentences.groupBy(*keys).agg(
        F.count("*").alias("n_sents"),
        F.percentile(n, 0.5).alias("sent_len_median"),
        F.percentile(n, 0.25).alias("sent_len_q1"),
        F.percentile(n, 0.75).alias("sent_len_q3"),
        F.max(n).alias("sent_len_max"),
    )


def comma_stats(sentences: DataFrame, keys: list[str]) -> DataFrame:
    n = F.regexp_count("sentence", F.lit(T.COMMAS))
    return sentences.groupBy(*keys).agg(F.percentile(n, 0.5).alias("comma_median"), F.percentile(n, 0.25).alias("comma_q1"), F.percentile(n, 0.75).alias("comma_q3"))


def ending_shares(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each class of sentence end, all classes present."""
    cls = sentences.withColumn("cls", T.sentence_end_class(F.col("sentence")))
    return cls.groupBy(*keys).agg(*(F.avg((F.col("cls") == c).cast("int")).alias(c) for c in T.ENDINGS))


def script_ratio(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Share of each script among characters other than white space; zeros for blank texts, null for null."""
    counts = T.script_counts(F.col(column))
    known = sum((counts[k] for k in T.SCRIPTS), F.lit(0))
    share = lambda c: F.when(counts["nonspace"] == 0, 0.0).otherwise(c / counts["nonspace"])
    return texts.select(*keys, *(share(counts[k]).alias(k) for k in T.SCRIPTS), share(counts["nonspace"] - known).alias("other"))


def longest_run(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Longest run of equal sentence ends, the first of equally long ones: keys, run, cls, first_pos, last_pos."""
    order = Window.partitionBy(*keys).orderBy("pos")
    cls = sentences.select(*keys, "pos", T.sentence_end_class(F.col("sentence")).alias("cls"))
    islands = cls.withColumn("island", F.row_number().over(order) - F.row_number().over(Window.partitionBy(*keys, "cls").orderBy("pos")))
    runs = islands.groupBy(*keys, "cls", "island").agg(F.count("*").alias("run"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    best = F.max_by(F.struct("run", "cls", "first_pos", "last_pos"), F.struct(F.col("run"), -F.col("first_pos")))
    return runs.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def hedge_stats(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of hedged, speculative and quoting sentences."""
    s = F.col("sentence")
    return sentences.groupBy(*keys).agg(
        F.avg((F.size(T.hedge_families(s)) > 0).cast("int")).alias("hedge_rate"),
        F.avg(T.is_speculative(s).cast("int")).alias("speculative_rate"),
        F.avg(s.rlike(T.QUOTE).cast("int")).alias("quote_sentence_rate"),
    )


def hedge_distribution(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """keys, key, n, p: how hedge families share the hedges."""
    rows = sentences.select(*keys, F.explode(T.hedge_families(F.col("sentence"))).alias("key"))
    return with_shares(rows.groupBy(*keys, "key").agg(F.count("*").alias("n")), keys)


def comma_positions(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position in [0, 1): of each comma in its sentence's core of more than one character."""
    core = sentences.select(*keys, T.sentence_core(F.col("sentence")).alias("core")).where("length(core) > 1")
    chars = core.select(*keys, F.length("core").alias("size"), F.posexplode(F.split("core", "")).alias("at", "c"))
    return chars.where(F.col("c").rlike(T.COMMAS)).select(*keys, (F.col("at") / F.col("size")).alias("position"))


def comma_position_stats(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of commas by quarter of the sentence, and the upper median of their positions."""
    p = comma_positions(sentences, keys)
    quarter = F.least(F.floor(F.col("position") * 4), F.lit(3))
    return p.groupBy(*keys).agg(
        F.count("*").alias("n_commas"),
        *(F.avg((quarter == i).cast("int")).alias(f"q{i + 1}") for i in range(4)),
        F.element_at(F.sort_array(F.collect_list("position")), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median_position"),
    )


def with_shares(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts n with p, the share within keys."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def paragraph_lengths(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Median and quartiles of sentences per segment, segments without sentences left out."""
    per = segments.select(*keys, F.size(T.sentences(F.col("text"))).alias("n")).where("n > 0")
    return per.groupBy(*keys).agg(F.count("*").alias("n_paras"), F.percentile("n", 0.5).alias("para_len_median"), F.percentile("n", 0.25).alias("para_len_q1"), F.percentile("n", 0.75).alias("para_len_q3"))


def distinct_windows(tokens: DataFrame, keys: list[str], width: int = 100, step: int = 50) -> DataFrame:
    """Mean type-token ratio over token windows (tokens: keys, tok_idx from 0, surface); short texts are one window."""
    size = F.count("*").over(Window.partitionBy(*keys))
    last = F.when(F.col("n") <= width, 0).otherwise(F.floor((F.col("n") - width) / step))
    first_win = F.greatest(F.lit(0), F.ceil((F.col("tok_idx") - width + 1) / step))
    rows = tokens.withColumn("n", size).withColumn("w", F.explode(F.sequence(F.least(first_win, last + 1).cast("int"), F.least(F.floor(F.col("tok_idx") / step), last).cast("int"))))
    ok = rows.where((F.col("w") <= last) & (F.col("tok_idx") >= F.col("w") * step) & ((F.col("n") <= width) | (F.col("tok_idx") < F.col("w") * step + width)))
    per = ok.groupBy(*keys, "w").agg((F.count_distinct("surface") / F.count("*")).alias("ttr"))
    return per.groupBy(*keys).agg(F.avg("ttr").alias("ttr_window"))
