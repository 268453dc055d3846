"""Style channels of articles: a registry, and distributions and scalars with their sample sizes over a token table.

Token table: keys, sent_idx, tok_idx, surface, pos, pos_detail, base, cform, masked; pos and the like come from a
pluggable analyzer. Sentence table: the article's keys, sent_idx, para (the segment), one row a sentence whether
it has tokens or not. All are built-ins; a channel is one projection of the tokens, one shuffle by sentence
serves all channels, and counts are combined before they are shuffled by article.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import CLOSED, FIRST_PERSON, FORMAL_NOUNS, FUNCTION, SKIPPED

REGISTRY_VERSION = "2"
# Channel, kind, needs, highest severity, number of keys kept, least sample.
CHANNELS = [
    tuple(x.split())
    for x in """
    pos_unigram dist pos fail 20 50
    pos_bigram dist pos fail 40 50
    pos_trigram dist pos fail 60 80
    particle_bigram dist pos fail 40 30
    funcword_bigram dist pos fail 60 40
    aux_lemma dist pos fail 20 15
    final_suffix2 dist pos fail 40 8
    final_suffix3 dist pos warn 60 10
    final_pos_cform dist pos fail 20 8
    content_masked_lemma_bigram dist pos warn 80 60
    formal_noun dist pos warn 7 5
    conj_lemma dist pos warn 20 5
    para_initial_pos dist pos warn 10 5
    para_initial_conj dist pos warn 15 3
    pre_comma_pos dist pos warn 15 8
    pre_comma_lemma dist pos warn 30 8
    comma_rel_pos dist surface warn 4 8
    hedge_class dist surface warn 8 3
    first_person_lemma dist pos warn 6 3
    formal_noun_rate scalar pos fail - 50
    demonstrative_rate scalar pos warn - 50
    first_person_rate scalar pos warn - 50
    first_person_top_share scalar pos warn - 3
    quote_sentence_rate scalar surface warn - 5
    conj_rate scalar pos warn - 5
    para_initial_conj_rate scalar pos warn - 3
    verb_noun_ratio scalar pos fail - 50
    modifier_density scalar pos fail - 50
    comma_first_quarter_ratio scalar surface warn - 8
    comma_rel_pos_median scalar surface warn - 8
    negative_rate scalar pos warn - 5
    past_rate scalar pos warn - 5
    speculative_rate scalar surface warn - 5
    hedge_rate scalar surface warn - 5
    max_consecutive_same_suffix2 scalar pos warn - 5
    """.strip().splitlines()
]
# Demonstratives and the parts of speech they count in, modifiers, negations and the past.
DEMONSTRATIVES = "これ それ あれ ここ そこ あそこ こちら そちら あちら この その あの こう そう ああ こんな そんな あんな こういう そういう ああいう".split()
DEMONSTRATIVE_POS = ("代名詞", "連体詞", "副詞", "形状詞", "名詞")
MODIFIERS = ("副詞", "形容詞", "形状詞", "連体詞")
NEGATIONS, PAST = ("ない", "ぬ", "ん"), "た"
DEPENDENT, NOMINALIZER = "非自立可能", "準体助詞"


def registry(spark: SparkSession) -> DataFrame:
    """channel, kind, requires, max_severity, top_k (null for scalars), min_sample, registry_version: 35 rows."""
    rows = [(c, kind, needs, most, int(k) if k != "-" else None, int(n)) for c, kind, needs, most, k, n in CHANNELS]
    return spark.createDataFrame(rows, "channel string, kind string, requires string, max_severity string, top_k int, min_sample int").withColumn("registry_version", F.lit(REGISTRY_VERSION))


def is_function_token() -> Column:
    """Closed classes, formal nouns, and verbs and adjectives that can be dependent."""
    pos, base = F.col("pos"), F.col("base")
    return F.coalesce(pos.isin(*CLOSED) | ((pos == "名詞") & base.isin(*FORMAL_NOUNS)) | (pos.isin("動詞", "形容詞") & (F.col("pos_detail") == DEPENDENT)), F.lit(False))


def masked_lemma() -> Column:
    """The lemma of function tokens, the part of speech of all others."""
    return F.when(is_function_token(), F.col("base")).otherwise(F.col("pos"))


def is_formal_noun() -> Column:
    pos, base = F.col("pos"), F.col("base")
    return ((pos == "名詞") & base.isin(*FORMAL_NOUNS)) | ((pos == "助詞") & (F.col("pos_detail") == NOMINALIZER) & (base == "の"))


def is_demonstrative() -> Column:
    return F.col("base").isin(*DEMONSTRATIVES) & F.col("pos").isin(*DEMONSTRATIVE_POS)


def is_first_person() -> Column:
    return F.col("base").isin(*FIRST_PERSON) & F.col("pos").isin("代名詞", "名詞")


def content_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens that count: no marks, white space or masked places."""
    return tokens.where(~F.col("pos").isin(*SKIPPED) & ~F.coalesce("masked", F.lit(False)))


def mark_masked(tokens: DataFrame) -> DataFrame:
    """tokens(start, end, spans) with masked: whether a token overlaps one of its sentence's masked spans (s, e)."""
    hit = F.exists("spans", lambda m: (F.col("start") < m["e"]) & (F.col("end") > m["s"]))
    return tokens.withColumn("masked", F.coalesce(hit, F.lit(False))).drop("spans")


def _sequences(rows: DataFrame, article: list[str], key: Column, n: int, channel: str) -> DataFrame:
    """article, channel, key: keys of n rows that follow each other in a sentence, joined by a bar."""
    w = Window.partitionBy(*article, "sent_idx").orderBy("tok_idx")
    parts = [F.lead("_k", i).over(w) for i in range(n)]
    grams = rows.withColumn("_k", key).select(*article, *(p.alias(f"_{i}") for i, p in enumerate(parts))).where(F.col(f"_{n - 1}").isNotNull())
    return grams.select(*article, F.lit(channel).alias("channel"), F.concat_ws("|", *(f"_{i}" for i in range(n))).alias("key"))


def sentence_ends(tokens: DataFrame, article: list[str]) -> DataFrame:
    """article, sent_idx, suffix2, suffix3: masked lemmas of the last two and three content tokens (or fewer, if it has no more)."""
    w = Window.partitionBy(*article, "sent_idx").orderBy(F.desc("tok_idx"))
    last = content_tokens(tokens).withColumn("r", F.row_number().over(w)).where("r <= 3")
    key = F.struct("tok_idx", "r", masked_lemma().alias("k"))
    three = last.groupBy(*article, "sent_idx").agg(F.sort_array(F.collect_list(key)).alias("t"))  # three tokens at most
    joined = lambda n: F.array_join(F.transform(F.filter("t", lambda x: x["r"] <= n), lambda x: x["k"]), "|")
    return three.select(*article, "sent_idx", joined(2).alias("suffix2"), joined(3).alias("suffix3"))


def final_tokens(tokens: DataFrame, article: list[str]) -> DataFrame:
    """The last token of each sentence with a content token, marks and masked places left out."""
    w = Window.partitionBy(*article, "sent_idx").orderBy(F.desc("tok_idx"))
    return content_tokens(tokens).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def before_commas(tokens: DataFrame, article: list[str]) -> DataFrame:
    """article, pos, lemma: the last token that is no mark before each comma; masked places are not seen."""
    w = Window.partitionBy(*article, "sent_idx").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.when(~F.col("pos").isin(*SKIPPED), F.struct("pos", masked_lemma().alias("lemma")))
    seen = tokens.where(~F.coalesce("masked", F.lit(False))).withColumn("before", F.last(kept, ignorenulls=True).over(w))
    return seen.where((F.col("pos") == "補助記号") & (F.col("pos_detail") == "読点") & F.col("before").isNotNull()).select(*article, "before.*")


def paragraph_starts(tokens: DataFrame, sentences: DataFrame, article: list[str]) -> DataFrame:
    """The first content token of the first sentence of each paragraph that has one."""
    w = Window.partitionBy(*article, "para").orderBy("sent_idx", "tok_idx")
    rows = content_tokens(tokens).drop("para").join(sentences.select(*article, "sent_idx", "para"), [*article, "sent_idx"]).where("para is not null")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def channel_keys(tokens: DataFrame, sentences: DataFrame, article: list[str]) -> DataFrame:
    """article, channel, key: one row for each occurrence, of the 17 part-of-speech distributions."""
    c = content_tokens(tokens)
    pos, base = F.col("pos"), F.col("base")
    one = lambda rows, channel, key: rows.select(*article, F.lit(channel).alias("channel"), key.alias("key"))
    ends = sentence_ends(tokens, article)
    commas = before_commas(tokens, article)
    starts = paragraph_starts(tokens, sentences, article)
    parts = [
        one(c, "pos_unigram", pos),
        _sequences(c, article, pos, 2, "pos_bigram"),
        _sequences(c, article, pos, 3, "pos_trigram"),
        _sequences(c.where(pos == "助詞"), article, base, 2, "particle_bigram"),
        _sequences(c.where(pos.isin(*FUNCTION)), article, base, 2, "funcword_bigram"),
        one(c.where(pos == "助動詞"), "aux_lemma", base),
        one(ends, "final_suffix2", F.col("suffix2")),
        one(ends, "final_suffix3", F.col("suffix3")),
        one(final_tokens(tokens, article), "final_pos_cform", F.concat_ws("|", "pos", F.coalesce("cform", F.lit("*")))),
        _sequences(c, article, masked_lemma(), 2, "content_masked_lemma_bigram"),
        one(c.where(is_formal_noun()), "formal_noun", base),
        one(c.where(pos == "接続詞"), "conj_lemma", base),
        one(starts, "para_initial_pos", pos),
        one(starts.where(pos == "接続詞"), "para_initial_conj", base),
        one(commas, "pre_comma_pos", F.col("pos")),
        one(commas, "pre_comma_lemma", F.col("lemma")),
        one(c.where(is_first_person()), "first_person_lemma", base),
    ]
    return reduce(DataFrame.unionByName, parts)


def channel_distributions(tokens: DataFrame, sentences: DataFrame, article: list[str]) -> DataFrame:
    """article, channel, key, n, p: counts and shares of each channel's keys; an article without any has no row."""
    counts = channel_keys(tokens, sentences, article).groupBy(*article, "channel", "key").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*article, "channel")))


def longest_suffix_run(tokens: DataFrame, sentences: DataFrame, article: list[str]) -> DataFrame:
    """article, max_consecutive_same_suffix2: longest run of sentences of one suffix; sentences without tokens break runs."""
    s = sentences.select(*article, "sent_idx").join(sentence_ends(tokens, article), [*article, "sent_idx"], "left")
    order = Window.partitionBy(*article).orderBy("sent_idx")
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy(*article, "suffix2").orderBy("sent_idx"))
    runs = s.withColumn("island", island).groupBy(*article, "suffix2", "island").agg(F.count("*").alias("n"))
    longest = F.max(F.when(F.col("suffix2").isNotNull(), F.col("n")).otherwise(0))
    return runs.groupBy(*article).agg(longest.cast("double").alias("max_consecutive_same_suffix2"))


def token_counts(tokens: DataFrame, sentences: DataFrame, article: list[str]) -> DataFrame:
    """One row an article of the counts that scalars and sample sizes need."""
    pos, base = F.col("pos"), F.col("base")
    c = content_tokens(tokens)
    of = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    negative = ((pos == "助動詞") & base.isin(*NEGATIONS)) | ((pos == "形容詞") & (base == "ない"))
    # Per sentence first: sentence shares, and sequences of function words within a sentence.
    per = c.groupBy(*article, "sent_idx").agg(
        F.count("*").alias("n_tokens"), of(pos == "助詞").alias("n_particles"), F.greatest(of(pos.isin(*FUNCTION)) - 1, F.lit(0)).alias("n_func_pairs"), of(pos == "助動詞").alias("n_aux"),
        of(is_formal_noun()).alias("n_formal"), of(is_demonstrative()).alias("n_demo"), of(is_first_person()).alias("n_first"), of(pos == "接続詞").alias("n_conj"), of(pos == "動詞").alias("n_verb"),
        of(pos == "名詞").alias("n_noun"), of(pos.isin(*MODIFIERS)).alias("n_modifier"), (of(negative) > 0).cast("int").alias("n_negative"), (of((pos == "助動詞") & (base == PAST)) > 0).cast("int").alias("n_past"),
        F.greatest(F.count("*") - 1, F.lit(0)).alias("n_pairs"),
    )
    sums = per.groupBy(*article).agg(F.count("*").alias("n_filled"), *(F.sum(k).alias(k) for k in per.columns if k.startswith("n_")))
    n = sentences.groupBy(*article).agg(F.count("*").alias("n_sents"))
    starts = paragraph_starts(tokens, sentences, article).groupBy(*article).agg(F.count("*").alias("n_starts"), of(pos == "接続詞").alias("n_start_conj"))
    commas = before_commas(tokens, article).groupBy(*article).agg(F.count("*").alias("n_commas"))
    masked = tokens.groupBy(*article).agg(of(F.col("masked")).alias("n_masked_tokens"))
    out = n.join(sums, article, "left").join(starts, article, "left").join(commas, article, "left").join(masked, article, "left")
    return out.select(*article, *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in out.columns if k not in article))


def channel_scalars(tokens: DataFrame, sentences: DataFrame, article: list[str]) -> DataFrame:
    """article and the 11 part-of-speech scalars; null where the denominator is 0, never 0 for unavailable."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    top = content_tokens(tokens).where(is_first_person()).groupBy(*article, "base").agg(F.count("*").alias("n")).groupBy(*article).agg(F.max("n").alias("n_top"))
    n = token_counts(tokens, sentences, article).join(top, article, "left").join(longest_suffix_run(tokens, sentences, article), article, "left")
    return n.select(
        *article, share("n_formal", "n_tokens").alias("formal_noun_rate"), share("n_demo", "n_tokens").alias("demonstrative_rate"), share("n_first", "n_tokens").alias("first_person_rate"),
        share("n_top", "n_first").alias("first_person_top_share"), share("n_conj", "n_sents").alias("conj_rate"), share("n_start_conj", "n_starts").alias("para_initial_conj_rate"),
        F.when(F.col("n_tokens") > 0, share("n_verb", "n_noun")).alias("verb_noun_ratio"), share("n_modifier", "n_tokens").alias("modifier_density"), share("n_negative", "n_sents").alias("negative_rate"),
        share("n_past", "n_sents").alias("past_rate"), "max_consecutive_same_suffix2",
    )


def sample_sizes(tokens: DataFrame, sentences: DataFrame, article: list[str]) -> DataFrame:
    """article, channel, sample: what each part-of-speech channel rests on; those of sequences are estimates from totals."""
    n = token_counts(tokens, sentences, article)
    c = F.col
    at_least = lambda x: F.greatest(x, F.lit(0))
    sizes = {
        "pos_unigram": c("n_tokens"), "pos_bigram": at_least(c("n_tokens") - c("n_sents")), "pos_trigram": at_least(c("n_tokens") - 2 * c("n_sents")),
        "particle_bigram": at_least(c("n_particles") - c("n_sents")), "funcword_bigram": c("n_func_pairs"), "aux_lemma": c("n_aux"), "final_suffix2": c("n_filled"), "final_suffix3": c("n_filled"),
        "final_pos_cform": c("n_filled"), "content_masked_lemma_bigram": c("n_pairs"), "formal_noun": c("n_formal"), "conj_lemma": c("n_conj"), "para_initial_pos": c("n_starts"),
        "para_initial_conj": c("n_start_conj"), "pre_comma_pos": c("n_commas"), "pre_comma_lemma": c("n_commas"), "first_person_lemma": c("n_first"), "formal_noun_rate": c("n_tokens"),
        "demonstrative_rate": c("n_tokens"), "first_person_rate": c("n_tokens"), "first_person_top_share": c("n_first"), "conj_rate": c("n_sents"), "para_initial_conj_rate": c("n_starts"),
        "verb_noun_ratio": c("n_tokens"), "modifier_density": c("n_tokens"), "negative_rate": c("n_sents"), "past_rate": c("n_sents"), "max_consecutive_same_suffix2": c("n_sents"),
    }
    return n.select(*article, *(v.alias(k) for k, v in sizes.items())).unpivot(article, list(sizes), "channel", "sample")


def sampled(values: DataFrame, samples: DataFrame, channels: DataFrame, article: list[str]) -> DataFrame:
    """values(article, channel, ...) whose channel's sample is large enough: the others take no part in calibration."""
    enough = samples.join(F.broadcast(channels.select("channel", "min_sample")), "channel").where("sample >= min_sample").select(*article, "channel")
    return values.join(enough, [*article, "channel"], "left_semi")


def whole_stream(tokens: DataFrame, article: list[str]) -> DataFrame:
    """article, feature, key, n, p: particle and part-of-speech bigrams and auxiliaries over the whole article.

    Unlike the channels of these names, pairs go across the ends of sentences.
    """
    w = Window.partitionBy(*article).orderBy("sent_idx", "tok_idx")
    c = content_tokens(tokens)

    def pairs(rows: DataFrame, key: str, feature: str) -> DataFrame:
        both = rows.select(*article, F.col(key).alias("_a"), F.lead(key).over(w).alias("_b")).where("_b is not null")
        return both.select(*article, F.lit(feature).alias("feature"), F.concat_ws("|", "_a", "_b").alias("key"))

    aux = c.where(F.col("pos") == "助動詞").select(*article, F.lit("aux_verb_dist").alias("feature"), F.col("base").alias("key"))
    rows = pairs(c.where(F.col("pos") == "助詞"), "base", "particle_bigram").unionByName(pairs(c, "pos", "pos_bigram")).unionByName(aux)
    counts = rows.groupBy(*article, "feature", "key").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*article, "feature")))


def vocabulary(tokens: DataFrame, article: list[str]) -> DataFrame:
    """article, func_word_rate, distinct_2: shares of function words among content tokens, of different ones among bigrams of surfaces."""
    c = content_tokens(tokens)
    rate = c.groupBy(*article).agg(F.avg(F.col("pos").isin(*FUNCTION).cast("int")).alias("func_word_rate"))
    w = Window.partitionBy(*article).orderBy("sent_idx", "tok_idx")
    pairs = c.select(*article, F.col("surface").alias("_a"), F.lead("surface").over(w).alias("_b")).where("_b is not null")
    counted = pairs.groupBy(*article, "_a", "_b").agg(F.count("*").alias("n")).groupBy(*article).agg((F.count("*") / F.sum("n")).alias("distinct_2"))
    return rate.join(counted, article, "left")
