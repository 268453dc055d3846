"""Queries of the channels over tokens that rules cut from ``segments``, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions import text as T
from ..operators import channels, features, tokens
from .queries import _r, query


def _sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _case(at: int) -> str:
    other = "CASE WHEN regexp_full_match(surface, '[ぁ-ゟ]') THEN '動詞' ELSE '名詞' END" if at == 0 else "'普通名詞'"
    return "CASE " + " ".join(f"WHEN surface IN {_sql_list(row[2].split())} THEN '{row[at]}'" for row in tokens.RULE_WORDS) + f" ELSE {other} END"


_FUNCTIONAL = f"(pos IN {_sql_list(tokens.CLOSED)} OR (pos = '名詞' AND base IN {_sql_list(tokens.FORMAL_NOUNS)}))"
_FORMAL = f"((pos = '名詞' AND base IN {_sql_list(tokens.FORMAL_NOUNS)}) OR (pos = '助詞' AND pos_detail = '準体助詞' AND base = 'の'))"
_FIRST = f"(base IN {_sql_list(tokens.FIRST_PERSON)} AND pos IN ('代名詞', '名詞'))"
_DEMO = f"(base IN {_sql_list(channels.DEMONSTRATIVES)} AND pos IN {_sql_list(channels.DEMONSTRATIVE_POS)})"
_SKIP = _sql_list(tokens.SKIPPED)
_SENT = f"""segs AS (SELECT article_id, block_index AS para, max(text) AS text FROM segments WHERE text IS NOT NULL AND article_id IS NOT NULL GROUP BY 1, 2),
  rs AS (SELECT article_id, para, regexp_extract_all(text, '{T.SENTENCE}') AS s FROM segs),
  ss AS (SELECT article_id, para, para * 100000 + i - 1 AS sent_idx, regexp_replace(s[i], '{T.SPACE}+$', '') AS sentence FROM rs, LATERAL (SELECT UNNEST(range(1, len(s) + 1)) AS i) r)"""
_TOK = f"""{_SENT},
  tk AS (SELECT article_id, para, sent_idx, regexp_extract_all(sentence, '{tokens.RULE_TOKEN}') AS t FROM ss),
  tx AS (SELECT article_id, para, sent_idx, i AS tok_idx, t[i] AS surface, t[i] AS base FROM tk, LATERAL (SELECT UNNEST(range(1, len(t) + 1)) AS i) r),
  tok AS (SELECT *, {_case(0)} AS pos, {_case(1)} AS pos_detail, surface = '識別子' AS masked FROM tx),
  lem AS (SELECT *, CASE WHEN {_FUNCTIONAL} THEN base ELSE pos END AS ml FROM tok),
  c AS (SELECT * FROM lem WHERE pos NOT IN {_SKIP} AND NOT masked),
  lst AS (SELECT *, row_number() OVER (PARTITION BY article_id, sent_idx ORDER BY tok_idx DESC) AS r FROM c),
  ends AS (SELECT article_id, sent_idx, string_agg(ml, '|' ORDER BY tok_idx) FILTER (r <= 2) AS suffix2, string_agg(ml, '|' ORDER BY tok_idx) FILTER (r <= 3) AS suffix3 FROM lst GROUP BY 1, 2),
  pc AS (SELECT article_id, pos_detail, pos AS own, last_value(CASE WHEN pos NOT IN {_SKIP} THEN pos END IGNORE NULLS) OVER w AS pos, last_value(CASE WHEN pos NOT IN {_SKIP} THEN ml END IGNORE NULLS) OVER w AS lemma
    FROM lem WHERE NOT masked WINDOW w AS (PARTITION BY article_id, sent_idx ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  commas AS (SELECT article_id, pos, lemma FROM pc WHERE own = '補助記号' AND pos_detail = '読点' AND pos IS NOT NULL),
  starts AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY article_id, para ORDER BY sent_idx, tok_idx) = 1)"""


def _gram(channel: str, key: str, n: int, where: str = "true") -> str:
    parts = " || '|' || ".join([key, *(f"lead({key}, {i}) OVER w" for i in range(1, n))])
    return f"SELECT * FROM (SELECT article_id, '{channel}' AS channel, {parts} AS key FROM c WHERE {where} WINDOW w AS (PARTITION BY article_id, sent_idx ORDER BY tok_idx)) WHERE key IS NOT NULL"


_KEYS = " UNION ALL ".join(
    [
        "SELECT article_id, 'pos_unigram' AS channel, pos AS key FROM c",
        _gram("pos_bigram", "pos", 2),
        _gram("pos_trigram", "pos", 3),
        _gram("particle_bigram", "base", 2, "pos = '助詞'"),
        _gram("funcword_bigram", "base", 2, f"pos IN {_sql_list(tokens.FUNCTION)}"),
        "SELECT article_id, 'aux_lemma', base FROM c WHERE pos = '助動詞'",
        "SELECT article_id, 'final_suffix2', suffix2 FROM ends",
        "SELECT article_id, 'final_suffix3', suffix3 FROM ends",
        "SELECT article_id, 'final_pos_cform', pos || '|*' FROM lst WHERE r = 1",
        _gram("content_masked_lemma_bigram", "ml", 2),
        f"SELECT article_id, 'formal_noun', base FROM c WHERE {_FORMAL}",
        "SELECT article_id, 'conj_lemma', base FROM c WHERE pos = '接続詞'",
        "SELECT article_id, 'para_initial_pos', pos FROM starts",
        "SELECT article_id, 'para_initial_conj', base FROM starts WHERE pos = '接続詞'",
        "SELECT article_id, 'pre_comma_pos', pos FROM commas",
        "SELECT article_id, 'pre_comma_lemma', lemma FROM commas",
        f"SELECT article_id, 'first_person_lemma', base FROM c WHERE {_FIRST}",
    ]
)


def _token_table(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Tokens and sentences of segments; read several times by the channels, so they are written once."""
    s = runtime.table(spark, folder, "segments").where("text is not null and article_id is not null").groupBy("article_id", "block_index").agg(F.max("text").alias("text"))
    rows = features.sentence_rows(s, ["article_id", "block_index"]).select("article_id", F.col("block_index").alias("para"), (F.col("block_index") * 100000 + F.col("pos")).alias("sent_idx"), "sentence")
    sentences = runtime.materialize(rows, "sentences")
    return runtime.materialize(tokens.rule_tokens(sentences, ["article_id"]), "tokens"), sentences


@query(f"WITH {_TOK}, k AS ({_KEYS}) SELECT article_id, channel, key, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY article_id, channel), 6) AS p FROM k GROUP BY 1, 2, 3")
def token_channels(spark, folder):
    return _r(channels.channel_distributions(*_token_table(spark, folder), ["article_id"]))


_N = f"""per AS (SELECT article_id, sent_idx, count(*) AS n, count(*) FILTER (pos = '助詞') AS part, greatest(count(*) FILTER (pos IN {_sql_list(tokens.FUNCTION)}) - 1, 0) AS fp, count(*) FILTER (pos = '助動詞') AS aux,
  count(*) FILTER {f'({_FORMAL})'} AS formal, count(*) FILTER ({_DEMO}) AS demo, count(*) FILTER ({_FIRST}) AS fst, count(*) FILTER (pos = '接続詞') AS conj, count(*) FILTER (pos = '動詞') AS verb, count(*) FILTER (pos = '名詞') AS noun,
  count(*) FILTER (pos IN {_sql_list(channels.MODIFIERS)}) AS mods, CAST(count(*) FILTER ((pos = '助動詞' AND base IN {_sql_list(channels.NEGATIONS)}) OR (pos = '形容詞' AND base = 'ない')) > 0 AS INT) AS neg, CAST(count(*) FILTER (pos = '助動詞' AND base = 'た') > 0 AS INT) AS past FROM c GROUP BY 1, 2),
  sm AS (SELECT article_id, count(*) AS filled, sum(n) AS n, sum(part) AS part, sum(fp) AS fp, sum(aux) AS aux, sum(formal) AS formal, sum(demo) AS demo, sum(fst) AS fst, sum(conj) AS conj, sum(verb) AS verb, sum(noun) AS noun, sum(mods) AS mods, sum(neg) AS neg, sum(past) AS past, sum(n - 1) AS pairs FROM per GROUP BY 1),
  ns AS (SELECT article_id, count(*) AS sents FROM ss GROUP BY 1), st AS (SELECT article_id, count(*) AS starts, count(*) FILTER (pos = '接続詞') AS sconj FROM starts GROUP BY 1), cm AS (SELECT article_id, count(*) AS commas FROM commas GROUP BY 1),
  al AS (SELECT ns.article_id, sents, """ + ", ".join(f"coalesce({k}, 0) AS {k}" for k in "filled n part fp aux formal demo fst conj verb noun mods neg past pairs starts sconj commas".split()) + " FROM ns LEFT JOIN sm USING (article_id) LEFT JOIN st USING (article_id) LEFT JOIN cm USING (article_id))"
_SHARES = {
    "formal_noun_rate": "formal / nullif(n, 0)", "demonstrative_rate": "demo / nullif(n, 0)", "first_person_rate": "fst / nullif(n, 0)", "first_person_top_share": "top / nullif(fst, 0)", "conj_rate": "conj / nullif(sents, 0)",
    "para_initial_conj_rate": "sconj / nullif(starts, 0)", "verb_noun_ratio": "verb / nullif(noun, 0)", "modifier_density": "mods / nullif(n, 0)", "negative_rate": "neg / nullif(sents, 0)", "past_rate": "past / nullif(sents, 0)",
}
_RUNS = """sq AS (SELECT ss.article_id, ss.sent_idx, suffix2 FROM ss LEFT JOIN ends ON ends.article_id = ss.article_id AND ends.sent_idx = ss.sent_idx),
  il AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY sent_idx) - row_number() OVER (PARTITION BY article_id, suffix2 ORDER BY sent_idx) AS g FROM sq),
  rn AS (SELECT article_id, CASE WHEN suffix2 IS NULL THEN 0 ELSE count(*) END AS n FROM il GROUP BY article_id, suffix2, g), mr AS (SELECT article_id, CAST(max(n) AS DOUBLE) AS max_consecutive_same_suffix2 FROM rn GROUP BY 1)"""


@query(
    f"WITH {_TOK}, {_N}, {_RUNS}, tp AS (SELECT article_id, max(k) AS top FROM (SELECT article_id, base, count(*) AS k FROM c WHERE {_FIRST} GROUP BY 1, 2) GROUP BY 1) SELECT al.article_id, "
    + ", ".join(f"round({v}, 6) AS {k}" for k, v in _SHARES.items()) + ", max_consecutive_same_suffix2 FROM al LEFT JOIN tp USING (article_id) LEFT JOIN mr USING (article_id)"
)
def token_scalars(spark, folder):
    return _r(channels.channel_scalars(*_token_table(spark, folder), ["article_id"]))


_SAMPLES = {
    "pos_unigram": "n", "pos_bigram": "greatest(n - sents, 0)", "pos_trigram": "greatest(n - 2 * sents, 0)", "particle_bigram": "greatest(part - sents, 0)", "funcword_bigram": "fp", "aux_lemma": "aux",
    "final_suffix2": "filled", "final_suffix3": "filled", "final_pos_cform": "filled", "content_masked_lemma_bigram": "pairs", "formal_noun": "formal", "conj_lemma": "conj", "para_initial_pos": "starts", "para_initial_conj": "sconj",
    "pre_comma_pos": "commas", "pre_comma_lemma": "commas", "first_person_lemma": "fst", "formal_noun_rate": "n", "demonstrative_rate": "n", "first_person_rate": "n", "first_person_top_share": "fst", "conj_rate": "sents",
    "para_initial_conj_rate": "starts", "verb_noun_ratio": "n", "modifier_density": "n", "negative_rate": "sents", "past_rate": "sents", "max_consecutive_same_suffix2": "sents",
}


@query(f"WITH {_TOK}, {_N} " + " UNION ALL ".join(f"SELECT article_id, '{k}' AS channel, CAST({v} AS BIGINT) AS sample FROM al" for k, v in _SAMPLES.items()))
def channel_samples(spark, folder):
    return channels.sample_sizes(*_token_table(spark, folder), ["article_id"])


_LEAST = "(VALUES " + ", ".join(f"('{c}', {n})" for c, _, _, _, _, n in channels.CHANNELS) + ") v(channel, least)"


@query(
    f"WITH {_TOK}, {_N}, k AS ({_KEYS}), sm2 AS (" + " UNION ALL ".join(f"SELECT article_id, '{k}' AS channel, {v} AS sample FROM al" for k, v in _SAMPLES.items())
    + f") SELECT channel, count(DISTINCT article_id) AS articles, count(*) AS occurrences FROM k JOIN sm2 USING (article_id, channel) JOIN {_LEAST} USING (channel) WHERE sample >= least GROUP BY channel"
)
def sampled_channels(spark, folder):
    tok, sentences = _token_table(spark, folder)
    rows = channels.sampled(channels.channel_keys(tok, sentences, ["article_id"]), channels.sample_sizes(tok, sentences, ["article_id"]), channels.registry(spark), ["article_id"])
    return rows.groupBy("channel").agg(F.count_distinct("article_id").alias("articles"), F.count("*").alias("occurrences"))


def _stream(feature: str, key: str, where: str) -> str:
    pair = f"{key} || '|' || lead({key}) OVER (PARTITION BY article_id ORDER BY sent_idx, tok_idx)"
    return f"SELECT * FROM (SELECT article_id, '{feature}' AS feature, {pair} AS key FROM c WHERE {where}) WHERE key IS NOT NULL"


@query(
    f"WITH {_TOK}, k AS ({_stream('particle_bigram', 'base', chr(112) + 'os = ' + repr('助詞'))} UNION ALL {_stream('pos_bigram', 'pos', 'true')} UNION ALL SELECT article_id, 'aux_verb_dist', base FROM c WHERE pos = '助動詞') "
    "SELECT article_id, feature, key, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY article_id, feature), 6) AS p FROM k GROUP BY 1, 2, 3"
)
def whole_stream_features(spark, folder):
    return _r(channels.whole_stream(_token_table(spark, folder)[0], ["article_id"]))


@query(
    f"""WITH {_TOK}, r AS (SELECT article_id, round(avg(CASE WHEN pos IN {_sql_list(tokens.FUNCTION)} THEN 1 ELSE 0 END), 6) AS func_word_rate FROM c GROUP BY 1),
  b AS (SELECT article_id, surface AS x, lead(surface) OVER (PARTITION BY article_id ORDER BY sent_idx, tok_idx) AS y FROM c), d AS (SELECT article_id, round(count(DISTINCT (x, y)) / count(*), 6) AS distinct_2 FROM b WHERE y IS NOT NULL GROUP BY 1)
  SELECT article_id, func_word_rate, distinct_2 FROM r LEFT JOIN d USING (article_id)"""
)
def token_vocabulary(spark, folder):
    return _r(channels.vocabulary(_token_table(spark, folder)[0], ["article_id"]))


@query(
    f"""WITH {_TOK}, s AS (SELECT article_id, surface, row_number() OVER (PARTITION BY article_id ORDER BY sent_idx, tok_idx) - 1 AS i, count(*) OVER (PARTITION BY article_id) AS n FROM c),
  w AS (SELECT DISTINCT article_id, n, UNNEST(range(0, CASE WHEN n <= 100 THEN 1 ELSE (n - 100) // 50 + 1 END)) AS w FROM s),
  t AS (SELECT w.article_id, w.w, count(DISTINCT surface) / count(*) AS ttr FROM w JOIN s ON s.article_id = w.article_id AND s.i >= w.w * 50 AND (w.n <= 100 OR s.i < w.w * 50 + 100) GROUP BY 1, 2) SELECT article_id, round(avg(ttr), 6) AS ttr_window FROM t GROUP BY 1"""
)
def token_windows(spark, folder):
    from pyspark.sql import Window

    c = channels.content_tokens(_token_table(spark, folder)[0])
    at = F.row_number().over(Window.partitionBy("article_id").orderBy("sent_idx", "tok_idx")) - 1
    return _r(features.distinct_windows(c.select("article_id", "surface", at.alias("tok_idx")), ["article_id"]))
