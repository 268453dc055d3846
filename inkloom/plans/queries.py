"""Registry of the queries of the library's own operators and the SQL that gives the same rows.

Authors are ``source`` in documents and ``author_id`` elsewhere. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..functions import stats as S
from ..functions import text as T
from ..operators import blocks, corpus, distributions, evaluation, features, ngrams, overlap, stats
from ..sources import corpus as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as two engines differ in last bits."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return runtime.table(spark, folder, "documents").select("doc_id", "text").where("doc_id is not null and text is not null").distinct()


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct feature rows as flat scalars, one row an article and author."""
    f = runtime.table(spark, folder, "features")
    form, ratio = (lambda k: F.col("sent_end_form")[k]), (lambda k: F.col("script_ratio")[k])
    return f.select(
        "author_id", "article_id", "n_sents", "n_chars", F.col("sent_len.median").alias("sent_len_median"), F.col("sent_len.max").alias("sent_len_max"), F.col("para_len.median").alias("para_len_median"),
        F.col("comma_per_sent.median").alias("comma_median"), F.col("max_consecutive_same_ending").alias("longest_run"), *(form(k).alias(k) for k in T.ENDINGS), *(ratio(k).alias(f"script_{k}") for k in (*T.SCRIPTS, "other")),
    ).distinct()


_S = T.SPACE
_RECORDS = (
    "SELECT DISTINCT author_id, article_id, n_sents, n_chars, sent_len.median AS sent_len_median, sent_len.max AS sent_len_max, para_len.median AS para_len_median, "
    "comma_per_sent.median AS comma_median, max_consecutive_same_ending AS longest_run, "
    + ", ".join(f"sent_end_form['{k}'] AS {k}" for k in T.ENDINGS) + ", " + ", ".join(f"script_ratio['{k}'] AS script_{k}" for k in (*T.SCRIPTS, "other"))
    + " FROM features"
)
_DOCS = "SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"
_SENTS = f"""
  docs AS ({_DOCS}),
  raw AS (SELECT doc_id, regexp_extract_all(text, '{T.SENTENCE}') AS s FROM docs),
  sents AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, regexp_replace(s[i], '{_S}+$', '') AS sentence FROM raw, LATERAL (SELECT UNNEST(range(1, len(s) + 1)) AS i) r)"""
_CORE = f"regexp_replace(sentence, '{T.CORE_STRIP}', '')"
_CLASS = f"""CASE WHEN {_CORE} = '' THEN 'other'
  WHEN regexp_matches(regexp_replace(sentence, '{T.QUESTION_STRIP}', ''), '[？?]$') OR regexp_matches({_CORE}, 'か$') THEN 'question'
  WHEN regexp_matches({_CORE}, '{T.DESU_MASU}') THEN 'desu_masu' WHEN regexp_matches({_CORE}, '{T.DA_DEARU}') THEN 'da_dearu'
  WHEN regexp_matches({_CORE}, '{T.JOTAI_VERB}') THEN 'jotai_verb' WHEN regexp_matches({_CORE}, '{T.JOTAI_ADJ}') THEN 'jotai_adj'
  WHEN regexp_matches({_CORE}, '{T.TAIGEN}') THEN 'taigen' ELSE 'other' END"""
_CLS = _SENTS + f", cls AS (SELECT doc_id, pos, {_CLASS} AS cls FROM sents)"


def _q(x: str, q: float) -> str:
    return f"quantile_cont({x}, {q})"


# ---- sentences and article features ----


@query(f"WITH {_SENTS} SELECT doc_id, pos, sentence FROM sents")
def sentence_split(spark, folder):
    return features.sentence_rows(_documents(spark, folder), ["doc_id"])


@query(f"WITH {_CLS} SELECT doc_id, pos, cls FROM cls")
def sentence_end_class(spark, folder):
    rows = features.sentence_rows(_documents(spark, folder), ["doc_id"])
    return rows.select("doc_id", "pos", T.sentence_end_class(F.col("sentence")).alias("cls"))


@query(f"WITH {_CLS} SELECT doc_id, " + ", ".join(f"round(avg(CASE WHEN cls = '{c}' THEN 1 ELSE 0 END), 6) AS {c}" for c in T.ENDINGS) + " FROM cls GROUP BY doc_id")
def sentence_end_dist(spark, folder):
    return _r(features.ending_shares(features.sentence_rows(_documents(spark, folder), ["doc_id"]), ["doc_id"]))


@query(
    f"WITH {_SENTS} SELECT doc_id, count(*) AS n_sents, {_q('length(sentence)', .5)} AS sent_len_median, round({_q('length(sentence)', .25)}, 6) AS sent_len_q1, "
    f"round({_q('length(sentence)', .75)}, 6) AS sent_len_q3, CAST(max(length(sentence)) AS INT) AS sent_len_max FROM sents GROUP BY doc_id"
)
def sent_len_stats(spark, folder):
    return _r(features.sentence_lengths(features.sentence_rows(_documents(spark, folder), ["doc_id"]), ["doc_id"]))


_COMMAS = "len(regexp_extract_all(sentence, '[、，]'))"


@query(f"WITH {_SENTS} SELECT doc_id, {_q(_COMMAS, .5)} AS comma_median, round({_q(_COMMAS, .25)}, 6) AS comma_q1, round({_q(_COMMAS, .75)}, 6) AS comma_q3 FROM sents GROUP BY doc_id")
def comma_stats(spark, folder):
    return _r(features.comma_stats(features.sentence_rows(_documents(spark, folder), ["doc_id"]), ["doc_id"]))


def _count(p: str, x: str = "text") -> str:
    return f"len(regexp_extract_all({x}, '{p}'))"


_NS = f"length(regexp_replace(text, '{_S}+', '', 'g'))"


@query(
    f"WITH docs AS ({_DOCS}) SELECT doc_id, "
    + ", ".join(f"CASE WHEN {_NS} = 0 THEN 0.0 ELSE round({_count(p)} / {_NS}, 6) END AS {k}" for k, p in T.SCRIPTS.items())
    + f", CASE WHEN {_NS} = 0 THEN 0.0 ELSE round(({_NS} - " + " - ".join(_count(p) for p in T.SCRIPTS.values()) + f") / {_NS}, 6) END AS other FROM docs"
)
def script_ratio(spark, folder):
    return _r(features.script_ratio(_documents(spark, folder), ["doc_id"]))


@query(
    f"""WITH {_CLS}, isl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, cls ORDER BY pos) AS island FROM cls),
  runs AS (SELECT doc_id, cls, count(*) AS run, min(pos) AS first_pos, max(pos) AS last_pos FROM isl GROUP BY doc_id, cls, island)
  SELECT doc_id, run, cls, first_pos, last_pos FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY run DESC, first_pos) = 1"""
)
def longest_ending_run(spark, folder):
    return features.longest_run(features.sentence_rows(_documents(spark, folder), ["doc_id"]), ["doc_id"])


_HEDGED = "|".join(T.HEDGES.values())


@query(
    f"""WITH {_SENTS} SELECT doc_id, round(avg(CASE WHEN regexp_matches(sentence, '{_HEDGED}') THEN 1 ELSE 0 END), 6) AS hedge_rate,
  round(avg(CASE WHEN regexp_matches(sentence, '{"|".join(T.HEDGES[k] for k in T.SPECULATIVE)}') THEN 1 ELSE 0 END), 6) AS speculative_rate,
  round(avg(CASE WHEN regexp_matches(sentence, '{T.QUOTE}') THEN 1 ELSE 0 END), 6) AS quote_sentence_rate FROM sents GROUP BY doc_id"""
)
def surface_channels(spark, folder):
    return _r(features.hedge_stats(features.sentence_rows(_documents(spark, folder), ["doc_id"]), ["doc_id"]))


@query(
    "WITH " + _SENTS + ", h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key FROM sents WHERE regexp_matches(sentence, '{p}')" for k, p in T.HEDGES.items())
    + ") SELECT doc_id, key, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 6) AS p FROM h GROUP BY doc_id, key"
)
def hedge_class_dist(spark, folder):
    return _r(features.hedge_distribution(features.sentence_rows(_documents(spark, folder), ["doc_id"]), ["doc_id"]))


@query(
    f"""WITH {_SENTS}, c AS (SELECT doc_id, {_CORE} AS core FROM sents WHERE length({_CORE}) > 1),
  p AS (SELECT doc_id, (i - 1) / length(core) AS position FROM c, LATERAL (SELECT UNNEST(range(1, length(core) + 1)) AS i) r WHERE substring(core, CAST(i AS INT), 1) IN ('、', '，'))
  SELECT doc_id, count(*) AS n_commas, """
    + ", ".join(f"round(avg(CASE WHEN least(floor(position * 4), 3) = {i} THEN 1 ELSE 0 END), 6) AS q{i + 1}" for i in range(4))
    + ", round(list_sort(list(position))[CAST(floor(count(*) / 2) AS INT) + 1], 6) AS median_position FROM p GROUP BY doc_id"
)
def comma_position_stats(spark, folder):
    return _r(features.comma_position_stats(features.sentence_rows(_documents(spark, folder), ["doc_id"]), ["doc_id"]))


_SEGS = "SELECT DISTINCT author_id, article_id, block_index, text FROM segments"


@query(
    f"""WITH s AS ({_SEGS}), per AS (SELECT article_id, len(regexp_extract_all(text, '{T.SENTENCE}')) AS n FROM s)
  SELECT article_id, count(*) AS n_paras, {_q('n', .5)} AS para_len_median, round({_q('n', .25)}, 6) AS para_len_q1, round({_q('n', .75)}, 6) AS para_len_q3 FROM per WHERE n > 0 GROUP BY article_id"""
)
def para_len_stats(spark, folder):
    segments = runtime.table(spark, folder, "segments").select("author_id", "article_id", "block_index", "text").distinct()
    return _r(features.paragraph_lengths(segments, ["article_id"]))


@query("""SELECT article_id, block_index, out_text FROM (SELECT DISTINCT article_id, block_index, text, masked FROM segments), LATERAL (SELECT
  list_aggregate(list_transform(range(0, len(masked) + 1), lambda i: substring(text, CASE WHEN i = 0 THEN 1 ELSE masked[i].e + 1 END, (CASE WHEN i = len(masked) THEN length(text) ELSE masked[i + 1].s END) - (CASE WHEN i = 0 THEN 0 ELSE masked[i].e END))), 'string_agg', '') AS out_text) x""")
def unmasked_text(spark, folder):
    s = runtime.table(spark, folder, "segments").select("article_id", "block_index", "text", "masked").distinct()
    return s.select("article_id", "block_index", T.unmasked(F.col("text"), F.col("masked")).alias("out_text"))


_RAW = "list_filter(raw_map, lambda m: m.out <= {o})"


def _raw_at(o: str) -> str:
    e = f"coalesce(list_extract({_RAW.format(o=o)}, -1), raw_map[1])"
    return f"coalesce(({e}).raw + CASE WHEN ({e}).len > 0 THEN least({o} - ({e}).out, ({e}).len) ELSE 0 END, char_start)"


@query(
    f"""WITH s AS (SELECT DISTINCT article_id, block_index, text, char_start, raw_map FROM segments WHERE text IS NOT NULL), x AS (SELECT *, regexp_extract_all(text, '{T.SENTENCE}') AS pieces, string_split_regex(text, '{T.SENTENCE}') AS gaps FROM s),
  y AS (SELECT article_id, block_index, char_start, raw_map, pieces, gaps, UNNEST(range(1, len(pieces) + 1)) AS i FROM x),
  z AS (SELECT article_id, block_index, char_start, raw_map, CAST(i - 1 AS INT) AS pos, list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(pieces[:i - 1], lambda p: length(p))), 0) AS a,
  length(regexp_replace(pieces[i], '{_S}+$', '')) AS n FROM y)
  SELECT DISTINCT article_id, block_index, pos, CAST(a AS INT) AS prose_start, CAST(a + n AS INT) AS prose_end, CAST({_raw_at('a')} AS INT) AS raw_start, CAST(greatest({_raw_at('(a + n - 1)')} + 1, {_raw_at('a')}) AS INT) AS raw_end FROM z"""
)
def sentence_spans(spark, folder):
    s = runtime.table(spark, folder, "segments").where("text is not null").select("article_id", "block_index", "text", "char_start", "raw_map", "masked").distinct()
    rows = features.built_sentences(s, ["article_id", "block_index"])
    return rows.select("article_id", "block_index", "pos", F.col("prose_span.s").alias("prose_start"), F.col("prose_span.e").alias("prose_end"), F.col("raw_span.s").alias("raw_start"), F.col("raw_span.e").alias("raw_end")).distinct()


# ---- predicates over documents and the manifest ----


@query("SELECT doc_id, sha256(text) AS content_hash FROM (" + _DOCS + ")")
def content_hash(spark, folder):
    return _documents(spark, folder).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS cluster FROM (" + _DOCS + ") QUALIFY count(*) OVER (PARTITION BY text) > 1")
def exact_dup_clusters(spark, folder):
    d = _documents(spark, folder).withColumn("h", T.content_hash(F.col("text")))
    groups = d.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("cluster")).where("n > 1")
    return d.join(groups, "h").select("doc_id", "cluster")


#: Texts that hold one secret of each kind, scanned beside the documents, which hold none; negative ids.
_SAMPLES = ["AKIA" + "ABCD1234" * 2, "sk-" + "a1B2" * 6, "ghp_" + "Zz09" * 6, "xoxb-" + "1234567890", "-----BEGIN RSA PRIVATE KEY-----", "API_KEY = '" + "k3y-" * 5 + "'", "password: none", "sk-short"]
_SCANNED = f"{_DOCS} UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(_SAMPLES, 1)) + ") v(doc_id, text)"


@query("WITH docs AS (" + _SCANNED + ") " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM docs WHERE regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for k, p in T.SECRETS.items()))
def secret_scan(spark, folder):
    scanned = _documents(spark, folder).unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(_SAMPLES, 1)], "doc_id bigint, text string"))
    kinds = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), k) for k, p in T.SECRETS.items())))
    return scanned.select("doc_id", F.explode(kinds).alias("kind"))


@query(f"SELECT DISTINCT article_id, block_index, residue FROM (SELECT article_id, block_index, UNNEST(regexp_extract_all(text, '{T.PLACEHOLDER_RESIDUE}')) AS residue FROM segments WHERE text IS NOT NULL)")
def placeholder_residue(spark, folder):
    s = runtime.table(spark, folder, "segments").where("text is not null")
    return s.select("article_id", "block_index", F.explode(F.regexp_extract_all("text", F.lit(T.PLACEHOLDER_RESIDUE), F.lit(0))).alias("residue")).distinct()


@query(f"SELECT doc_id, length(regexp_replace(regexp_replace(text, '{T.URL}', ' ', 'g'), '{_S}+', '', 'g')) AS effective_length FROM ({_DOCS})")
def effective_length(spark, folder):
    return _documents(spark, folder).select("doc_id", T.effective_length(F.col("text")).alias("effective_length"))


@query(f"SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '…' ELSE text END AS excerpt FROM ({_DOCS})")
def excerpts(spark, folder):
    return _documents(spark, folder).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query(f"SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS lines, CAST(length(text) // 3 AS BIGINT) AS tokens, len(string_split(text, chr(10))) > 500 OR length(text) // 3 > 5000 AS over FROM ({_DOCS})")
def text_budget(spark, folder):
    lines, tokens_ = F.size(F.split("text", "\n", -1)), F.expr("length(text) div 3")
    return _documents(spark, folder).select("doc_id", lines.alias("lines"), tokens_.alias("tokens"), ((lines > 500) | (tokens_ > 5000)).alias("over"))


@query(f"SELECT DISTINCT article_id, regexp_replace(coalesce(regexp_extract(canonical_url, '([^/]*)$', 1), ''), '[^A-Za-z0-9_-]', '-', 'g') AS stem_id FROM manifest")
def article_id_from_stem(spark, folder):
    stem = F.coalesce(F.regexp_extract("canonical_url", "([^/]*)$", 1), F.lit(""))
    return runtime.table(spark, folder, "manifest").select("article_id", T.article_id_of(stem).alias("stem_id")).distinct()


_BODY = "coalesce(list_aggregate(list_transform(list_filter(blocks, lambda b: b.type = 'body'), lambda b: b.text), 'string_agg', chr(10)), '')"
_BODIES = f"SELECT DISTINCT article_id, {_BODY} AS body FROM clean WHERE blocks IS NOT NULL"


def _body_rows(spark, folder) -> DataFrame:
    """Bodies with repeated rows, for operators that compare equal texts once: no shuffle of all texts."""
    c = runtime.table(spark, folder, "clean").where("blocks is not null")
    return c.select("article_id", corpus.body_text(F.col("blocks")).alias("body"))


def _bodies(spark, folder) -> DataFrame:
    return _body_rows(spark, folder).distinct()


@query(f"SELECT article_id, length(body) AS n, sha256(body) AS h FROM ({_BODIES})")
def body_text(spark, folder):
    return _bodies(spark, folder).select("article_id", F.length("body").alias("n"), T.content_hash(F.col("body")).alias("h"))


def _lines(p: str) -> str:
    return f"CAST(len(list_filter(lines, lambda x: regexp_matches(x, '{p}'))) AS INT)"


@query(
    f"""WITH b AS ({_BODIES}), l AS (SELECT article_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{T.NONSPACE}')) AS lines,
  length(regexp_replace(body, '{_S}+', '', 'g')) AS body_chars, {_count('[A-Za-z]', 'body')} AS latin FROM b),
  c AS (SELECT *, CAST(len(lines) AS INT) AS body_lines, {_lines(corpus.CODE_LINE)} AS code_like_lines, {_lines(corpus.FENCE)} AS fences,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '{corpus.INDENTED}') AND NOT regexp_matches(x, '{corpus.NESTED_ITEM}'))) AS INT) AS indented FROM l),
  r AS (SELECT *, CASE WHEN body_lines > 0 THEN code_like_lines / body_lines ELSE 0.0 END AS cr, CASE WHEN body_chars > 0 THEN latin / body_chars ELSE 0.0 END AS lr FROM c)
  SELECT article_id, body_chars, body_lines, code_like_lines, round(cr, 4) AS code_like_line_ratio, round(lr, 4) AS latin_ratio,
  CASE WHEN body_chars = 0 OR fences > 0 OR indented > 0 OR (body_lines >= 10 AND cr >= 0.35) THEN 'fail' WHEN body_chars >= 500 AND lr >= 0.45 THEN 'warn' ELSE 'pass' END AS status FROM r"""
)
def block_health(spark, folder):
    return corpus.block_health(_bodies(spark, folder), "article_id")


@query(
    "SELECT DISTINCT article_id, problem FROM (SELECT article_id, UNNEST(list_filter(["
    + ", ".join(f"CASE WHEN {c} IS NULL THEN 'missing:{c}' END" for c in ("canonical_url", "license", "published_at"))
    + ", CASE WHEN status NOT IN ('eligible', 'quarantined', 'excluded') THEN 'domain:status' END], lambda x: x IS NOT NULL)) AS problem FROM manifest)"
)
def manifest_problems(spark, folder):
    return corpus.invalid_rows(runtime.table(spark, folder, "manifest"), "article_id", ["canonical_url", "license", "published_at"], {"status": corpus.STATUSES})


@query("SELECT DISTINCT article_id, retrieval_timestamp, CASE WHEN consent_record IS NOT NULL AND coalesce(block_health.status, 'pass') <> 'fail' THEN 'eligible' ELSE 'quarantined' END AS status FROM manifest")
def eligibility(spark, folder):
    m = runtime.table(spark, folder, "manifest")
    return m.select("article_id", "retrieval_timestamp", corpus.is_eligible(F.col("consent_record"), F.col("block_health.status")).alias("status")).distinct()


@query("SELECT DISTINCT article_id FROM manifest WHERE status = 'eligible' AND authorship = 'subject-authored' AND dup_of IS NULL AND article_id IN (SELECT article_id FROM splits WHERE split IN ('train', 'dev'))")
def profile_articles(spark, folder):
    return corpus.profile_articles(runtime.table(spark, folder, "manifest"), runtime.table(spark, folder, "splits")).select("article_id").distinct()


_COLS = "article_id, author_id, canonical_url, retrieval_timestamp, license, status"


@query(
    f"""WITH m AS (SELECT DISTINCT {_COLS} FROM manifest WHERE article_id IS NOT NULL AND retrieval_timestamp IS NOT NULL), o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY retrieval_timestamp, status, canonical_url, license) = 1),
  n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY retrieval_timestamp DESC, status, canonical_url, license) = 1)
  SELECT n.article_id, n.author_id, n.canonical_url, least(o.retrieval_timestamp, n.retrieval_timestamp) AS retrieval_timestamp, n.license, n.status FROM n JOIN o USING (article_id)"""
)
def manifest_upsert(spark, folder):
    # The first intake of each article is the stored manifest, the last one what comes in.
    from pyspark.sql import Window

    m = runtime.table(spark, folder, "manifest").select(*_COLS.split(", ")).where("article_id is not null and retrieval_timestamp is not null").distinct()
    pick = lambda order: m.withColumn("r", F.row_number().over(Window.partitionBy("article_id").orderBy(order, F.asc_nulls_last("status"), F.asc_nulls_last("canonical_url"), F.asc_nulls_last("license")))).where("r = 1").drop("r")
    return sources.merge_manifest(pick(F.col("retrieval_timestamp")), pick(F.desc("retrieval_timestamp")))


_FIRST = "SELECT article_id, min(author_id) AS author_id, min(coalesce(published_at, left(retrieval_timestamp, 10))) AS day FROM manifest WHERE status = 'eligible' GROUP BY article_id"


@query(
    f"""WITH m AS ({_FIRST}), n AS (SELECT *, count(*) OVER (PARTITION BY author_id) AS n, row_number() OVER (PARTITION BY author_id ORDER BY day, article_id) AS rn FROM m),
  c AS (SELECT *, CASE WHEN round_even(n * 15 / 100, 0) = 0 AND n >= 3 THEN 1 ELSE round_even(n * 15 / 100, 0) END AS k FROM n)
  SELECT author_id, article_id, CASE WHEN rn <= n - 2 * k THEN 'train' WHEN rn <= n - k THEN 'dev' ELSE 'holdout' END AS split FROM c"""
)
def chrono_split(spark, folder):
    m = runtime.table(spark, folder, "manifest").where("status = 'eligible'")
    day = F.coalesce("published_at", F.left("retrieval_timestamp", F.lit(10)))
    first = m.groupBy("article_id").agg(F.min("author_id").alias("author_id"), F.min(day).alias("day"))
    return corpus.chronological_split(first, "author_id", "article_id", F.col("day"))


# ---- n-grams and duplicates ----


def _grams(n: int, key: str, body: str, frm: str) -> str:
    t = f"regexp_replace({body}, '{_S}+', '', 'g')"
    return (
        f"SELECT DISTINCT {key}, CASE WHEN length(t) < {n} THEN t ELSE substring(t, CAST(i AS INT), {n}) END AS g FROM (SELECT {key}, {t} AS t FROM {frm}), "
        f"LATERAL (SELECT UNNEST(range(1, greatest(length(t) - {n - 1}, CASE WHEN t = '' THEN 0 ELSE 1 END) + 1)) AS i) r"
    )


@query(f"WITH b AS ({_BODIES}), g AS ({_grams(5, 'article_id', 'body', 'b')}) SELECT article_id, CAST(count(*) AS INT) AS n_grams FROM g GROUP BY article_id UNION ALL SELECT article_id, 0 FROM b WHERE regexp_replace(body, '{_S}+', '', 'g') = ''")
def char_ngram_counts(spark, folder):
    return ngrams.gram_counts(_bodies(spark, folder), "article_id", 5, "body")


_PAIRS = """n AS (SELECT article_id, count(*) AS n FROM g GROUP BY article_id),
  s AS (SELECT x.article_id AS a, y.article_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.article_id < y.article_id GROUP BY 1, 2),
  j AS (SELECT a, b, shared / (p.n + q.n - shared) AS jaccard FROM s JOIN n p ON p.article_id = a JOIN n q ON q.article_id = b)"""
_NEAR = f"b AS ({_BODIES}), g AS ({_grams(5, 'article_id', 'body', 'b')}), {_PAIRS}, near AS (SELECT * FROM j WHERE jaccard >= 0.8)"


def _near_clusters(spark, folder) -> DataFrame:
    return ngrams.components(ngrams.similar_edges(_body_rows(spark, folder), "article_id", 5, 0.8, "body"))


@query(f"WITH {_NEAR} SELECT a, b, round(jaccard, 6) AS jaccard FROM near")
def near_dup_pairs(spark, folder):
    return _r(ngrams.similar_pairs(_body_rows(spark, folder), "article_id", 5, 0.8, "body"))


_CLUSTERS = f"""WITH RECURSIVE {_NEAR}, e AS (SELECT a AS x, b AS y FROM near UNION SELECT b, a FROM near),
  r AS (SELECT x AS id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""


@query(f"{_CLUSTERS} SELECT id, root FROM c")
def near_dup_clusters(spark, folder):
    return _near_clusters(spark, folder)


@query(
    f"""{_CLUSTERS}, d AS (SELECT article_id, min(published_at) AS day FROM manifest GROUP BY article_id)
  SELECT root, id AS canonical FROM c LEFT JOIN d ON d.article_id = id QUALIFY row_number() OVER (PARTITION BY root ORDER BY coalesce(day, '9999-99-99'), id) = 1"""
)
def canonical_articles(spark, folder):
    days = runtime.table(spark, folder, "manifest").groupBy("article_id").agg(F.min("published_at").alias("day"))
    members = _near_clusters(spark, folder).join(days.withColumnRenamed("article_id", "id"), "id", "left")
    return ngrams.canonical(members, "root", "id", "day")


_LEAKS = f"""b AS ({_BODIES}), g AS ({_grams(8, 'article_id', 'body', 'b')}), {_PAIRS}, sp AS (SELECT DISTINCT article_id, split FROM splits),
  l AS (SELECT a, b, p.split AS split_a, q.split AS split_b, jaccard FROM j JOIN sp p ON p.article_id = a JOIN sp q ON q.article_id = b AND p.split <> q.split)"""


def _leaks(spark, folder) -> Callable[[float], DataFrame]:
    """Pairs above a limit."""
    return lambda t: ngrams.cross_pairs(_body_rows(spark, folder), runtime.table(spark, folder, "splits"), "article_id", "split", 8, t, "body")


@query(f"WITH {_LEAKS} SELECT a, b, split_a, split_b, round(jaccard, 4) AS jaccard FROM l WHERE jaccard > 0.3")
def leak_pairs(spark, folder):
    pairs = _leaks(spark, folder)(0.3)
    return _r(pairs.select("a", "b", F.col("side_a").alias("split_a"), F.col("side_b").alias("split_b"), "jaccard"), 4)


@query(f"WITH {_LEAKS} SELECT round(coalesce(max(jaccard), 0.0), 6) AS max_jaccard, count(*) FILTER (jaccard > 0.3) AS leaks, count(*) FILTER (jaccard > 0.3) = 0 AS passed FROM l")
def leak_summary(spark, folder):
    return _r(corpus.leak_summary(_leaks(spark, folder)))


_BENCH = f"""d AS ({_DOCS}), i AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL), gd AS ({_grams(5, 'doc_id', 'text', 'd')}), gi AS ({_grams(5, 'item_id', 'text', 'i')}),
  nd AS (SELECT doc_id, count(*) AS n FROM gd GROUP BY 1), ni AS (SELECT item_id, count(*) AS n FROM gi GROUP BY 1),
  s AS (SELECT doc_id, item_id, count(*) AS shared FROM gd JOIN gi USING (g) GROUP BY 1, 2)"""


def _items(spark, folder) -> DataFrame:
    return runtime.table(spark, folder, "benchmark").where("text is not null").select("item_id", "text").distinct()


@query(f"WITH {_BENCH} SELECT doc_id, item_id, round(shared / (nd.n + ni.n - shared), 4) AS jaccard FROM s JOIN nd USING (doc_id) JOIN ni USING (item_id)")
def benchmark_jaccard(spark, folder):
    return _r(ngrams.jaccard_pairs(_documents(spark, folder), _items(spark, folder), "doc_id", "item_id", 5), 4)


@query(f"WITH {_BENCH} SELECT item_id, doc_id AS source, round(shared / ni.n, 6) AS best FROM s JOIN ni USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared / ni.n DESC, doc_id) = 1")
def benchmark_containment(spark, folder):
    c = ngrams.containments(_items(spark, folder), _documents(spark, folder), "item_id", "doc_id", 5)
    return _r(ngrams.best_source(c, "item_id", "doc_id"))


@query()
def exact_match_spans(spark, folder):
    return overlap.exact_matches(_documents(spark, folder), _items(spark, folder), "doc_id", "item_id")


@query()
def minhash_similarity(spark, folder):
    return overlap.minhash_similarity(overlap.signatures(_documents(spark, folder), "doc_id"), overlap.signatures(_items(spark, folder), "item_id"), "doc_id", "item_id")


# ---- statistics of feature records by author ----


@query(
    f"SELECT author_id, count(*) AS n, {_q('sent_len_median', .5)} AS median, round({_q('sent_len_median', .25)}, 6) AS q1, round({_q('sent_len_median', .75)}, 6) AS q3, "
    f"min(sent_len_median) AS lo, max(sent_len_median) AS hi FROM ({_RECORDS}) WHERE sent_len_median IS NOT NULL GROUP BY author_id"
)
def author_scalar_summary(spark, folder):
    return _r(stats.summary(_records(spark, folder), ["author_id"], "sent_len_median"))


_LONG = ("n_sents", "n_chars", "sent_len_median", "sent_len_max", "para_len_median", "comma_median", "longest_run", *T.ENDINGS, *(f"script_{k}" for k in (*T.SCRIPTS, "other")))


@query(" UNION ALL ".join(f"SELECT author_id, article_id, '{c}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM ({_RECORDS}) WHERE {c} IS NOT NULL" for c in _LONG))
def metric_rows(spark, folder):
    return _r(evaluation.metric_rows(_records(spark, folder), ["author_id", "article_id"], _LONG))


@query(
    f"""SELECT DISTINCT author_id, article_id, UNNEST(['register:' || CASE WHEN desu_masu >= 0.5 THEN 'desu_masu' WHEN da_dearu + jotai_verb + jotai_adj >= 0.5 THEN 'jotai' ELSE 'mixed' END,
  'length:' || CASE WHEN n_chars < 800 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END]) AS slice FROM ({_RECORDS}) WHERE n_chars IS NOT NULL"""
)
def slice_keys(spark, folder):
    return evaluation.slices(_records(spark, folder).where("n_chars is not null"), ["author_id", "article_id"])


@query("SELECT DISTINCT article_id, nullif(regexp_extract(published_at, '^([0-9]{4})', 1), '') AS era FROM manifest")
def era_of_articles(spark, folder):
    return runtime.table(spark, folder, "manifest").select("article_id", T.era_of(F.col("published_at")).alias("era")).distinct()


@query(
    f"""WITH f AS (SELECT * FROM ({_RECORDS}) WHERE sent_len_median IS NOT NULL AND n_chars IS NOT NULL), r AS (SELECT author_id, sent_len_median AS v, sum(n_chars) OVER (PARTITION BY author_id) AS total,
  sum(n_chars) OVER (PARTITION BY author_id ORDER BY sent_len_median RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc FROM f)
  SELECT author_id, CASE WHEN min(total) <= 0 THEN {_q('v', .5)} ELSE min(CASE WHEN acc >= total / 2 THEN v END) END AS weighted_median FROM r GROUP BY author_id"""
)
def author_weighted_median(spark, folder):
    return _r(stats.weighted_median(_records(spark, folder), ["author_id"], "sent_len_median", "n_chars"))


def _at(i: str) -> str:
    return f"v[CAST(greatest(0, least({i}, len(v) - 1)) AS INT) + 1]"


def _upper(two: bool = False) -> str:
    return f"CASE WHEN len(v) < 100 THEN v[len(v)] ELSE {_at(f'ceil({1 - (S.ALPHA / 2 if two else S.ALPHA)!r} * (len(v) - 1) - 1e-12)')} END"


def _lower(two: bool = False) -> str:
    return f"CASE WHEN len(v) < 100 THEN v[1] ELSE {_at(f'floor({(S.ALPHA / 2 if two else S.ALPHA)!r} * (len(v) - 1) + 1e-12)')} END"


_RANGE_LO = f"CASE WHEN v[1] >= 0 THEN greatest(0.0, least({_lower(True)}, q1 - 1.5 * (q3 - q1))) ELSE least({_lower(True)}, q1 - 1.5 * (q3 - q1)) END"
_RANGE_HI = f"greatest({_upper(True)}, q3 + 1.5 * (q3 - q1))"


def _sorted(value: str, frm: str, group: str = "author_id") -> str:
    return f"SELECT {group}, list_sort(list(CAST({value} AS DOUBLE))) AS v, {_q(value, .25)} AS q1, {_q(value, .75)} AS q3, {_q(value, .5)} AS q2, {_q(value, .1)} AS p10, {_q(value, .9)} AS p90, {_q(value, .95)} AS p95 FROM {frm} WHERE {value} IS NOT NULL GROUP BY {group}"


@query(
    f"WITH s AS ({_sorted('sent_len_max', f'({_RECORDS})')}) SELECT author_id, CAST(len(v) AS INT) AS n, {_at('ceil(0.95 * (len(v) - 1) - 1e-12)')} AS p95_out, {_upper()} AS upper, {_lower()} AS lower, "
    f"round({_RANGE_LO}, 6) AS hard_lo, round({_RANGE_HI}, 6) AS hard_hi FROM s"
)
def hard_bounds(spark, folder):
    return _r(stats.hard_bounds(_records(spark, folder), ["author_id"], "sent_len_max"))


@query(
    f"WITH s AS ({_sorted('longest_run', f'({_RECORDS})')}), c AS (SELECT *, greatest(3, CAST(ceil(p95 - 1e-9) AS BIGINT)) AS cap FROM s) "
    f"SELECT author_id, cap, greatest(cap + 2, CAST(ceil({_upper()} - 1e-9) AS BIGINT)) AS hard_cap FROM c"
)
def run_caps(spark, folder):
    return stats.run_cap(_records(spark, folder), ["author_id"], "longest_run")


@query(
    "WITH v AS (SELECT event_type AS t, value FROM events WHERE value IS NOT NULL AND event_type IN ('click', 'view')), c AS (SELECT value, count(*) FILTER (t = 'click') AS a, count(*) FILTER (t = 'view') AS b FROM v GROUP BY value), "
    "r AS (SELECT *, coalesce(sum(b) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) "
    "SELECT round((2 * sum(a * below) + sum(a * b) - sum(a) * sum(b)) / nullif(sum(a) * sum(b), 0), 6) AS delta FROM r"
)
def cliffs_delta_by_event_type(spark, folder):
    return _r(stats.cliffs_delta(runtime.table(spark, folder, "events"), "event_type", "value", "click", "view"))


@query(
    f"""WITH s AS (SELECT author_id, list(sent_len_median) AS v FROM ({_RECORDS}) WHERE sent_len_median IS NOT NULL GROUP BY author_id)
  SELECT author_id, CAST(len(v) AS INT) AS n, list_aggregate(v, 'quantile_cont', 0.5) AS median, len(v) >= 2 AND list_bool_and(list_transform(range(1, len(v) + 1),
  lambda i: (list_aggregate(list_concat(v[:i - 1], v[i + 1:]), 'quantile_cont', 0.5) > 45.0) = (list_aggregate(v, 'quantile_cont', 0.5) > 45.0))) AS stable FROM s"""
)
def loao_direction(spark, folder):
    return _r(stats.loao_direction(_records(spark, folder), ["author_id"], "sent_len_median", 45.0))


@query(f"SELECT author_id, article_id, round(cume_dist() OVER (PARTITION BY author_id ORDER BY sent_len_median), 6) AS rank_share FROM ({_RECORDS}) WHERE sent_len_median IS NOT NULL")
def percentile_ranks(spark, folder):
    return _r(stats.percentile_rank(_records(spark, folder), ["author_id"], "sent_len_median").select("author_id", "article_id", "rank_share"))


@query()
def bootstrap_ci(spark, folder):
    return stats.bootstrap_ci(_records(spark, folder), ["author_id"], "sent_len_median", ["article_id", "sent_len_median"])


@query()
def direction_agreement(spark, folder):
    return stats.direction_agreement(_records(spark, folder), ["author_id"], "sent_len_median", ["article_id", "sent_len_median"], 45.0)


# ---- distributions ----


def _endings(spark, folder) -> DataFrame:
    rows = _records(spark, folder).where("desu_masu is not null")
    one = rows.groupBy("author_id", "article_id").agg(*(F.max(c).alias(c) for c in T.ENDINGS))
    return one.unpivot(["author_id", "article_id"], list(T.ENDINGS), "key", "p")


_E = (
    f"one AS (SELECT author_id, article_id, {', '.join(f'max({c}) AS {c}' for c in T.ENDINGS)} FROM ({_RECORDS}) WHERE desu_masu IS NOT NULL GROUP BY 1, 2), e AS ("
    + " UNION ALL ".join(f"SELECT author_id, article_id, '{c}' AS key, {c} AS p FROM one WHERE {c} IS NOT NULL" for c in T.ENDINGS)
    + "), n AS (SELECT author_id, count(DISTINCT article_id) AS n FROM e GROUP BY 1), c AS (SELECT author_id, key, sum(p) / any_value(n) AS mean, any_value(n) AS n FROM e JOIN n USING (author_id) GROUP BY 1, 2)"
)


def _term(p: str, q: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN 0.5 * {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0.0 END + CASE WHEN {q} > 0 THEN 0.5 * {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0.0 END)"


@query(f"WITH {_E} SELECT author_id, key, round(mean, 6) AS mean, n FROM c")
def ending_dist_centroid(spark, folder):
    return _r(distributions.centroid(_endings(spark, folder), ["author_id"], "article_id"))


_TOP = _E + ", top AS (SELECT author_id, key FROM c QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY mean DESC, key) <= 3)"


def _top(spark, folder) -> tuple[DataFrame, DataFrame]:
    e = _endings(spark, folder)
    return e, distributions.top_keys(distributions.centroid(e, ["author_id"], "article_id"), ["author_id"], 3)


@query(f"WITH {_TOP} SELECT author_id, article_id, coalesce(top.key, 'OTHER') AS key, round(sum(p), 6) AS p FROM e LEFT JOIN top USING (author_id, key) GROUP BY 1, 2, 3")
def topk_other(spark, folder):
    e, top = _top(spark, folder)
    return _r(distributions.projected(e, top, ["author_id"], ["article_id"]))


@query(f"WITH {_E} SELECT author_id, article_id, round(sqrt(greatest(0.0, sum({_term('p', 'mean')}))), 6) AS distance FROM e JOIN c USING (author_id, key) GROUP BY 1, 2")
def js_distance_to_author(spark, folder):
    e = _endings(spark, folder)
    j = e.join(distributions.centroid(e, ["author_id"], "article_id"), ["author_id", "key"])
    return _r(j.groupBy("author_id", "article_id").agg(distributions.js_distance(distributions.js_term(F.col("p"), F.col("mean"))).alias("distance")))


_LOAO = _E + f""", d AS (SELECT author_id, article_id, p, greatest(0.0, (sum(p) OVER w - p) / (count(*) OVER w - 1)) AS rest FROM e WINDOW w AS (PARTITION BY author_id, key) QUALIFY count(*) OVER w > 1),
  l AS (SELECT author_id, article_id, sqrt(greatest(0.0, sum({_term('p', 'rest')}))) AS distance FROM d GROUP BY 1, 2)"""


@query(f"WITH {_LOAO} SELECT author_id, article_id, round(distance, 6) AS distance FROM l")
def loao_distance(spark, folder):
    return _r(distributions.loao_distances(_endings(spark, folder), ["author_id"], ["article_id"]))


@query(
    f"""WITH {_LOAO}, s AS ({_sorted('distance', 'l')}) SELECT author_id, len(v) AS n, CASE WHEN len(v) >= 10 THEN 'built' ELSE 'skipped' END AS status, CASE WHEN len(v) >= 10 THEN round(q2, 6) END AS p50,
  CASE WHEN len(v) >= 10 THEN round(p90, 6) END AS warn, CASE WHEN len(v) >= 10 THEN round(greatest({_upper()}, p90), 6) END AS fail FROM s"""
)
def dist_calibration(spark, folder):
    return _r(distributions.calibrate(distributions.loao_distances(_endings(spark, folder), ["author_id"], ["article_id"]), ["author_id"]))


@query(
    f"""WITH s AS ({_sorted('sent_len_median', f'({_RECORDS})')}) SELECT author_id, len(v) AS n, CASE WHEN len(v) >= 10 THEN 'built' ELSE 'skipped' END AS status, CASE WHEN len(v) >= 10 THEN round(p10, 6) END AS warn_lo,
  CASE WHEN len(v) >= 10 THEN round(p90, 6) END AS warn_hi, CASE WHEN len(v) >= 10 THEN round(q2, 6) END AS median, CASE WHEN len(v) >= 10 THEN round({_RANGE_LO}, 6) END AS fail_lo, CASE WHEN len(v) >= 10 THEN round({_RANGE_HI}, 6) END AS fail_hi FROM s"""
)
def scalar_calibration(spark, folder):
    c = distributions.calibrate_scalar(_records(spark, folder), ["author_id"], "sent_len_median")
    return _r(c.select("author_id", "n", "status", "warn_lo", "warn_hi", "median", "fail_lo", "fail_hi"))


_SLICE = (
    _E + f", k AS (SELECT DISTINCT author_id, article_id, CASE WHEN n_chars < 800 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS slice FROM ({_RECORDS}) WHERE n_chars IS NOT NULL), "
    "es AS (SELECT * FROM e JOIN k USING (author_id, article_id)), sn AS (SELECT author_id, slice, count(DISTINCT article_id) AS k FROM es GROUP BY 1, 2), "
    "sc AS (SELECT author_id, slice, key, sum(p) / any_value(k) AS mean FROM es JOIN sn USING (author_id, slice) GROUP BY 1, 2, 3)"
)


@query(
    f"""WITH {_SLICE} SELECT sn.author_id, sn.slice, c.key, k, round((coalesce(sc.mean, 0.0) * k + c.mean * 10) / (k + 10), 6) AS mean FROM sn JOIN c ON c.author_id = sn.author_id
  LEFT JOIN sc ON sc.author_id = sn.author_id AND sc.slice = sn.slice AND sc.key = c.key WHERE k >= 5 AND k < 10"""
)
def slice_shrinkage(spark, folder):
    e = _endings(spark, folder)
    of = _records(spark, folder).where("n_chars is not null").select("author_id", "article_id", T.length_stratum_of(F.col("n_chars")).alias("slice")).distinct()
    local = distributions.centroid(e.join(of, ["author_id", "article_id"]), ["author_id", "slice"], "article_id")
    return distributions.shrunk(local, distributions.centroid(e, ["author_id"], "article_id"), ["author_id"], "slice").where("k >= 5 and k < 10")


@query(f"WITH {_E} SELECT author_id, article_id, key, round(p - mean, 6) AS delta FROM e JOIN c USING (author_id, key) QUALIFY row_number() OVER (PARTITION BY author_id, article_id ORDER BY round(abs(p - mean), 9) DESC, key) <= 5")
def top_deviations(spark, folder):
    e = _endings(spark, folder)
    return _r(evaluation.top_deviations(e, distributions.centroid(e, ["author_id"], "article_id"), ["author_id"], ["article_id"]))


# ---- gates ----

_CAL = f"s AS ({_sorted('sent_len_median', f'({_RECORDS})')}), t AS (SELECT author_id, q2 - greatest(q3 - q1, 8) AS w0, q2 + greatest(q3 - q1, 8) AS hi, {_RANGE_LO} AS f0, {_RANGE_HI} AS f1 FROM s), b AS (SELECT *, greatest(w0, 0.0) AS lo FROM t)"
_EVAL = _CAL + f""", ev AS (SELECT DISTINCT author_id, article_id, sent_len_median AS measured, CASE WHEN sent_len_median IS NULL THEN NULL WHEN sent_len_median BETWEEN lo AND hi THEN 'pass'
  WHEN sent_len_median BETWEEN lo - (hi - lo) * 0.5 AND hi + (hi - lo) * 0.5 OR sent_len_median BETWEEN f0 AND f1 THEN 'warn' ELSE 'fail' END AS status FROM ({_RECORDS}) JOIN b USING (author_id))"""


def _evaluated(spark, folder) -> DataFrame:
    records = _records(spark, folder)
    return evaluation.range_gate(records, evaluation.warn_ranges(records, ["author_id"], "sent_len_median", 8.0), ["author_id"], "sent_len_median")


@query(f"WITH {_CAL} SELECT author_id, round(lo, 6) AS warn_lo, round(hi, 6) AS warn_hi, round(f0, 6) AS hard_lo, round(f1, 6) AS hard_hi FROM b")
def warn_ranges(spark, folder):
    return _r(evaluation.warn_ranges(_records(spark, folder), ["author_id"], "sent_len_median", 8.0))


@query(f"WITH {_EVAL} SELECT author_id, article_id, measured, status FROM ev")
def gate_range_eval(spark, folder):
    return _evaluated(spark, folder).select("author_id", "article_id", F.col("sent_len_median").alias("measured"), "status").distinct()


@query(
    f"""WITH {_EVAL} SELECT author_id, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'fail') AS failed,
  CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 WHEN 'pass' THEN 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' WHEN 0 THEN 'pass' ELSE 'skipped' END AS worst FROM ev GROUP BY author_id"""
)
def gate_summary(spark, folder):
    rows = _evaluated(spark, folder).select("author_id", "article_id", "sent_len_median", "status").distinct()
    return evaluation.gate_summary(rows, ["author_id"])


@query(
    f"""WITH docs AS ({_DOCS}), m AS (SELECT doc_id, string_split(text, 'ところで') AS p FROM docs), s AS (SELECT doc_id, i, len(p) AS n, sum(length(p[i])) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * 4 AS start FROM m, LATERAL (SELECT UNNEST(range(1, len(p) + 1)) AS i) r),
  k AS (SELECT *, lead(start, 2) OVER (PARTITION BY doc_id ORDER BY i) AS far FROM s QUALIFY true), f AS (SELECT doc_id, count(*) AS n_marks, max(CASE WHEN i + 2 < n AND far - start < 1000 THEN 1 ELSE 0 END) AS dense FROM k WHERE i < n GROUP BY doc_id)
  SELECT docs.doc_id, coalesce(n_marks, 0) AS n_marks, CASE WHEN dense = 1 THEN 'fail' ELSE 'pass' END AS status FROM docs LEFT JOIN f USING (doc_id)"""
)
def marker_density(spark, folder):
    return corpus.markers_dense(_documents(spark, folder), "doc_id", "ところで")


_CHAN = _LOAO + f""", s AS ({_sorted('distance', 'l')}), th AS (SELECT author_id, p90 AS warn, greatest({_upper()}, p90) AS fail FROM s WHERE len(v) >= 10),
  dist AS (SELECT author_id, article_id, round(sqrt(greatest(0.0, sum({_term('p', 'mean')}))), 9) AS distance FROM e JOIN c USING (author_id, key) GROUP BY 1, 2)"""


@query(
    f"""WITH {_CHAN} SELECT author_id, article_id, round(distance, 6) AS distance, CASE WHEN warn IS NULL THEN 'skipped' WHEN distance <= round(warn, 9) THEN 'pass' WHEN distance <= round(fail, 9) THEN 'warn' ELSE 'fail' END AS status
  FROM dist LEFT JOIN th USING (author_id)"""
)
def channel_evaluation(spark, folder):
    e = _endings(spark, folder)
    reference = distributions.calibrate(distributions.loao_distances(e, ["author_id"], ["article_id"]), ["author_id"])
    return _r(evaluation.channel_status(e, distributions.centroid(e, ["author_id"], "article_id"), reference, ["author_id"], ["article_id"]))


@query(
    f"""SELECT author_id, count(*) AS n, {_q('sent_len_median', .5)} AS median, CASE WHEN {_q('sent_len_median', .5)} > 45.0 THEN 'above' WHEN {_q('sent_len_median', .5)} < 45.0 THEN 'below' END AS direction,
  CASE WHEN {_q('sent_len_median', .5)} > 45.0 THEN count(*) FILTER (sent_len_median > 45.0) ELSE count(*) FILTER (sent_len_median < 45.0) END AS support FROM ({_RECORDS}) WHERE sent_len_median IS NOT NULL GROUP BY author_id HAVING {_q('sent_len_median', .5)} <> 45.0"""
)
def claim_candidates(spark, folder):
    return _r(evaluation.claim_candidates(_records(spark, folder), ["author_id"], "sent_len_median", 45.0))


# ---- feedback between versions of an article: a second intake against the article it names ----

_FEED = f"""p AS (SELECT DISTINCT m.author_id, m.article_id AS a, m.dup_of AS b FROM manifest m WHERE dup_of IS NOT NULL), one AS (SELECT article_id, max(sent_len_median) AS sent_len_median, max(sent_len_max) AS sent_len_max, max(comma_median) AS comma_median FROM ({_RECORDS}) GROUP BY 1),
  d AS (""" + " UNION ALL ".join(f"SELECT author_id, a, b, '{m}' AS metric, round(y.{m} - x.{m}, 4) AS delta FROM p JOIN one x ON x.article_id = a JOIN one y ON y.article_id = b WHERE x.{m} IS NOT NULL AND y.{m} IS NOT NULL" for m in ("sent_len_median", "sent_len_max", "comma_median")) + ")"
_METRICS = ("sent_len_median", "sent_len_max", "comma_median")


def _feedback(spark, folder) -> DataFrame:
    pairs = runtime.table(spark, folder, "manifest").where("dup_of is not null").select("author_id", F.col("article_id").alias("a"), F.col("dup_of").alias("b")).distinct()
    one = _records(spark, folder).groupBy("article_id").agg(*(F.max(m).alias(m) for m in _METRICS))
    return evaluation.feedback_deltas(pairs, one, _METRICS)


@query(f"WITH {_FEED} SELECT author_id, a, b, metric, CAST(delta AS DOUBLE) AS delta FROM d")
def feedback_delta(spark, folder):
    return _feedback(spark, folder)


@query(
    f"""WITH {_FEED}, v AS (SELECT metric, delta FROM d WHERE abs(delta) > 1e-6), r AS (SELECT metric, count(*) AS n, list_sort(list(CAST(delta AS DOUBLE))) AS v, count(*) FILTER (delta > 0) AS up FROM v GROUP BY metric)
  SELECT metric, n, v[n // 2 + 1] AS median_delta, round(greatest(up, n - up) / n, 6) AS agreement FROM r WHERE n >= 3 AND greatest(up, n - up) / n >= 0.7"""
)
def feedback_report(spark, folder):
    return _r(evaluation.feedback_report(_feedback(spark, folder)))


# ---- parsing and tokens: checked by tests ----


@query()
def block_classify(spark, folder):
    d = blocks.with_blocks(_documents(spark, folder))
    return d.select("doc_id", F.posexplode("blocks").alias("block_index", "b")).select("doc_id", "block_index", "b.*")


@query()
def prose_segments(spark, folder):
    c = runtime.table(spark, folder, "clean").where("blocks is not null").select("article_id", "blocks")
    s = blocks.with_segments(runtime.spread(c)).select("article_id", F.explode("segments").alias("s"))
    return s.select("article_id", "s.*").distinct()


from . import channel_queries, decision_queries  # noqa: E402, F401
