"""Queries of thresholds, gates, claims, slices and feedback over the feature records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions import stats as S
from ..functions import text as T
from ..operators import blocks, corpus, decisions, distributions, evaluation, features, ngrams, overlap, review, stats
from .queries import _DOCS, _E, _RECORDS, _S, _documents, _endings, _grams, _items, _lower, _q, _r, _records, _term, _upper, query

_NAMES = [m[0] for m in decisions.METRICS]
_ONE = f"f1 AS (SELECT author_id, article_id, {', '.join(f'max({m}) AS {m}' for m in ('n_sents', 'n_chars', *_NAMES[:13]))}, {', '.join(f'max({m}) AS {m}' for m in _NAMES[13:])} FROM (SELECT r.*, CAST(NULL AS DOUBLE) AS ttr_window, CAST(NULL AS DOUBLE) AS distinct_2, CAST(NULL AS DOUBLE) AS func_word_rate FROM ({_RECORDS}) r) WHERE author_id IS NOT NULL AND article_id IS NOT NULL GROUP BY 1, 2)"
_VALUES = _ONE + ", vals AS (" + " UNION ALL ".join(f"SELECT author_id, article_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM f1 WHERE {m} IS NOT NULL" for m in _NAMES) + ")"


def _flat(spark, folder) -> DataFrame:
    """One row an author and article: the greatest value of each metric where rows of an article differ."""
    r = _records(spark, folder).where("author_id is not null and article_id is not null")
    have = [m for m in _NAMES if m in r.columns]
    none = [F.lit(None).cast("double").alias(m) for m in _NAMES if m not in r.columns]
    return r.groupBy("author_id", "article_id").agg(*(F.max(m).alias(m) for m in ("n_sents", "n_chars", *have))).select("*", *none, F.lit(None).cast("int").alias("n_tokens"))


def _values(spark, folder) -> DataFrame:
    return evaluation.metric_rows(_flat(spark, folder), ["author_id", "article_id"], _NAMES)


_TABLE = "(VALUES " + ", ".join(f"('{m}', '{g}', '{r}', {f}, {str(q).lower()}, {b})" for m, g, r, f, q, b in decisions.METRICS) + ") t(metric, gate, rule, floor, ratio, baseline)"
_B = f"""s AS (SELECT author_id, metric, list_sort(list(value)) AS v, {_q('value', .25)} AS q1, {_q('value', .5)} AS q2, {_q('value', .75)} AS q3, {_q('value', .05)} AS p05, {_q('value', .95)} AS p95 FROM vals GROUP BY 1, 2),
  b AS (SELECT s.*, t.*, len(v) AS n, CASE WHEN v[1] >= 0 THEN greatest(0.0, least({_lower(True)}, q1 - 1.5 * (q3 - q1))) ELSE least({_lower(True)}, q1 - 1.5 * (q3 - q1)) END AS h0, greatest({_upper(True)}, q3 + 1.5 * (q3 - q1)) AS h1, {_upper()} AS up, {_lower()} AS low, greatest(q3 - q1, floor) AS half,
    greatest(3, ceil(p95 - 1e-9)) AS cap FROM s JOIN {_TABLE} ON t.metric = s.metric),
  lim AS (SELECT author_id, b.metric AS metric, gate, rule, ratio, floor, n, CASE rule WHEN 'range' THEN greatest(q2 - half, 0.0) WHEN 'lower' THEN p05 END AS warn_lo,
    CASE rule WHEN 'range' THEN CASE WHEN ratio THEN least(q2 + half, 1.0) ELSE q2 + half END WHEN 'upper' THEN p95 WHEN 'run' THEN cap END AS warn_hi, CASE rule WHEN 'range' THEN h0 WHEN 'lower' THEN low END AS hard_lo,
    CASE rule WHEN 'range' THEN CASE WHEN ratio THEN least(h1, 1.0) ELSE h1 END WHEN 'upper' THEN up WHEN 'run' THEN greatest(cap + 2, ceil(up - 1e-9)) END AS hard_hi FROM b)"""
_NOTES = """CASE WHEN rule <> 'range' THEN '' ELSE array_to_string(list_sort(list_filter([CASE WHEN warn_hi - warn_lo <= 0 THEN 'warn_band_zero_width' END, CASE WHEN hard_hi - hard_lo <= 0 THEN 'hard_band_zero_width' END,
  CASE WHEN hard_lo = 0 AND warn_lo = 0 THEN 'lower_bound_degenerate_zero(one_sided_upper)' END, CASE WHEN hard_hi - hard_lo <= CASE WHEN ratio THEN 0.08 ELSE floor END / 2 THEN 'hard_band_narrow' END], lambda x: x IS NOT NULL)), ';') END"""


@query(f"WITH {_VALUES}, {_B} SELECT author_id, metric, gate, rule, n, round(warn_lo, 6) AS warn_lo, round(warn_hi, 6) AS warn_hi, round(hard_lo, 6) AS hard_lo, round(hard_hi, 6) AS hard_hi, {_NOTES} AS notes FROM lim")
def gate_thresholds(spark, folder):
    t = decisions.thresholds(_values(spark, folder), ["author_id"])
    return _r(t.withColumn("notes", F.array_join("notes", ";")))


_GATES = f"""{_VALUES}, {_B}, ga AS (SELECT v.author_id, v.article_id, v.metric, gate, value, CASE gate WHEN 'G3' THEN n_chars < 300 WHEN 'G4' THEN NULL ELSE n_sents < 10 END AS short, CASE gate WHEN 'G3' THEN 'insufficient_chars(' || n_chars || '<300)' ELSE 'insufficient_sents(' || n_sents || '<10)' END AS why,
    CASE rule WHEN 'range' THEN CASE WHEN value BETWEEN warn_lo AND warn_hi THEN 'pass' WHEN value BETWEEN warn_lo - (warn_hi - warn_lo) * 0.5 AND warn_hi + (warn_hi - warn_lo) * 0.5 OR value BETWEEN hard_lo AND hard_hi THEN 'warn' ELSE 'fail' END
    WHEN 'lower' THEN CASE WHEN value >= warn_lo THEN 'pass' WHEN value < hard_lo THEN 'fail' ELSE 'warn' END ELSE CASE WHEN value <= warn_hi THEN 'pass' WHEN value > hard_hi THEN 'fail' ELSE 'warn' END END AS st
    FROM vals v JOIN lim l ON l.author_id = v.author_id AND l.metric = v.metric JOIN f1 ON f1.author_id = v.author_id AND f1.article_id = v.article_id),
  gs AS (SELECT author_id, article_id, metric, gate, value, CASE WHEN short AND st = 'fail' THEN 'warn' ELSE st END AS status, CASE WHEN short THEN why END AS degraded FROM ga)"""


def _gates(spark, folder) -> DataFrame:
    flat, values = _flat(spark, folder), _values(spark, folder)
    sizes = flat.select("author_id", "article_id", "n_sents", "n_chars", "n_tokens")
    return decisions.gates(values, decisions.thresholds(values, ["author_id"]), sizes.drop("author_id"), ["author_id"], ["article_id"])


@query(f"WITH {_GATES} SELECT author_id, article_id, metric, gate, round(value, 6) AS value, status, degraded FROM gs")
def gate_statuses(spark, folder):
    return _r(_gates(spark, folder))


_WORST = "CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 WHEN 'pass' THEN 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' WHEN 0 THEN 'pass' ELSE 'skipped' END"


@query(f"WITH {_GATES} SELECT author_id, article_id, gate, {_WORST} AS status FROM gs GROUP BY 1, 2, 3")
def gate_results(spark, folder):
    return decisions.gate_results(_gates(spark, folder), ["author_id", "article_id"])


@query(f"WITH {_GATES} SELECT author_id, article_id, count(*) FILTER (status = 'fail') = 0 AS passed FROM gs GROUP BY 1, 2")
def gate_passed(spark, folder):
    return decisions.passed(decisions.gate_results(_gates(spark, folder), ["author_id", "article_id"]), ["author_id", "article_id"])


# Golden texts: an article that passes its own author's gates is expected to; one of another length class is not asked.
@query(f"WITH {_GATES}, p AS (SELECT author_id || '/' || article_id AS id, {_WORST} AS got FROM gs GROUP BY author_id, article_id) SELECT id, 'pass' AS expected, got FROM p WHERE got <> 'pass'")
def golden_regressions(spark, folder):
    worst = _gates(spark, folder).groupBy(F.concat_ws("/", "author_id", "article_id").alias("id")).agg(S.worst(F.col("status")).alias("status"))
    return evaluation.regression(worst, worst.select("id", F.lit("pass").alias("expected")))


_STRATA = "st AS (SELECT article_id, min(strata) AS stratum FROM manifest GROUP BY 1)"
_CLAIM = f"""{_VALUES}, {_STRATA}, x AS (SELECT v.author_id, v.article_id, v.metric, value, baseline, coalesce(stratum, 'unknown') AS stratum FROM vals v JOIN {_TABLE} ON t.metric = v.metric LEFT JOIN st ON st.article_id = v.article_id),
  g AS (SELECT author_id, metric, any_value(baseline) AS b, count(*) AS n, {_q('value', .5)} AS median, list(value) AS v, count(*) FILTER (value > baseline) AS above, count(*) FILTER (value < baseline) AS below,
    count(DISTINCT stratum) FILTER (value > baseline) AS sa, count(DISTINCT stratum) FILTER (value < baseline) AS sb FROM x GROUP BY 1, 2),
  h AS (SELECT author_id, metric, n, median, CASE WHEN median > b THEN 'above' ELSE 'below' END AS direction, (above - below) / n AS effect, CASE WHEN median > b THEN above ELSE below END AS articles, CASE WHEN median > b THEN sa ELSE sb END AS strata,
    n >= 2 AND list_bool_and(list_transform(range(1, n + 1), lambda i: (list_aggregate(list_concat(v[:i - 1], v[i + 1:]), 'quantile_cont', 0.5) > b) = (median > b))) AS stable FROM g WHERE median <> b),
  k AS (SELECT *, articles >= 3 AND strata >= 2 AS support FROM h)"""


def _strata(spark, folder) -> DataFrame:
    return runtime.table(spark, folder, "manifest").groupBy("article_id").agg(F.min("strata").alias("stratum"))


@query(
    f"""WITH {_CLAIM} SELECT author_id, metric, CAST(n AS INT) AS n, round(median, 6) AS median, direction, round(effect, 6) AS effect, articles, strata, stable, support, CASE WHEN support AND stable THEN 'core' WHEN NOT support THEN 'local' ELSE 'ambiguous' END AS status,
  CASE WHEN support AND stable THEN 'always_on_rule' WHEN NOT support THEN 'example' ELSE 'checklist' END AS target, 'medium' AS confidence FROM k"""
)
def claim_gates(spark, folder):
    return _r(decisions.claim_gates(_values(spark, folder), _strata(spark, folder), ["author_id"]))


@query()
def claims_with_agreement(spark, folder):
    values = _values(spark, folder)
    per = {m: b for m, *_, b in decisions.METRICS}
    rows = values.where(F.col("metric").isin("sent_len_median", "script_kanji", "desu_masu"))
    base = F.element_at(F.create_map(*(F.lit(x) for m in ("sent_len_median", "script_kanji", "desu_masu") for x in (m, per[m]))), F.col("metric"))
    centred = rows.withColumn("value", F.col("value") - base)
    agreement = stats.direction_agreement(centred, ["author_id", "metric"], "value", ["article_id", "value"], 0.0)
    return decisions.claim_gates(rows, _strata(spark, folder), ["author_id"], agreement)


@query(
    f"""WITH {_CLAIM}, e AS (SELECT x.author_id, x.metric, x.article_id, round(abs(value - baseline), 9) AS far FROM x JOIN k ON k.author_id = x.author_id AND k.metric = x.metric WHERE (value > baseline) = (direction = 'above') AND value <> baseline),
  r AS (SELECT *, row_number() OVER (PARTITION BY author_id, metric ORDER BY far DESC, article_id) AS rank FROM (SELECT DISTINCT * FROM e)),
  c AS (SELECT article_id, min((b.char_start, b.char_end)) AS s FROM (SELECT article_id, list_filter(blocks, lambda b: b.type = 'body')[1] AS b FROM clean) WHERE b IS NOT NULL GROUP BY 1)
  SELECT author_id, metric, CAST(rank AS INT) AS rank, article_id, s[1] AS char_start, s[2] AS char_end FROM r JOIN c USING (article_id) WHERE rank <= 3"""
)
def claim_evidence(spark, folder):
    values = _values(spark, folder)
    claims = decisions.claim_gates(values, _strata(spark, folder), ["author_id"])
    return decisions.evidence(values, runtime.table(spark, folder, "clean"), ["author_id"], claims)


@query(f"""WITH {_CLAIM}, z AS (SELECT 1) SELECT t.metric AS metric, gate, coalesce(ids, '') AS claim_ids FROM {_TABLE} LEFT JOIN (SELECT metric, string_agg(author_id || ':' || metric, ';' ORDER BY author_id || ':' || metric) AS ids FROM k WHERE author_id < 'auth-0003' GROUP BY 1) USING (metric)""")
def claims_of_gates(spark, folder):
    k = decisions.claim_gates(_values(spark, folder), _strata(spark, folder), ["author_id"]).where("author_id < 'auth-0003'")
    findings = decisions.metric_table(spark).select("metric", "gate")
    return decisions.claims_of_gates(findings, k.select(F.concat_ws(":", "author_id", "metric").alias("claim_id"), "metric")).select("metric", "gate", F.array_join("claim_ids", ";").alias("claim_ids"))


@query(f"WITH {_CLAIM} SELECT t.metric AS metric, bool_or(k.metric IS NOT NULL) AS evaluable FROM {_TABLE} LEFT JOIN k ON k.metric = t.metric GROUP BY 1 UNION ALL SELECT 'no_such_metric', false")
def evaluable_metrics(spark, folder):
    k = decisions.claim_gates(_values(spark, folder), _strata(spark, folder), ["author_id"]).select("metric", F.lit("built").alias("status"))
    asked = decisions.metric_table(spark).select("metric").unionByName(spark.createDataFrame([("no_such_metric",)], "metric string"))
    return decisions.evaluable(asked, k)


# Drift: the claims of the first half of an author's articles (by id) against the aggregate of all.
_DRIFT = f"""{_VALUES}, a AS (SELECT author_id || ':' || metric AS metric, {_q('value', .5)} AS now, {_q('value', .25)} AS l, {_q('value', .75)} AS h FROM vals GROUP BY author_id, vals.metric),
  hf AS (SELECT *, ntile(2) OVER (PARTITION BY author_id, metric ORDER BY article_id) AS half FROM vals), c AS (SELECT author_id || ':' || metric AS metric, {_q('value', .25)} AS lo, {_q('value', .75)} AS hi FROM hf WHERE half = 1 GROUP BY author_id, hf.metric)"""


@query(f"WITH {_DRIFT} SELECT c.metric AS metric, CASE WHEN now IS NULL THEN 'metric_not_in_schema' WHEN NOT (now BETWEEN lo - 0.01 AND hi + 0.01 OR (l <= hi + 0.01 AND h >= lo - 0.01)) THEN 'value_drift' END AS kind FROM c LEFT JOIN a USING (metric)")
def claim_drifts(spark, folder):
    from pyspark.sql import Window

    values = _values(spark, folder)
    half = values.withColumn("half", F.ntile(2).over(Window.partitionBy("author_id", "metric").orderBy("article_id"))).where("half = 1")
    name = F.concat_ws(":", "author_id", "metric")
    claims = half.groupBy("author_id", "metric").agg(F.percentile("value", 0.25).alias("lo"), F.percentile("value", 0.75).alias("hi")).select(name.alias("metric"), "lo", "hi")
    now = values.groupBy("author_id", "metric").agg(F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.25).alias("lo"), F.percentile("value", 0.75).alias("hi"))
    return evaluation.claim_drift(claims, now.select(name.alias("metric"), F.lit(True).alias("built"), "median", "lo", "hi")).select("metric", "kind")


_SL = f"""{_ONE}, era AS (SELECT article_id, max(nullif(regexp_extract(published_at, '^([0-9]{{4}})', 1), '')) AS era FROM manifest GROUP BY 1),
  sl AS (SELECT DISTINCT author_id, article_id, UNNEST(list_filter(['register:' || CASE WHEN desu_masu >= 0.5 THEN 'desu_masu' WHEN da_dearu + jotai >= 0.5 THEN 'jotai' ELSE 'mixed' END, 'length:' || CASE WHEN n_chars < 800 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END, 'era:' || era], lambda x: x IS NOT NULL)) AS slice
    FROM (SELECT f1.*, j.jotai, era FROM f1 JOIN (SELECT author_id, article_id, max(jotai_verb) + max(jotai_adj) AS jotai FROM ({_RECORDS}) GROUP BY 1, 2) j USING (author_id, article_id) LEFT JOIN era USING (article_id) WHERE n_chars IS NOT NULL AND desu_masu IS NOT NULL))"""


def _slices(spark, folder) -> DataFrame:
    r = _records(spark, folder).where("n_chars is not null and desu_masu is not null and author_id is not null and article_id is not null")
    r = r.groupBy("author_id", "article_id").agg(*(F.max(c).alias(c) for c in ("n_chars", *T.ENDINGS)))
    era = runtime.table(spark, folder, "manifest").groupBy("article_id").agg(F.max(T.era_of(F.col("published_at"))).alias("published_at"))
    return evaluation.slices(r.join(era, "article_id", "left"), ["author_id", "article_id"])


@query(f"WITH {_SL}, p AS (SELECT author_id, slice, count(DISTINCT article_id) AS n FROM sl GROUP BY 1, 2) SELECT author_id, slice, n, CASE WHEN n >= 10 THEN 'built' WHEN n >= 5 THEN 'shrunk' ELSE 'skipped' END AS status, CASE WHEN n >= 10 THEN NULL WHEN n >= 5 THEN 'shrunk_to_global(n=' || n || ')' ELSE 'insufficient_n(' || n || '<5)' END AS reason FROM p")
def slice_status(spark, folder):
    return decisions.slice_statuses(_slices(spark, folder), ["author_id"])


_GLOB = f"""{_E}, {_SL}, es AS (SELECT author_id, 'global' AS slice, article_id, key, p FROM e UNION ALL SELECT e.author_id, slice, e.article_id, key, p FROM e JOIN sl ON sl.author_id = e.author_id AND sl.article_id = e.article_id),
  cs AS (SELECT author_id, slice, key, sum(p) / count(*) AS mean FROM es GROUP BY 1, 2, 3),
  d0 AS (SELECT author_id, slice, article_id, p, greatest(0.0, (sum(p) OVER w - p) / (count(*) OVER w - 1)) AS rest FROM es WINDOW w AS (PARTITION BY author_id, slice, key) QUALIFY count(*) OVER w > 1),
  lo AS (SELECT author_id, slice, article_id, sqrt(greatest(0.0, sum({_term('p', 'rest')}))) AS distance FROM d0 GROUP BY 1, 2, 3),
  rs AS (SELECT author_id, slice, list_sort(list(distance)) AS v, {_q('distance', .9)} AS p90 FROM lo GROUP BY 1, 2),
  th AS (SELECT author_id, slice, len(v) AS n, p90 AS warn, greatest({_upper()}, p90) AS fail, v FROM rs),
  di AS (SELECT es.author_id, es.slice, article_id, round(sqrt(greatest(0.0, sum({_term('p', 'mean')}))), 9) AS distance FROM es JOIN cs USING (author_id, slice, key) GROUP BY 1, 2, 3),
  cr AS (SELECT di.author_id, di.slice, di.article_id, di.distance, CASE WHEN n IS NULL OR n < 10 OR coalesce(ns.n_sents, 0) < 8 THEN 'skipped' WHEN distance <= round(warn, 9) THEN 'pass' WHEN distance <= round(fail, 9) THEN 'warn' ELSE 'fail' END AS status,
    round(len(list_filter(v, lambda x: round(x, 9) <= distance)) / len(v), 4) AS percentile, CASE WHEN n IS NULL THEN 'reference_absent' WHEN n < 10 THEN 'reference_not_built' WHEN coalesce(ns.n_sents, 0) < 8 THEN 'insufficient_sample(' || coalesce(ns.n_sents, 0) || '<8)' END AS reason
    FROM di LEFT JOIN th ON th.author_id = di.author_id AND th.slice = di.slice LEFT JOIN (SELECT article_id, max(n_sents) AS n_sents FROM f1 GROUP BY 1) ns ON ns.article_id = di.article_id)"""


def _channel_results(spark, folder) -> DataFrame:
    e = _endings(spark, folder).where("author_id is not null and article_id is not null")
    sliced = e.join(_slices(spark, folder), ["author_id", "article_id"])
    both = e.withColumn("slice", F.lit("global")).unionByName(sliced)
    keys = ["author_id", "slice"]
    loao = distributions.loao_distances(both, keys, ["article_id"])
    center = distributions.centroid(both, keys, "article_id")
    j = both.join(center.select(*keys, "key", "mean"), [*keys, "key"])
    measured = j.groupBy(*keys, "article_id").agg(F.round(distributions.js_distance(distributions.js_term(F.col("p"), F.col("mean"))), 9).alias("distance"))
    reference = distributions.calibrate(loao, keys).withColumns({"warn": F.round("warn", 9), "fail": F.round("fail", 9)})
    sample = _flat(spark, folder).groupBy("article_id").agg(F.max("n_sents").alias("sample"))
    return decisions.channel_results(measured, reference, loao.withColumn("distance", F.round("distance", 9)), keys, ["article_id"], sample, 8)


@query(f"WITH {_GLOB} SELECT author_id, slice, article_id, round(distance, 6) AS distance, status, CASE WHEN status <> 'skipped' THEN percentile END AS percentile, reason FROM cr")
def slice_evaluation(spark, folder):
    return _r(_channel_results(spark, folder))


@query(
    f"""WITH {_GLOB} SELECT author_id, article_id, slice, status, percentile FROM cr WHERE status <> 'skipped'
  QUALIFY row_number() OVER (PARTITION BY author_id, article_id ORDER BY CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END DESC, coalesce(percentile, 0) DESC, slice <> 'global', slice) = 1"""
)
def worst_slice(spark, folder):
    return _r(decisions.worst_slices(_channel_results(spark, folder), ["author_id", "article_id"]))


@query()
def weighted_bootstrap(spark, folder):
    return stats.weighted_bootstrap_ci(_flat(spark, folder), ["author_id"], "sent_len_median", "n_chars", ["article_id"], n=200)


# Distance of the endings and scripts of an article to those of the article it is said to repeat.
_PAIR = "pr AS (SELECT DISTINCT article_id AS a, dup_of AS b FROM manifest WHERE dup_of IS NOT NULL)"


@query(
    f"""WITH {_E}, {_PAIR}, o AS (SELECT article_id, key, max(p) AS p FROM e GROUP BY 1, 2), x AS (SELECT a, b, o.key, o.p, q.p AS q FROM pr JOIN o ON o.article_id = a JOIN o q ON q.article_id = b AND q.key = o.key)
  SELECT a, b, round(sum({_term('p', 'q')}), 6) AS divergence FROM x GROUP BY 1, 2 UNION ALL SELECT a, b, NULL FROM pr WHERE a NOT IN (SELECT article_id FROM o) OR b NOT IN (SELECT article_id FROM o)"""
)
def feature_distance(spark, folder):
    pairs = runtime.table(spark, folder, "manifest").where("dup_of is not null").select(F.col("article_id").alias("a"), F.col("dup_of").alias("b")).distinct()
    one = _endings(spark, folder).groupBy("article_id", "key").agg(F.max("p").alias("p"))
    return _r(distributions.feature_distance(pairs, one))


@query(
    f"""WITH i AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL), p0 AS (SELECT item_id, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS ps FROM i),
  p1 AS (SELECT item_id, CAST(n - 1 AS INT) AS para, ps[n] AS text FROM p0, LATERAL (SELECT UNNEST(range(1, len(ps) + 1)) AS n) r), pa AS (SELECT * FROM p1 WHERE length(regexp_replace(text, '{_S}+', '', 'g')) >= 30),
  d AS ({_DOCS}), gp AS ({_grams(5, 'item_id, para', 'text', 'pa')}), gd AS ({_grams(5, 'doc_id', 'text', 'd')}), np AS (SELECT item_id, para, count(*) AS n FROM gp GROUP BY 1, 2),
  s AS (SELECT item_id, para, doc_id, count(*) AS shared FROM gp JOIN gd USING (g) GROUP BY 1, 2, 3)
  SELECT item_id, para, doc_id AS source, round(shared / n, 6) AS best FROM s JOIN np USING (item_id, para) QUALIFY row_number() OVER (PARTITION BY item_id, para ORDER BY shared / n DESC, doc_id) = 1"""
)
def paragraph_containment(spark, folder):
    parts = decisions.paragraphs(_items(spark, folder), "item_id").withColumn("part", F.struct("item_id", "para"))
    c = ngrams.containments(parts, _documents(spark, folder), "part", "doc_id", 5)
    return _r(ngrams.best_source(c, "part", "doc_id").select("part.*", "source", "best"))


@query()
def copy_gate(spark, folder):
    d, i = _documents(spark, folder), _items(spark, folder)
    few = i.count() <= overlap.FEW
    exact = overlap.exact_matches(i, d, "item_id", "doc_id", decisions.COPY["exact"] + 1, few)
    parts = decisions.paragraphs(i, "item_id").withColumn("part", F.struct("item_id", "para"))
    best = ngrams.best_source(ngrams.containments(parts, d, "part", "doc_id", 5, few), "part", "doc_id").select("part.item_id", "best")
    minhash = overlap.minhash_similarity(overlap.signatures(i, "item_id"), overlap.signatures(d, "doc_id"), "item_id", "doc_id", few)
    return decisions.copy_gate(exact, ngrams.jaccard_pairs(i, d, "item_id", "doc_id", 5, few), minhash, best, i, "item_id")


@query("SELECT kind, count(*) AS n FROM (SELECT 'both' AS kind, article_id FROM (SELECT article_id FROM splits WHERE split = 'train' UNION SELECT article_id FROM splits WHERE split = 'dev') UNION ALL SELECT 'shared', article_id FROM (SELECT article_id FROM splits WHERE split = 'train' INTERSECT SELECT article_id FROM splits WHERE split <> 'train') UNION ALL SELECT 'train_only', article_id FROM (SELECT article_id FROM splits WHERE split = 'train' EXCEPT SELECT article_id FROM splits WHERE split <> 'train')) GROUP BY kind")
def split_sets(spark, folder):
    s = runtime.table(spark, folder, "splits")
    of = lambda *names: s.where(F.col("split").isin(*names)).select("article_id")
    sets = {"both": of("train", "dev").distinct(), "shared": of("train").intersect(of("dev", "holdout")), "train_only": of("train").subtract(of("dev", "holdout"))}
    out = None
    for name, rows in sets.items():
        part = rows.select(F.lit(name).alias("kind"), "article_id")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


_MOVES = f"""{_VALUES}, {_B}, pm AS (SELECT DISTINCT article_id AS a, dup_of AS b FROM manifest WHERE dup_of IS NOT NULL), one AS (SELECT article_id, metric, max(value) AS value FROM vals GROUP BY 1, 2),
  rg AS (SELECT metric, min(warn_lo) AS lo, max(warn_hi) AS hi FROM lim WHERE rule = 'range' AND author_id = (SELECT min(author_id) FROM lim) GROUP BY 1),
  sh AS (SELECT a, b, x.metric, CASE WHEN x.value BETWEEN lo AND hi AND NOT y.value BETWEEN lo AND hi THEN 'widen' WHEN NOT x.value BETWEEN lo AND hi AND y.value BETWEEN lo AND hi THEN 'enforce' END AS shift FROM pm JOIN one x ON x.article_id = a JOIN one y ON y.article_id = b AND y.metric = x.metric JOIN rg ON rg.metric = x.metric)"""


@query(f"WITH {_MOVES} SELECT metric, shift, count(*) AS n FROM sh WHERE shift IS NOT NULL GROUP BY 1, 2")
def gate_shifts(spark, folder):
    values = _values(spark, folder)
    t = decisions.thresholds(values, ["author_id"]).where("rule = 'range'")
    first = t.agg(F.min("author_id")).first()[0]
    ranges = t.where(F.col("author_id") == first).select("metric", F.col("warn_lo").alias("lo"), F.col("warn_hi").alias("hi"))
    one = values.groupBy("article_id", "metric").agg(F.max("value").alias("value"))
    pairs = runtime.table(spark, folder, "manifest").where("dup_of is not null").select(F.col("article_id").alias("a"), F.col("dup_of").alias("b")).distinct()
    x, y = one.select(F.col("article_id").alias("a"), "metric", F.col("value").alias("generated")), one.select(F.col("article_id").alias("b"), "metric", F.col("value").alias("final"))
    return review.shift_counts(review.shifts(pairs.join(x, "a").join(y, ["b", "metric"]), ranges))


@query("SELECT DISTINCT article_id, problem FROM (SELECT article_id, UNNEST(list_filter([CASE WHEN article_id IS NULL THEN 'missing:article_id' END, CASE WHEN split IS NULL THEN 'missing:split' WHEN split NOT IN ('train', 'dev') THEN 'domain:split' END], lambda x: x IS NOT NULL)) AS problem FROM splits)")
def split_problems(spark, folder):
    # The holdout is no part of the splits a profile may read.
    return corpus.invalid_rows(runtime.table(spark, folder, "splits"), "article_id", ["article_id", "split"], {"split": corpus.SPLITS[:2]})


@query(
    """SELECT DISTINCT article_id, problem FROM (SELECT article_id, 'missing:blocks' AS problem FROM clean WHERE blocks IS NULL UNION ALL SELECT article_id, UNNEST(list_filter([CASE WHEN b.type IS NULL OR b.type NOT IN ('body', 'quote', 'code', 'boilerplate', 'editorial') THEN 'domain:type' END,
  CASE WHEN b.text IS NULL THEN 'missing:text' END, CASE WHEN b.char_start IS NULL OR b.char_end IS NULL OR b.char_end < b.char_start THEN 'span' END], lambda x: x IS NOT NULL)) FROM (SELECT article_id, UNNEST(blocks) AS b FROM clean))"""
)
def clean_problems(spark, folder):
    return corpus.invalid_blocks(runtime.table(spark, folder, "clean"), "article_id")


@query(f"WITH {_CLAIM}, s AS (SELECT author_id || ':' || metric AS id, metric, CASE WHEN support AND stable THEN 'core' WHEN NOT support THEN 'local' ELSE 'ambiguous' END AS status FROM k) SELECT id, CASE WHEN status = 'core' AND metric = 'sent_len_median' THEN 'lint' WHEN status = 'core' THEN 'rules' WHEN status = 'local' THEN 'excluded' ELSE 'unmapped' END AS destination FROM s")
def claim_routes(spark, folder):
    k = decisions.claim_gates(_values(spark, folder), _strata(spark, folder), ["author_id"]).select(F.concat_ws(":", "author_id", "metric").alias("id"), "status", "target", "metric", F.lit(None).cast("string").alias("condition"))
    rules = spark.createDataFrame(
        [("core", "always_on_rule", "sent_len_median", None, "lint", 1), ("core", "always_on_rule", None, None, "rules", 2), ("local", "example", None, None, "excluded", 1)],
        "status string, target string, metric string, condition string, destination string, priority int",
    )
    return review.routed(k, rules).select("id", "destination")


@query(f"WITH {_CLAIM}, s AS (SELECT author_id || ':' || metric AS id, CASE WHEN support AND stable THEN 1 ELSE 0 END AS core FROM k) SELECT id, 'unmapped' AS problem FROM s WHERE core = 0 UNION ALL SELECT 'gone', 'unknown'")
def incomplete_claims(spark, folder):
    k = decisions.claim_gates(_values(spark, folder), _strata(spark, folder), ["author_id"]).select(F.concat_ws(":", "author_id", "metric").alias("id"), "status")
    mapped = k.where("status = 'core'").select("id").unionByName(spark.createDataFrame([("gone",)], "id string"))
    return review.incomplete(k.select("id"), mapped)


@query("SELECT article_id, feature_schema, CASE WHEN feature_schema IS NULL THEN 'unknown' WHEN feature_schema <> '2' THEN 'version_mismatch' ELSE 'match' END AS fit FROM (SELECT DISTINCT article_id, feature_schema FROM features)")
def analyzer_fit(spark, folder):
    f = runtime.table(spark, folder, "features").select("article_id", "feature_schema").distinct()
    mode = F.when(F.col("feature_schema").isNotNull(), "rules")
    return f.withColumn("fit", review.analyzer_match(mode, F.col("feature_schema"), F.lit("rules"), F.lit("2")))


_PROSE = """ps AS (SELECT article_id, block_index, max(text) AS text FROM segments WHERE text IS NOT NULL AND article_id IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {_PROSE} SELECT article_id, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY block_index)) AS INT) AS n_chars, sha256(string_agg(text, chr(10) || chr(10) ORDER BY block_index)) AS h, CAST(sum(length(text) + 2) - max_by(length(text) + 2, block_index) AS INT) AS last_offset FROM ps GROUP BY 1")
def prose_documents(spark, folder):
    one = runtime.table(spark, folder, "segments").where("text is not null and article_id is not null").groupBy("article_id", "block_index").agg(F.max("text").alias("text"))
    segments = one.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("block_index", "text"))).alias("segments"))  # of one article
    d = segments.select("article_id", blocks.prose_document(F.col("segments")).alias("d"))
    return d.select("article_id", F.length("d.text").alias("n_chars"), T.content_hash(F.col("d.text")).alias("h"), F.element_at("d.offsets", -1).alias("last_offset"))


_NS = f"""{_PROSE}, m AS (SELECT article_id, block_index, max(n) AS n FROM (SELECT article_id, block_index, list_sum(list_transform(coalesce(masked, []), lambda x: x.e - x.s)) AS n FROM segments) GROUP BY 1, 2)"""


@query(f"WITH {_NS} SELECT article_id, CAST(sum(len(regexp_extract_all(text, '{T.SENTENCE}'))) AS BIGINT) AS n_sents, CAST(sum(length(replace(text, chr(10), '')) - coalesce(n, 0)) AS BIGINT) AS n_chars FROM ps JOIN m USING (article_id, block_index) GROUP BY 1")
def article_counts(spark, folder):
    s = runtime.table(spark, folder, "segments").where("article_id is not null")
    size = F.aggregate(F.coalesce("masked", F.array().cast("array<struct<s:int,e:int>>")), F.lit(0), lambda acc, x: acc + x["e"] - x["s"])
    one = s.groupBy("article_id", "block_index").agg(F.max("text").alias("text"), F.max(size).alias("n_masked_chars")).where("text is not null")
    return features.article_counts(one, ["article_id"])
