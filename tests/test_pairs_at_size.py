"""Pairs of the library's own queries: equal to brute force in blocks and rounds, without tables of n-grams."""

import random

import pytest

from inkloom import runtime
from inkloom.llm import near_dup, split_overlap
from inkloom.operators import ngrams, overlap
from inkloom.plans import queries as Q


def grams(t, n):
    t = "".join(t.split())
    return {t[i : i + n] for i in range(len(t) - n + 1)} or ({t} if t else set())


def jaccard(x, y, n):
    x, y = grams(x, n), grams(y, n)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    stock = ["".join(rng.choice("あいうえおかきくけこ") for _ in range(12)) for _ in range(12)]
    out = []
    for i in range(14):
        base = "".join(rng.choice(stock) for _ in range(rng.randint(3, 9)))
        out += [(f"k{i}-{j}", base[:e] + "ん" * bool(e) + base[2 * e :]) for j, e in enumerate((0, 0, 3, 11))]
    return out + [("s", "あい"), ("t", "あ い"), ("e", " "), ("u", "😀あい"), *out[:3]]


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that is written."""
    rows, real = {}, runtime.materialize

    def materialize(df, name, *more):
        out = real(df, name, *more)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(runtime, "materialize", materialize)
    return rows


@pytest.mark.parametrize("above, rounds", [(0.3, 32_000_000), (0.3, 2500), (0.05, 2500), (0.0, 32_000_000)])
def test_cross_pairs_equal_brute_force(spark, texts, monkeypatch, above, rounds):
    monkeypatch.setattr(split_overlap, "ROUND_CHARS", rounds)
    parts = [(k, ("train", "train", "dev", "holdout")[i % 4]) for i, (k, _) in enumerate(dict(texts).items())] + [("k0-0", "dev"), ("k1-1", None), ("none", "train")]
    side = {}
    for k, s in parts:
        side.setdefault(k, set()).add(s)
    body = dict(texts)
    want = {
        (a, b, u, v, round(jaccard(body[a], body[b], 8), 9))
        for a in body for b in body if a < b and jaccard(body[a], body[b], 8) > above
        for u in side[a] for v in side[b] if u and v and u != v
    }
    df, sides = spark.createDataFrame(texts, "k string, text string"), spark.createDataFrame(parts, "k string, side string")
    got = [(*r[:4], round(r["jaccard"], 9)) for r in ngrams.cross_pairs(df, sides, "k", "side", 8, above).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert ngrams.cross_pairs(df, sides.limit(0), "k", "side", 8, above).count() == 0


def test_leak_pairs_write_no_table_of_ngrams(spark, small, written):
    assert Q.QUERIES["leak_pairs"](spark, small).count() > 0
    assert written and max(written.values()) <= 2 * runtime.table(spark, small, "clean").count()


def test_leak_summary_writes_no_table_of_ngrams(spark, small, written):
    assert Q.QUERIES["leak_summary"](spark, small).first()["leaks"] > 0
    assert written and max(written.values()) <= 2 * runtime.table(spark, small, "clean").count()


@pytest.mark.parametrize("rounds", [48_000_000, 2500])
def test_similar_pairs_in_rounds_equal_brute_force(spark, texts, monkeypatch, rounds):
    monkeypatch.setattr(near_dup, "ROUND_CHARS", rounds)
    body = dict(texts)
    want = {(a, b, round(jaccard(body[a], body[b], 5), 9)) for a in body for b in body if a < b and jaccard(body[a], body[b], 5) >= 0.8}
    got = [(r["a"], r["b"], round(r["jaccard"], 9)) for r in ngrams.similar_pairs(spark.createDataFrame(texts, "k string, text string"), "k").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({x for p in want for x in p[:2]}) > 20


def test_near_dup_pairs_write_no_table_of_ngrams(spark, small, written):
    assert Q.QUERIES["near_dup_pairs"](spark, small).count() > 0
    assert written and max(written.values()) <= 2 * runtime.table(spark, small, "clean").count()


def test_edges_connect_what_pairs_connect(spark, texts):
    df = spark.createDataFrame([*texts, *((f"copy{i}", texts[0][1]) for i in range(30))], "k string, text string")
    edges = ngrams.similar_edges(df, "k")
    assert edges.count() < 120 < ngrams.similar_pairs(df, "k").count()
    rows = lambda e: {tuple(r) for r in ngrams.components(e).collect()}
    assert rows(edges) == rows(ngrams.similar_pairs(df, "k"))


def test_near_dup_clusters_write_no_table_of_ngrams(spark, small, written):
    assert Q.QUERIES["near_dup_clusters"](spark, small).count() > 0
    assert written and max(written.values()) <= 2 * runtime.table(spark, small, "clean").count()


def test_partitions_of_ngrams_do_not_follow_shuffle_partitions(spark, texts, monkeypatch):
    """p6: counts by partition rule out hardly any pair where the partitions are many."""
    seen, real = [], split_overlap.matched_records
    monkeypatch.setattr(split_overlap, "matched_records", lambda rows, t, partitions: seen.append(partitions) or real(rows, t, partitions))
    records = spark.createDataFrame([(i, t, i % 2 == 0, i % 2 == 1) for i, (_, t) in enumerate(texts)], "id long, body string, in_train boolean, in_eval boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        split_overlap.gram_pairs(records, 8, split_overlap.Fraction("0.3"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen and max(seen) <= split_overlap.SPREAD


def test_copy_checks_with_few_texts_equal_joins(spark):
    rng = random.Random(5)
    make = lambda k: "".join(rng.choice("abcdeあ😀 \n") for _ in range(k))
    docs = [(i, make(rng.randint(1, 90))) for i in range(40)]
    items = [(i, docs[i][1][:60] + make(9)) for i in range(6)] + [(6, "ab"), (7, " "), (1, "zzzzzz" + docs[9][1])]
    docs += [(3, make(50)), (41, "ab"), (42, "")]
    i, d = spark.createDataFrame(items, "item int, text string"), spark.createDataFrame(docs, "doc int, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for f in (ngrams.jaccard_pairs, ngrams.containments):
        assert rows(f(i, d, "item", "doc", 5, True)) == rows(f(i, d, "item", "doc", 5)) != []
        assert rows(f(i.limit(0), d, "item", "doc", 5, True)) == []
    assert rows(overlap.exact_matches(i, d, "item", "doc", 8, True)) == rows(overlap.exact_matches(i, d, "item", "doc", 8)) != []
    sides = [overlap.signatures(i, "item"), overlap.signatures(d, "doc")]
    assert rows(overlap.minhash_similarity(*sides, "item", "doc", True)) == rows(overlap.minhash_similarity(*sides, "item", "doc")) != []


def test_canonical_articles_write_no_table_of_ngrams(spark, small, written):
    assert Q.QUERIES["canonical_articles"](spark, small).count() > 0
    assert written and max(written.values()) <= 2 * runtime.table(spark, small, "clean").count()
