"""Near-duplicates, split overlaps and leaks against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from inkloom.llm import leaks, near_dup, split_overlap
from inkloom.llm.bodies import squeezed_bodies
from inkloom.llm.vec import code_points, gram_sets

BLOCKS = "article_id string, author_id string, blocks array<struct<block_index:int,type:string,text:string,char_start:int,char_end:int>>"


def clean(spark, texts):
    rows = [(k, "a", None if t is None else [(0, "boilerplate", "# x", 0, 3), (1, "body", t, 4, 5)]) for k, t in texts]
    return spark.createDataFrame(rows, BLOCKS)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        if rng.random() < 0.4:
            out[at] = rng.choice("日月火水木金土😀")
        elif rng.random() < 0.5:
            out.insert(at, rng.choice("abc"))
        else:
            del out[at]
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    stock = ["".join(rng.choice("あいうえおかきくけこさしすせそ") for _ in range(12)) for _ in range(30)]
    out = []
    for i in range(25):
        base = "".join(rng.choice(stock) for _ in range(rng.randint(4, 20)))
        out += [(f"k{i:02d}-{j}", edited(rng, base, e)) for j, e in enumerate((0, 0, 1, 3, 6, 12))]
    out += [("short", "あい"), ("empty", ""), ("null", None), ("same-a", "line one\nline two is here, long enough"), ("same-b", "line one line two is here,  long enough"), ("long", "長い文章の試験" * 4000)]
    return out + out[:5]


def grams(t, n):
    t = "".join((t or "").split())
    return {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= 20 else set()


def similar(texts, n, least, strict=False):
    g = {k: grams(t, n) for k, t in texts}
    ks = sorted(k for k in g if g[k])
    out = {}
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            j = len(g[a] & g[b]) / len(g[a] | g[b])
            if j > least or j == least and not strict:
                out[a, b] = j
    return out


def found(spark, members, links):
    m = {}
    for r in members.collect():
        m.setdefault(r["id"], set()).add(r["article_id"])
    pairs = {tuple(sorted((x, y))) for s in m.values() for x in s for y in s if x != y}
    return pairs | {tuple(sorted((x, y))) for r in links.collect() for x in m[r["a"]] for y in m[r["b"]]}


def test_near_duplicates_equal_brute_force(spark, texts):
    members, links = near_dup.near_duplicates(squeezed_bodies(clean(spark, texts)))
    assert found(spark, members, links) == set(similar(texts, 5, 0.8))


def test_near_duplicates_with_hot_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 3)
    monkeypatch.setattr(near_dup, "LOCAL", 2)
    bodies = squeezed_bodies(clean(spark, texts))
    assert len(near_dup.rarity(bodies.select("body"), 5).hot) > 0
    members, links = near_dup.near_duplicates(bodies)
    assert found(spark, members, links) == set(similar(texts, 5, 0.8))


def test_a_text_repeated_many_times_is_compared_once(spark, texts):
    copies = spark.range(20_000).select(F.concat(F.lit("copy-"), "id").alias("article_id"), F.lit(texts[1][1] + "あ").alias("body"))
    bodies = squeezed_bodies(clean(spark, texts)).unionByName(copies)
    members, links = near_dup.near_duplicates(bodies)
    assert members.groupBy("id").count().agg(F.max("count")).first()[0] >= 20_000 and links.count() < 200
    assert near_dup.first_rows(bodies.selectExpr("*", "xxhash64(body) as id", "monotonically_increasing_id() as row")).count() == bodies.select("body").distinct().count()


def test_near_duplicates_of_an_empty_table_and_clashing_columns(spark, texts):
    members, links = near_dup.near_duplicates(squeezed_bodies(clean(spark, [])))
    assert members.count() == 0 and links.count() == 0
    odd = squeezed_bodies(clean(spark, texts[:12])).withColumns({c: F.lit(1) for c in ("id", "sketch", "chars", "size", "digest")})
    assert found(spark, *near_dup.near_duplicates(odd)) == set(similar(texts[:12], 5, 0.8))


def test_packed_rows_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    g, own = rng.integers(0, 1 << 63, 500).astype(np.uint64), np.sort(rng.integers(0, 1 << 40, 20))[rng.integers(0, 20, 500)]
    sizes, where = own % 70000 + 1, rng.integers(0, 500, 500)
    got = []
    for row in near_dup._packed(g, own, sizes, where, 7).to_pylist():
        key, ident, size, pos = near_dup._unpacked(row["rows"])
        assert (key % np.uint64(7) == row["part"]).all()
        got += list(zip(key.tolist(), ident.tolist(), size.tolist(), pos.tolist()))
    assert sorted(got) == sorted(zip((g >> np.uint64(24)).tolist(), own.tolist(), sizes.tolist(), where.tolist()))


def test_split_overlaps_equal_brute_force(spark, texts):
    rng = random.Random(3)
    split = {k: rng.choice(["train", "train", "dev", "holdout", None]) for k, _ in texts}
    rows = [("a", k, s) for k, s in split.items() if s] + [("a", "k00-0", "train"), ("a", "k00-0", "dev"), ("a", "gone", "train"), ("a", "gone", "holdout"), ("a", None, "dev"), ("a", "k01-0", "odd")]
    splits = spark.createDataFrame(rows, "author_id string, article_id string, split string")
    of = {}
    for _, k, s in rows:
        of.setdefault(k, set()).add(s)
    want = {(k, k, e) for k, s in of.items() if k and "train" in s for e in s & {"dev", "holdout"}}
    for (a, b), _ in similar(texts, 8, 0.3, strict=True).items():
        for x, y in ((a, b), (b, a)):
            if "train" in of.get(x, ()):
                want |= {(a, b, e) for e in of.get(y, set()) & {"dev", "holdout"}}
    got = {tuple(r) for r in split_overlap.split_overlaps(clean(spark, texts), splits).collect()}
    assert got == want


def test_chunks_depend_on_content_only():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefghij日本語") for _ in range(800))
    d, n, at = split_overlap.chunks([a, "xx" + a, a[:300] + "Z" + a[300:], "", "q"])
    sets = [set(d[at[i] : at[i + 1]].tolist()) for i in range(5)]
    assert sum(n[: at[1]]) == len(a) and not sets[3] and len(sets[4]) == 1
    assert len(sets[0] & sets[1]) >= len(sets[0]) - 2 and len(sets[0] & sets[2]) >= len(sets[0]) - 3


ITEM = "The quick analyst measured seventeen hidden rivers before breakfast and wrote every number into a green notebook."
JA = "山の向こうの小さな村では毎年秋になると長い祭りが開かれ、遠くの町からも人が集まってくる。"


def test_leaks(spark):
    typo = ITEM.replace("hidden", "hidten")
    half, rest = ITEM[:60], ITEM[60:]
    docs = [
        (1, "Intro. " + ITEM + " End."),
        (2, "x " + typo.upper()),
        (3, "> " + rest + "\n> and\n> " + half),
        (4, "nothing to see here at all, only other words in a row"),
        (5, None),
        (6, ""),
        (7, "前書き。" + JA[:25] + "あとがき"),
        (8, JA[:12] + "別の話" + JA[20:30]),
        (9, "\u200b".join(JA)),
        (10, ITEM[:40] + " but then it goes elsewhere entirely"),
        (1, "Intro. " + ITEM + " End."),
    ]
    items = [(100, ITEM, "en", "qa"), (101, JA, "ja", "qa"), (102, "too short", "en", "qa"), (103, None, "en", "qa"), (104, "", None, "qa")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, lang string, task string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).collect()}
    assert got == {(1, 100), (2, 100), (3, 100), (7, 101), (9, 101)}
    assert leaks.leaks(d, i.limit(0)).count() == 0 and leaks.leaks(d.limit(0), i).count() == 0


def test_simhash_lookup_finds_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(4)
    index = leaks.Index([(1, "".join(chr(0x3042 + x) for x in rng.integers(0, 40, 300)), True)])
    w = leaks.DENSE[1]
    mine = index.by_window[w][3]
    probes = mine[rng.integers(0, len(mine), 400)].copy()
    for k in range(400):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(bit)
    i, j = index.hits(probes, w)
    want = {(a, b) for a in range(400) for b in range(len(mine)) if int(probes[a] ^ mine[b]).bit_count() <= leaks.RADIUS}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_simhashes_do_not_depend_on_pieces(monkeypatch):
    flat, _ = code_points(["".join(chr(97 + i * i % 23) for i in range(5000))])
    whole = leaks.simhashes(flat, (9, 14))
    monkeypatch.setattr(leaks, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, leaks.simhashes(flat, (9, 14))))


def test_gram_sets():
    g, at = gram_sets(["abcabc", "ab", "", "x" * 10], 3)
    assert (at[1:] - at[:-1]).tolist() == [3, 1, 0, 1] and len(g) == 5


def test_split_overlaps_find_pairs_with_edits_close_together(spark):
    rng = random.Random(11)
    letters = [chr(0x3042 + i) for i in range(60)]
    texts, rows = [], []
    for i in range(120):
        base = [rng.choice(letters) for _ in range((60, 300, 600, 1200)[i % 4])]
        other = list(base)
        for _ in range(len(base) // rng.choice((10, 11, 12, 13))):
            other[rng.randrange(len(base))] = rng.choice(letters)
        if i % 3 == 0:  # the longer record holds text of its own
            other += [rng.choice(letters) for _ in range(len(base) // 2)]
        texts += [(f"t{i:03d}", "".join(base)), (f"u{i:03d}", "".join(other))]
        rows += [("a", f"t{i:03d}", "train"), ("a", f"u{i:03d}", ("dev", "holdout")[i % 2])]
    of = {k: s for _, k, s in rows}
    want = {(a, b, of[b]) for a, b in similar(texts, 8, 0.3, strict=True)}
    got = {tuple(r) for r in split_overlap.split_overlaps(clean(spark, texts), spark.createDataFrame(rows, "author_id string, article_id string, split string")).collect()}
    assert len(want) > 20 and got == want


def test_a_letter_typed_twice_does_not_undo_a_passage(spark):
    item = "".join(chr(0x3042 + (7 * k * k + 3 * k) % 70) for k in range(24))
    docs = spark.createDataFrame([(1, "前" * 9 + item[:12] + item[11] + item[12:] + "後" * 9), (2, item[:12])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, "ja")], "item_id long, text string, lang string")
    assert [(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items).collect()] == [(1, 7)]


def test_blocks_of_items_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 2)
    texts = ["".join(chr(0x4E00 + (k * k * 31 + i * 977 + k) % 900) for k in range(30)) for i in range(5)]
    items = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "item_id long, text string, lang string")
    docs = spark.createDataFrame([(i, "一二三" + t + "四五") for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items).collect()} == {(i, i) for i in range(5)}


def test_sketches_bound_the_distance_and_tell_long_texts_apart(spark):
    from fractions import Fraction

    rng = random.Random(5)
    base = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(k)) for k in (30, 400, 3000, 3000, 6000)]
    texts = base + [edited(rng, t, max(1, len(t) // 80)) for t in base]
    df = spark.createDataFrame([(i, t, len(t) - 4) for i, t in enumerate(texts)], "id long, body string, size int")
    made = near_dup.with_sketch(df, 5)
    sketch = {r["id"]: r["sketch"] for r in made.collect()}
    pairs = [(a, b) for a in range(10) for b in range(10) if a < b]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    apart = near_dup.least_apart([sketch[a] for a, _ in pairs], [sketch[b] for _, b in pairs])
    assert all(x <= len(sets[a] ^ sets[b]) for x, (a, b) in zip(apart.tolist(), pairs))
    near, far = [(i, i + 5) for i in range(1, 5)], [(2, 3), (2, 8), (3, 7), (7, 8)]
    got = near_dup.candidate_pairs(spark.createDataFrame(near + far + near, "a long, b long"), made, Fraction(4, 5))
    assert sorted(map(tuple, got.collect())) == near
    assert near_dup.least_apart([], []).tolist() == []


def test_orders_counts_and_pieces_equal_the_plain_way():
    import numpy as np

    rng = np.random.default_rng(6)
    for top in (1 << 20, 1 << 30):
        a, b = rng.integers(0, 1 << 40, 900) % 50, rng.integers(0, top, 900)
        order = near_dup.ordered(a, b, 24)
        assert list(zip(a[order], b[order])) == sorted(zip(a, b)) and len(set(order.tolist())) == 900
        got, want = split_overlap.counted(b % 70 + top, 1 << 40 if top == 1 << 30 else 1 << 21), np.unique(b % 70 + top, return_counts=True)
        assert all((x == y).all() for x, y in zip(got, want))
    assert [len(x) for x in split_overlap.counted(np.zeros(0, np.int64), 5)] == [0, 0] and not len(near_dup.ordered(a[:0], b[:0], 24))
    first = rng.integers(0, 50, 200)
    last = first + rng.integers(-3, 40, 200)
    pieces = list(near_dup._expanded(first, last, 7))
    assert [p for i, j in pieces for p in zip(i.tolist(), j.tolist())] == [(i, j) for i in range(200) for j in range(first[i], last[i])]
    assert max(len(i) for i, _ in pieces) == 7
