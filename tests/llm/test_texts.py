"""Markup, sentences, look-alikes, site lines, encoding, abuse."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.llm import abuse, bpe, confusables, markup, sentences, site_lines

VOCABULARY = bpe.TOKENIZERS + "/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize(
    "text, families",
    [
        ("<p class=\"x\">a</p> b", ["html"]),
        ("a &amp; b &#8217; c", ["html"]),
        ("<!-- note -->text", ["html"]),
        ("so *true* and **bold** [t](http://e.test)", ["markdown"]),
        ("見出し\n======\n本文", ["markdown"]),
        ("[x][ref] and ![i][ref]", ["markdown"]),
        ("a | b | c\nd | e | f", ["markdown"]),
        ("== 見出し ==\n本文", ["wiki"]),
        ("{| class=\"x\"\n|-\n! a !! b\n| c || d", ["wiki"]),
        ("''斜体'' [[頁|名]] {{出典}}", ["wiki"]),
        (r"\section{A} \emph{b} $x_{2}$", ["latex"]),
        (r"\begin{itemize} \item a \end{itemize}", ["latex"]),
        (r"&lt;b&gt; and \cite{k}", ["html", "latex"]),
        ("cost $5 and $120", []),
        ("area 2*54*2 where x < 3 and R&D in C++ and C#", []),
        (r"C:\temp\new is a path, a_b_c a name, {1, 2} a set, [注] a note (^^)", []),
        ("5 min read | Site", []),
        (None, []),
        ("", []),
    ],
)
def test_markup_families(text, families):
    assert markup.convert(text)[1] == families


def test_markup_keeps_structure():
    assert markup.convert("<h2>T</h2><ul><li>a</li><li>b</li></ul><pre>x &lt; y</pre>")[0].split() == ["#", "T", "-", "a", "-", "b", "```", "x", "<", "y", "```"]
    assert markup.convert("\\section{T}\nE is $E_{0}$.")[0] == "# T\n\nE is $E_{0}$."
    code = "```py\nprint(r'\\alpha {{x}} <b>')\n```"
    assert markup.convert(f"*a*\n{code}\n[[b|c]]")[0] == f"a\n{code}\nc"
    assert markup.convert("`{{x}}` {{cite|kept|k=v}} <code>a &amp; b</code>")[0] == "`{{x}}` kept `a & b`"
    assert markup.convert("\\begin{equation}\nx^2\n\\end{equation} and \\(y\\)")[0] == "$$x^2$$ and $y$"
    assert markup.convert("a < b, c --> d, <b")[1] == ["html"] and markup.convert("1 < 2 & x<y>z")[1] == []
    blocks = [{"block_index": 0, "type": "body", "text": "\n".join(["<a>x</a><a>y</a><a>z</a><a>w</a>"] * 9)}, {"block_index": 1, "type": "code", "text": "<b>*kept*</b>"}, {"block_index": 2, "type": "body", "text": "*A long line of text that is content of the page.*\n" * 8}]
    first, second, third = markup.clean_article(blocks)
    assert len(first[1]) < 20 and second == (1, "<b>*kept*</b>", []) and third[1].startswith("A long line") and third[2] == ["markdown"]
    assert markup.convert("plain  text\n\n\n\nkept")[0] == "plain  text\n\n\n\nkept"


def test_content_lines():
    page = ["<ul><li><a>a</a></li><li><a>b</a></li></ul>"] * 4 + ["<p>" + "long prose " * 40 + "</p>"] * 5 + ["<div><a>x</a><a>y</a></div>"] * 4
    kept = markup.content_lines("\n".join(page))
    assert set(range(4, 9)) <= set(kept) and 0 not in kept and 12 not in kept
    assert markup.content_lines("a\nb") == [0, 1]


def spans(spark, texts, kind="paragraph"):
    df = spark.createDataFrame([(i, t, kind, 0) for i, t in enumerate(texts)], "i int, text string, kind string, spans int")
    return [None if r["spans"] is None else [r["text"][a:b] for a, b in r["spans"]] for r in sentences.with_spans(df).orderBy("i").collect()]


def test_sentences_by_script(spark):
    cases = {
        "He paid 3.50 at Fig. 2 with Dr. Who. Then J. R. Doe left at 9 a.m. At 6 p.m. it ended.": 3,
        "“Ready? Go!” Ann said at noon. Done.": 2,
        "Am 3. März kam z. B. Prof. Ott. „Wo? Hier!“, rief Prof. Ott. Ende.": 3,
        "「行く。」と言った。「帰る。」夜になった。なぜ？！終わり": 5,
        "他说：“好。”走了！冬（不含。）完": 3,
        "왜 했을까?! \"잊었나요?\"라고 묻자 갔다. ver. 1.2에서 봤다.": 3,
        "डॉ. राम आया। \"कहाँ है? चलो!\" कहकर गया।": 2,
        "แมวนอนครับ สุนัขรุ่น 2.5 วิ่งค่ะ": 2,
        "M. Ott disait : « Bien ! Et toi ? » avec joie. Fin.": 2,
        "折り返し、\n続きます\n次の行です。": 2,
        "wrapped in\nthe middle. Next.": 2,
    }
    got = spans(spark, list(cases))
    assert [len(g) for g in got] == list(cases.values()), got
    for text, units in zip(cases, got):
        assert all(u == u.strip() and u for u in units)
        assert "".join("".join(units).split()) == "".join(text.split())


def test_sentences_of_odd_texts(spark):
    assert spans(spark, [None, "", " \n　", "。。。", "no end"]) == [None, [], [], ["。。。"], ["no end"]]
    assert spans(spark, ["a. b\nc"], "list") == [["a. b", "c"]]
    assert len(spans(spark, ["文です。" * 3000])[0]) == 3000


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("ＡＢ１", ["width"] * 3),
        ("ﾃｽﾄ", ["width"] * 3),
        ("e\u0301a", ["combining"]),
        ("か\u3099き゛", ["combining"] * 2),
        ("\u1112\u1161", ["combining"]),
        ("a\u200bb\u00a0c\u00add", ["invisible"] * 3),
        ("p\u0430ge ra\u03bfw", ["lookalike"] * 2),
        ("自動テス卜で ⼿順", ["lookalike"] * 2),
        ("книга αとβ ①㎡！（）　👩\u200d💻 一口にカ行と力学", []),
        ("データの一つ", []),
        ("", []),
    ],
)
def test_replacements(text, kinds):
    assert [k for _, _, k, _ in confusables.replacements(text)] == kinds


def test_unify_and_skeleton():
    assert confusables.unify("p\u0430ge\u00a0ﾊﾞｯｸ か\u3099 \u200bＡ") == "page バック が A"
    assert confusables.unify(None) is None and confusables.skeleton(None) is None
    assert len({confusables.skeleton(x) for x in ("バック", "ﾊﾞｯｸ", "ハ\u3099ック")}) == 1
    assert confusables.unify(confusables.unify("自動テス卜")) == "自動テスト"


def test_skeleton_groups(spark):
    df = spark.createDataFrame([("page",), ("p\u0430ge",), ("page",), (None,), ("x",)], "text string")
    assert [tuple(r)[1:] for r in confusables.skeleton_groups(df).collect()] == [(2, 3)]
    assert confusables.with_kinds(df.withColumn("kinds", F.lit(1))).count() == 5


def test_skeleton_groups_of_radicals_and_all_ignorable_characters(spark):
    alike = [("長い民", "\u2ed1い\u2ea0"), ("葛城", "葛\U000e0100城"), ("a\u2764b", "a\u2764\ufe0fb"), ("ab", "a\uffa0b"), ("卜部", "\u2e8a部"), ("x\u180by", "xy"), ("e\U000e0041f", "ef"), ("t\u0323\u180c\u0307", "t\u0307\u0323")]
    df = spark.createDataFrame([(t,) for pair in alike for t in pair] + [("other",), ("",), (None,)], "text string")
    assert [tuple(r)[1:] for r in confusables.skeleton_groups(df).collect()] == [(2, 2)] * len(alike)
    assert confusables.unify("\u2ed1い\u2ea0") == "長い民" and confusables.unify("葛\U000e0100城") == "葛\U000e0100城"


def test_words_of_equal_skeleton_decide_doubtful_words(spark):
    rows = [(1, "piece \u043ef it"), (2, "the best of all"), (3, "let \u03b1x be"), (4, None), (5, "r\u0430p\u0430l"), (6, "\u041c\u043e\u0441\u043a\u0432\u0430"), (1, "piece \u043ef it")]
    got = confusables.found_kinds(spark.createDataFrame(rows, "k int, text string"), ["k"])
    assert {tuple(r) for r in got.collect()} == {(1, "lookalike"), (5, "lookalike")}
    assert confusables.found_kinds(spark.createDataFrame([], "k int, text string"), ["k"]).count() == 0


def test_skeletons_of_letters_by_rule():
    assert confusables.skeleton("\u1d00\u0253\ua4f4") == confusables.skeleton("abU") and len(confusables.VARIANTS) > 150
    odd = "\u6f22\u30ab\u30ab\u6f22 a\u200b\u0301 \u529b" * 3
    assert confusables.unify(confusables.unify(odd)) == confusables.unify(odd)


def test_sentences_of_texts_that_hold_the_placeholders(spark):
    text = "\ue000a 3.5 b\ue001. Next\ue0f0 one! \ue005"
    plain = "".join("¤" if "\ue000" <= c <= "\ue0ff" else c for c in text)
    df = spark.createDataFrame([(text, "paragraph"), (plain, "paragraph"), (None, "list"), (" ", "list")], "text string, kind string")
    a, b, c, d = (r["spans"] for r in sentences.with_spans(df).collect())
    assert a == b and [text[s["sent_start"] : s["sent_end"]] for s in a][0] == "\ue000a 3.5 b\ue001." and c is None and d == []


def test_lengths_from_sentence_units(spark):
    rows = [("a", 0, "paragraph", "It cost 3.5 Euro. Fine."), ("a", 1, "list", "x y\nz"), ("a", 1, "list", "x y\nz"), ("b", 0, "paragraph", " "), ("c", 0, "paragraph", None), (None, 0, "list", "q")]
    got = {r["article_id"]: r for r in sentences.article_lengths(spark.createDataFrame(rows, "article_id string, block_index int, kind string, text string")).collect()}
    assert got["a"]["n_sents"] == 4 and got["a"]["sent_len"]["max"] == 17 and got["a"]["sent_len"]["median"] == 4.0
    assert got["b"]["n_sents"] == 0 == got["c"]["n_sents"] and got["b"]["sent_len"] is None and set(got) == {"a", "b", "c"}


def test_site_of(spark):
    urls = ["HTTPS://Www.A.example:443/x?y#z", "http://u@b.test", "c.test/path", "", None, "  ", "//d.test/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(site_lines.site_of(F.col("u")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["a.example", "b.test", "c.test", None, None, None, "d.test"]


def test_repeated_lines(spark):
    blocks = "array<struct<block_index:int,type:string,text:string,char_start:int,char_end:int>>"
    rows = [(f"a{i}", [(0, "body", f"本文{chr(0x3042 + i)}の独自の内容です\nＦｏｌｌｏｗ us for {i} stories", 0, 1), (1, "code", "same code here", 0, 1), (2, "quote", "短い12", 0, 1)]) for i in range(5)]
    rows += [("b0", [(0, "body", "Follow us for more stories", 0, 1)]), ("n", None), ("a0", rows[0][1])]
    clean = spark.createDataFrame(rows, f"article_id string, blocks {blocks}")
    manifest = spark.createDataFrame([(f"a{i}", f"https://{'www.' * (i % 2)}s.test/{i}") for i in range(5)] + [("b0", "https://o.test/"), ("n", "https://s.test/"), ("a1", None)], "article_id string, canonical_url string")
    found = site_lines.site_lines(manifest, clean)
    assert {tuple(r) for r in found.collect()} == {(f"a{i}", 0, 1) for i in range(5)}
    cut = site_lines.without_repeated_lines(clean, found).where("block_index = 0 and article_id = 'a3'").first()
    assert cut["text"] == f"本文{chr(0x3042 + 3)}の独自の内容です"
    assert site_lines.site_lines(manifest.limit(0), clean).count() == 0 == site_lines.site_lines(manifest, clean.limit(0)).count()


def test_repeated_lines_equal_brute_force(spark):
    import random

    rng = random.Random(9)
    shared = ["Share this page with friends", "この記事をシェアする", "ｓｈａｒｅ this PAGE with  friends 12", "Written by Someone Else 99", "著者：山田 太郎（2020年）", "abc de", "No. 123456"]
    rows, urls = [], []
    for i in range(120):
        lines = [rng.choice(shared) if rng.random() < 0.4 else "This line is " + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 6))]
        rows.append((f"k{i}", [(0, "body", "\n".join(lines[:3]), 0, 1), (1, rng.choice(["quote", "code"]), "\n".join(lines[3:]), 0, 1)]))
        urls.append((f"k{i}", f"https://site{i % 7}.test/{i}"))
    clean = spark.createDataFrame(rows, "article_id string, blocks array<struct<block_index:int,type:string,text:string,char_start:int,char_end:int>>").repartition(5)
    seen, where = {}, []
    for (k, blocks), (_, url) in zip(rows, urls):
        for at, kind, text, *_ in blocks:
            for n, line in enumerate(text.split("\n") if kind != "code" else ()):
                form = site_lines.template(line)
                if site_lines.letters(form) >= 6:
                    seen.setdefault((url.split("/")[2], form), set()).add(k)
                    where.append((k, at, n, (url.split("/")[2], form)))
    got = site_lines.site_lines(spark.createDataFrame(urls, "article_id string, canonical_url string"), clean)
    assert {tuple(r) for r in got.collect()} == {(k, at, n) for k, at, n, key in where if len(seen[key]) >= 5}


def test_slots_of_templates(spark):
    rows = [("s", 1, f"a{i}", [5, 6, i, 7]) for i in range(20)] + [("s", 2, f"a{i}", [5, 6, i % 3]) for i in range(20)]
    lines = spark.createDataFrame(rows, "site string, leaf long, article_id string, tokens array<int>")
    got = {r["leaf"]: r["n"] for r in site_lines.with_templates(lines).groupBy("leaf").agg(F.count_distinct("template").alias("n")).collect()}
    assert got == {1: 1, 2: 3}


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encoder = bpe.encoder(VOCABULARY)
    known = tokenizers.Tokenizer.from_file(bpe.TOKENIZERS + "/byte_bpe_50k.json")
    known.encode_special_tokens = True

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(list("abcdehiostn  \n*.-'1")), st.characters(blacklist_categories=("Cs",))), max_size=80))
    def same(text):
        ids = encoder.encode(text)
        assert ids == known.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids) == text

    same()
    for text in ("<|endoftext|> x", "*****" * 37, "a" * 4000, " \n\t ", "日本語のトークン"):
        assert encoder.encode(text) == known.encode(text, add_special_tokens=False).ids
    rows = bpe.with_ids(spark.createDataFrame([(1, "hi there", 0), (2, "", 0), (3, None, 0)], "doc_id long, text string, ids int")).orderBy("doc_id").collect()
    assert rows[0]["ids"] == encoder.encode("hi there") and rows[1]["ids"] == [] == rows[2]["ids"]
    assert encoder.offsets(rows[0]["ids"])[-1] == len("hi there")


def untaught():
    return abuse.Learned(np.zeros(0, np.uint64), np.zeros(0, np.float32))


def feature(text, name):
    return abuse.features([text], untaught())[0][abuse.FEATURES.index(name)]


def test_abuse_features_tell_use_from_mention():
    for text in ("You are a worthless moron.", "Halt die Klappe, du V0ll1d10t.", "お前みたいなク・ズは消えろ。", "你这个蠢货，闭嘴。", "Ferme-la, espèce d'i m b é c i l e.", "Vermin, you must be driven out.", "너는 멍청이다, 닥쳐."):
        assert feature("前書き。" + text, "prior") > 0, text
    for text in ("A loser tree merges 4 sorted runs of one process.", "「馬鹿」という語の語源を辞典で調べました。", "ゴミの分別は3種類です。", "カスリキの茶屋です。", "", None):
        assert feature(text, "prior") < 0, text


def test_a_lexicon_is_learned_from_labels_alone(spark):
    odd = [(i, "s", f"Zeile {i}. Ein Grumbolt bist du, Fimzak! Ende.") for i in range(12)]
    plain = [(100 + i, "s", f"Zeile {i}. Ein schöner Tag ist es, mein Freund! Ende.") for i in range(40)]
    docs = spark.createDataFrame(odd + plain, "doc_id long, source string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(100 + i, 0) for i in range(38)], "doc_id long, toxic int")
    got = abuse.scored(docs, abuse.train(docs, labels)).where("score >= 0.5")
    assert {r["doc_id"] for r in got.collect()} == set(range(12))


def test_boosted_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(abuse.FEATURES)))
    x[:, abuse.FEATURES.index("prior")] = 0
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    model = abuse.fit(x[:400], y[:400], np.arange(400) % abuse.FOLDS)
    assert ((model.score(x[400:]) >= 0.5) == y[400:]).mean() > 0.93
    assert (np.diff(model.steps[1]) >= 0).all()
    assert abuse.fit(x[:5], np.zeros(5), np.arange(5)).score(x[:5]).shape == (5,)


def test_abuse_on_tables(spark):
    docs = spark.createDataFrame([(1, "s", "You are a worthless moron."), (2, "s", "Good morning."), (3, None, None), (4, "t", ""), (1, "s", "You are a worthless moron.")], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 1), (3, 0), (9, 1)], "doc_id long, toxic int")
    assert {(r["doc_id"], r["toxic"]) for r in abuse.label_sample(docs, labels).collect()} == {(1, 1), (2, 0)}
    got = abuse.scored(docs, abuse.train(docs, labels))
    assert {r["doc_id"] for r in got.where("score >= 0.5").collect()} == {1}
    assert abuse.scored(docs.limit(0), abuse.train(docs, labels.limit(0))).count() == 0


def test_abuse_features_of_documents_outside_the_lexicons():
    text = "Обычный день. ТЫ ПРОСТО НИКТО!!! Вечер. AAA"
    assert feature(text, "exclaim") == 3 and feature(text, "second") == 1 and feature(text, "capitals") > 0 and feature(text, "prior") < 0
    assert feature("n\u200bi\u200bx da drin é", "undone") > 0


def test_abuse_is_calibrated_with_few_labels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, len(abuse.FEATURES)))
    y = (np.arange(40) % 8 == 0).astype(float)
    x[:, abuse.FEATURES.index("prior")] = np.where(y > 0, 2.0, -3.0)
    steps = abuse.fit(x, y, np.arange(40) % abuse.FOLDS).steps
    assert len(steps[0]) >= 2 and len(set(steps[0].tolist())) == len(steps[0])
    tied = abuse.Boosted().calibrate(np.zeros(4), np.array([0.0, 0.0, 1.0, 1.0]))
    assert tied.steps[1].tolist() == [0.5]
