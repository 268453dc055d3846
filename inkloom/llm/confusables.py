"""One consistent form for text that looks the same: confusables skeletons.

A skeleton is made in stages: ignorable characters out, compatibility forms decomposed, every character
replaced by its prototype from the look-alike table, decomposed again. Texts that look the same have equal
skeletons. ``differences`` tells, stage by stage, where a text and its skeleton part; ``replacements`` keeps
the differences that are departures from the consistent form, by what stands around them: a word of another
script is right as it is, one letter of another script within a word is not. Where a word alone doesn't
tell, the words of equal skeleton in all other texts do (``found_kinds``). ``unify`` puts the consistent form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions import text as T

# Cyrillic and Greek letters and the Latin letters they look like.
LATIN = dict(
    zip(
        "аесорхуіјѕһԁԛԝһүгАВЕКМНОРСТХУІЈЅҮԌѴԜԚ" + "οανρυικτχγηωАϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aecopxyijshdqwhyrABEKMHOPCTXYIJSYGVWQ" + "oavpuiktxynwAcjABEZHIKMNOPTYX",
    )
)
# Armenian, Cherokee and Lisu letters and the Latin letters they look like.
LATIN |= dict(zip("օոսհցզյքԼՍՕՏ" + "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃ" + "ꓮꓐꓚꓓꓰꓝꓖꓧꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "onuhgqjpLUOS" + "ABCDEHJKLMPRSTVWZ" + "ABCDEFGHJKLMNOPRSTUVWXYZ"))
# Latin letters outside ASCII that look like ASCII letters.
LATIN |= dict(zip("ıɑɡ", "iag"))


def _latin_variants() -> dict[str, str]:
    """Look-alikes by rule, from character names: small capitals, and letters with a stroke, hook or tail."""
    out = {}
    for code in (*range(0x180, 0x2B0), *range(0x1D00, 0x1DC0), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800)):
        name = unicodedata.name(chr(code), "")
        m = re.fullmatch(r"LATIN LETTER SMALL CAPITAL ([A-Z])|LATIN (SMALL|CAPITAL) LETTER ([A-Z]) WITH (?:.* )?(?:STROKE|HOOK|TAIL|TILDE|SWASH TAIL|BAR|LOOP|DESCENDER)", name)
        if m and len(unicodedata.normalize("NFKD", chr(code))) == 1:
            out[chr(code)] = (m[1] or m[3]).lower() if m[1] or m[2] == "SMALL" else m[3]
    return out


#: Letters by rule; they belong to skeletons, but a word that has them is a word of its own language.
VARIANTS = _latin_variants()
# Kanji and the katakana they look like. Numerals count only between katakana.
KANA = dict(zip("力口工夕卜才二八千三一", "カロエタトオニハチミー"))
NUMERALS = "二八千三一"
KANJI = dict(zip("カロエタトニハ", "力口工夕卜二八"))
# Hiragana that look like katakana.
HIRA = dict(zip("へべぺり", "ヘベペリ"))

# Radicals without a compatibility form and the ideographs they look like.
RADICALS = dict(zip("⺁⺂⺃⺄⺅⺆⺉⺊⺋⺎⺏⺐⺒⺓⺔⺖⺘⺙⺛⺝⺞⺠⺡⺢⺣⺤⺥⺦⺨⺩⺬⺭⺯⺰⺱⺲⺶⺹⺺⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲", "厂乛乚乙亻冂刂卜㔾兀尣尢巳幺彑忄扌攵旡月歺民氵氺灬爫爫丬犭王示礻糹纟罓罒羊耂肀艹艹艹虎衤覀西见角讠贝车辶辶辶阝钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀"))

_KATA = "ァ-ヺー"
_HAN = "㐀-䶿一-鿿々"
_CHAR_KANA = re.compile(
    rf"(?<=[{_KATA}])[{''.join(KANA)}](?=[{_KATA}{''.join(KANA)}])"
    rf"|(?<=[{_KATA}])[力口工夕卜才](?![{_HAN}])|(?<![{_HAN}])[力口工夕卜才](?=[{_KATA}])"
    rf"|(?<=[{_KATA}])[{NUMERALS}](?=[」』）)])"
)
_CHAR_HIRA = re.compile(rf"(?<=[{_KATA}])[{''.join(HIRA)}](?=[{_KATA}])")
_CHAR_KANJI = re.compile(rf"(?<=[{_HAN}])[{''.join(KANJI)}](?![{_KATA}{_HAN}])")
_RADICAL = re.compile(r"[\u2e80-\u2ef3\u2f00-\u2fd5\uf900-\ufaff]")
_RUN = re.compile(rf"[A-Za-zÀ-ɏ{''.join(LATIN)}]+")
_WIDTH = re.compile(r"[\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uff9f\uffa0-\uffdc]")
_INVISIBLE = re.compile(r"[\u00a0\u00ad\u034f\u061c\u115f\u1160\u1680\u180e\u2000-\u200f\u202a-\u202f\u205f-\u2064\u2066-\u206f\u3164\ufeff]")
_SPACES = re.compile(r"[\u00a0\u1680\u2000-\u200a\u202f\u205f]")
_MARKED = re.compile(r"[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u0610-\u061a\u064b-\u065f\u0900-\u0dff\u1100-\u11ff\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099-\u309c\u314f-\u3163]")
_ANY = re.compile(
    "|".join(p.pattern for p in (_RADICAL, _WIDTH, _INVISIBLE, _MARKED)) + f"|[{''.join(c for c in LATIN)}]|[{''.join(KANA)}{''.join(HIRA)}{''.join(KANJI)}]"
)
_PROTOTYPES = LATIN | KANA | HIRA | KANJI | RADICALS
_PROTOTYPED = re.compile(f"[{''.join(_PROTOTYPES)}]|" + _RADICAL.pattern)
# Unicode's default ignorable characters; some only come out when others are decomposed.
_RANGES = (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)
IGNORABLE = {chr(c): "" for a, b in _RANGES for c in range(a, b + 1)}
# Kanji and katakana that look alike have one prototype, the katakana; radicals have that of their ideograph.
_TRANSLATED = str.maketrans(LATIN | VARIANTS | KANA | HIRA | {r: KANA.get(c, c) for r, c in RADICALS.items()} | IGNORABLE)
_JAMO = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"


def _emoji(c: str) -> bool:
    return bool(c) and (unicodedata.category(c) in ("So", "Sk") and ord(c) > 0x203B or c in "\ufe0f\u20e3" or 0x1F000 <= ord(c) <= 0x1FAFF)


def _composed(a: str, b: str) -> str:
    """The one character that a and the mark or letter b make, or an empty string."""
    b = {"\u309b": "\u3099", "\u309c": "\u309a"}.get(b, b)
    if a in _JAMO and "ㅏ" <= b <= "ㅣ":
        return chr(0xAC00 + (_JAMO.index(a) * 21 + ord(b) - 0x314F) * 28)
    if not unicodedata.combining(b) and not "\u1161" <= b <= "\u11c2" and unicodedata.category(b) != "Mc":
        return ""
    c = unicodedata.normalize("NFC", a + b)
    return c if len(c) == 1 else ""


def differences(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, stage, what the stage puts there) where a text and its skeleton part, before context is seen.

    Stages: ignorable (left out, or a plain space), width (compatibility forms of letters, digits and kana),
    composed (a letter and separate marks that one character stands for), prototype (look-alike table, radicals).
    """
    found: list[tuple[int, int, str, str]] = []
    if not text or not _ANY.search(text):
        return found
    for m in _INVISIBLE.finditer(text):
        found.append((m.start(), m.end(), "ignorable", " " if _SPACES.match(m[0]) else ""))
    for m in _WIDTH.finditer(text):
        found.append((m.start(), m.end(), "width", unicodedata.normalize("NFKC", m[0])))
    for m in _MARKED.finditer(text):
        i = m.start()
        if i and (c := _composed(text[i - 1], m[0])):
            found.append((i - 1, i + 1, "composed", c))
        elif "\u0300" <= m[0] <= "\u036f" and i > 1 and unicodedata.combining(text[i - 1]) and (c := _composed(text[i - 2], m[0])):
            found.append((i - 2, i + 1, "composed", c + text[i - 1]))
    for m in _PROTOTYPED.finditer(text):
        found.append((m.start(), m.end(), "prototype", _PROTOTYPES.get(m[0]) or unicodedata.normalize("NFKC", m[0])))
    return found


KINDS = {"ignorable": "invisible", "width": "width", "composed": "combining", "prototype": "lookalike"}


def _words(text: str) -> dict[int, tuple[int, int, int]]:
    """(start, end, letters that are Latin as they stand) of the word around each letter that has a Latin prototype."""
    out = {}
    for m in _RUN.finditer(text):
        other = [i for i, c in enumerate(m[0], m.start()) if c in LATIN]
        out |= dict.fromkeys(other, (m.start(), m.end(), len(m[0]) - len(other)))
    return out


def _neighbours(text: str) -> dict[int, str]:
    """Kana and kanji that stand where only a character of the other kind can, and that character."""
    return {m.start(): table[m[0]] for pattern, table in ((_CHAR_KANA, KANA), (_CHAR_HIRA, HIRA), (_CHAR_KANJI, KANJI)) for m in pattern.finditer(text)}


def replacements(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, consistent form) of each departure from the consistent form, in order.

    Kinds: width, combining, invisible, lookalike. Punctuation and symbols of any width, joiners in emoji
    and in scripts that write with them, and whole words of another script are no departures.
    """
    found = []
    words, kana = None, None
    for a, b, stage, to in differences(text):
        if stage == "ignorable" and text[a] in "\u200c\u200d":
            before, after = text[a - 1 : a] if a else "", text[b : b + 1]
            if text[a] == "\u200d" and _emoji(before) and _emoji(after) or before and unicodedata.combining(before) == 9:  # after a virama
                continue
        if stage == "prototype" and not _RADICAL.match(text[a]):
            words, kana = (_words(text), _neighbours(text)) if words is None else (words, kana)
            if a in kana:
                to = kana[a]
            elif a not in words or words[a][2] < 2:
                continue
        found.append((a, b, KINDS[stage], to))
    return sorted(found)


def doubtful_words(text: str) -> list[str]:
    """Skeletons of words in which one Latin letter stands among look-alikes: alone they could be symbols or a name."""
    if not text or not _ANY.search(text):
        return []
    return [skeleton(text[a:b]).casefold() for a, b, latin in set(_words(text).values()) if latin == 1]


def unify(text: str | None) -> str | None:
    """``text`` in its consistent form; null stays null.

    One departure can hide another, such as a mark after an invisible character: passes go on until none is left
    (or until a form comes again).
    """
    seen = set()
    while text and text not in seen:
        seen.add(text)
        out, end = [], 0
        for a, b, _, to in replacements(text):
            if a >= end:
                out += [text[end:a], to]
                end = b
        text = "".join(out) + text[end:]
    return unicodedata.normalize("NFC", text) if text else text


def skeleton(text: str | None) -> str | None:
    """Equal for texts that look the same: decomposed, prototypes put in, decomposed again."""
    if text is None:
        return None
    s = unicodedata.normalize("NFKD", _INVISIBLE.sub(lambda m: " " if _SPACES.match(m[0]) else "", text))
    return unicodedata.normalize("NFKD", s.translate(_TRANSLATED)).replace(" \u3099", "\u3099").replace(" \u309a", "\u309a")


def _added(texts: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """``texts(text, ...)`` with a column by each function of the text, in place of columns of that name."""
    texts = texts.drop(*columns)
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("text").to_pylist()
            for name, (kind, fn) in columns.items():
                batch = batch.append_column(name, pa.array([fn(t) for t in held], kinds[kind]))
            yield batch

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema] + [f"`{name}` {kind}" for name, (kind, _) in columns.items()]
    return texts.mapInArrow(run, ", ".join(fields))


def with_kinds(texts: DataFrame) -> DataFrame:
    """``texts(text, ...)`` with kinds, the kinds of departures in the text, and doubtful, skeletons of its doubtful words.

    Null and blank texts have none. Columns of these names that were there before are replaced.
    """
    kinds = lambda t: sorted({k for _, _, k, _ in replacements(t)}) if t else []
    return _added(texts, {"kinds": ("array<string>", kinds), "doubtful": ("array<string>", lambda t: doubtful_words(t) if t else [])})


#: Most skeletons of doubtful words that are broadcast.
SENT_WORDS = 1 << 18


def found_kinds(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind: the kinds of departures in texts(keys, text), one row a kind.

    A word with one Latin letter among look-alikes counts as ``lookalike`` if a word of equal skeleton stands in
    plain Latin letters anywhere in the texts. The skeletons asked for are broadcast where they are few (counted).
    """
    kinds = runtime.materialize(with_kinds(texts).where("size(kinds) > 0 or size(doubtful) > 0").select(*keys, "kinds", "doubtful"), "kinds")
    decided = kinds.select(*keys, F.explode("kinds").alias("kind"))
    asked = kinds.select(*keys, F.explode("doubtful").alias("word"))
    words = runtime.materialize(asked.select("word").distinct(), "words")
    few = words.count()
    if few:
        plain = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?<![\\p{L}\\p{M}])[a-z]+(?![\\p{L}\\p{M}])"), F.lit(0))).alias("word"))
        known = plain.join(F.broadcast(words) if few <= SENT_WORDS else words, "word", "left_semi").distinct()
        decided = decided.unionByName(asked.join(known, "word", "left_semi").select(*keys, F.lit("lookalike").alias("kind")))
    return decided.distinct()


def skeleton_groups(texts: DataFrame) -> DataFrame:
    """(skeleton, forms, rows): 128-bit hashes of skeletons that several different texts share, with counts.

    Null texts take no part; equal texts are one form. Hashes are shuffled, not texts, and only counted, so
    that a hot skeleton is no large group.
    """
    made = _added(texts.where("text is not null").select("text"), {"_skeleton": ("string", skeleton)})
    forms = made.select(F.md5("_skeleton").alias("skeleton"), F.md5("text").alias("form")).groupBy("skeleton", "form").agg(F.count("*").alias("n"))
    return forms.groupBy("skeleton").agg(F.count("*").alias("forms"), F.sum("n").alias("rows")).where("forms > 1")


def _segments(spark, folder: str) -> DataFrame:
    segments = runtime.table(spark, folder, "segments").where("article_id is not null and block_index is not null")
    return runtime.spread(segments.select("article_id", "block_index", "text"))


def p4_found(spark, folder: str) -> DataFrame:
    """(article_id, block_index, kind): segments with text built from other characters, one row a kind."""
    return found_kinds(_segments(spark, folder), ["article_id", "block_index"])


def p4_groups(spark, folder: str) -> DataFrame:
    """(skeleton, forms, rows): groups of segments whose different texts look the same."""
    return skeleton_groups(runtime.spread(runtime.table(spark, folder, "segments").select("text")))


def p4_text(spark, folder: str) -> DataFrame:
    """(article_id, block_index, text): the text of each segment in its consistent form, once."""
    return _added(_segments(spark, folder), {"_unified": ("string", unify)}).select("article_id", "block_index", F.col("_unified").alias("text")).distinct()


def p4_scripts(spark, folder: str) -> DataFrame:
    """(article_id, kanji, hiragana, katakana, latin, digit, other): shares of scripts in the consistent form.

    Masked places of a segment are not told apart here, as unifying moves them.
    """
    one = p4_text(spark, folder).withColumn("n", F.struct(*(c.alias(k) for k, c in T.script_counts(F.col("text")).items())))
    sums = one.groupBy("article_id").agg(*(F.sum(F.col("n")[k]).alias(k) for k in (*T.SCRIPTS, "nonspace")))
    share = lambda c: F.when(F.col("nonspace") == 0, 0.0).otherwise(c / F.col("nonspace"))
    rest = F.col("nonspace") - sum((F.col(k) for k in T.SCRIPTS), F.lit(0))
    return sums.select("article_id", *(share(F.col(k)).alias(k) for k in T.SCRIPTS), share(rest).alias("other"))
