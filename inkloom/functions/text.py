"""Text expressions: hashing, character classes, sentence cores and endings, predicates. All built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.isspace has it; the same class works for Java and RE2.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NONSPACE = SPACE.replace("[", "[^", 1)
# Sentence enders, closers, and what is stripped from a sentence's end to give its core.
ENDERS, CLOSERS = "。！？!?", "」』）)】"
CORE_STRIP = "[。！？!?、」』）)】…‥ \\x{3000}]+$"
QUESTION_STRIP = "[」』）)】 \\x{3000}]+$"
# A sentence: its first character is never tested as an ender.
SENTENCE = NONSPACE + f"[^\\n{ENDERS}]*(?:[{ENDERS}]+[{CLOSERS}]*)?"
# Endings by class, tested in this order on the core.
DESU_MASU = "(?:です|ます|ました|でした|ません|でしたら|ましょう|でしょう|ください|ますし|ですし)(?:ね|よ|が|し|けれど|けど)?$"
DA_DEARU = "(?:だ|である|だった|であった|だろう|であろう|ではない|ではなかった)(?:ね|よ|が)?$"
JOTAI_VERB = "(?:た|ない|ず|ている|てる|れる|られる|せる|させる|たい|[うくぐすつぬぶむる])$"
JOTAI_ADJ = "[^な]い$"
ENDINGS = ("desu_masu", "da_dearu", "jotai_verb", "jotai_adj", "taigen", "question", "other")
# Character classes of scripts.
SCRIPTS = {
    "kanji": "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}々]",
    "hiragana": "[\\x{3040}-\\x{309f}]",
    "katakana": "[\\x{30a0}-\\x{30ff}\\x{31f0}-\\x{31ff}]",
    "latin": "[A-Za-zＡ-Ｚａ-ｚ]",
    "digit": "[0-9０-９]",
}
TAIGEN = "(?:" + "|".join(SCRIPTS[k] for k in ("kanji", "katakana", "latin", "digit")) + ")$"
COMMAS = "[、，]"
# Hedge families; a sentence counts once per family.
HEDGES = {
    "darou": "だろう|でしょう",
    "kamo": "かもしれ|かも[。、!！?？]|かも$|かもな",
    "hazu": "はず",
    "youda": "ようだ|ようです|らしい|みたい|ように思|ように見",
    "tabun": "たぶん|多分|おそらく|恐らく|もしかし",
    "toomou": "と思[うっいわえ]|と考え|と感じ",
    "kigasuru": "気がす|気がし|気もす",
}
SPECULATIVE = ("kamo", "hazu", "darou", "youda", "tabun")
QUOTE = "[「『]"
# Patterns of secrets.
SECRETS = {
    "aws_access_key": "AKIA[0-9A-Z]{16}",
    "openai_key": "sk-[A-Za-z0-9_-]{20,}",
    "github_token": "gh[pousr]_[A-Za-z0-9]{20,}",
    "slack_token": "xox[baprs]-[A-Za-z0-9-]{10,}",
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "generic_credential": "(?i)(?:api[_-]?key|secret|token|password)\\s*[:=]\\s*[\"'][A-Za-z0-9_-]{16,}[\"']",
}
PLACEHOLDER_RESIDUE = "\\{\\{[^{}\\n]+\\}\\}"
URL = "https?://" + NONSPACE + "+"


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def article_id_of(stem: Column) -> Column:
    """A file stem with every character outside A-Z, a-z, 0-9, _ and - replaced by -."""
    return F.regexp_replace(stem, "[^A-Za-z0-9_-]", "-")


def sentences(text: Column) -> Column:
    """Array of sentences of a text, trailing white space removed; null gives null."""
    return F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, SPACE + "+$", ""))


def sentence_spans(text: Column) -> Column:
    """Array of (s, e, text) of a text's sentences: places in it, end exclusive, without trailing white space."""
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    # What stands before each sentence: the text is cut at the sentences themselves.
    gaps = F.transform(F.split(text, SENTENCE, -1), lambda g: F.length(g))
    both = F.zip_with(pieces, F.slice(gaps, 1, F.size(pieces)), lambda p, g: F.struct(p.alias("p"), g.alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        kept = F.regexp_replace(x["p"], SPACE + "+$", "")
        return F.struct((s + F.length(x["p"])).alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), (s + F.length(kept)).alias("e"), kept.alias("text"))).alias("out"))

    return F.aggregate(both, start, step, lambda acc: acc["out"])


def sentence_core(sentence: Column) -> Column:
    return F.regexp_replace(sentence, CORE_STRIP, "")


def sentence_end_class(sentence: Column) -> Column:
    """One of seven classes of a sentence's end, without part-of-speech information."""
    core = sentence_core(sentence)
    asked = F.regexp_replace(sentence, QUESTION_STRIP, "")
    return (
        F.when(core == "", "other")
        .when(asked.rlike("[？?]$") | core.rlike("か$"), "question")
        .when(core.rlike(DESU_MASU), "desu_masu")
        .when(core.rlike(DA_DEARU), "da_dearu")
        .when(core.rlike(JOTAI_VERB), "jotai_verb")
        .when(core.rlike(JOTAI_ADJ), "jotai_adj")
        .when(core.rlike(TAIGEN), "taigen")
        .otherwise("other")
    )


def script_counts(text: Column) -> dict[str, Column]:
    """Count of characters of each script, and of all but white space."""
    counts = {k: F.regexp_count(text, F.lit(p)) for k, p in SCRIPTS.items()}
    counts["nonspace"] = F.length(F.regexp_replace(text, SPACE + "+", ""))
    return counts


def hedge_families(sentence: Column) -> Column:
    return F.filter(F.array(*(F.when(sentence.rlike(p), k) for k, p in HEDGES.items())), lambda x: x.isNotNull())


def is_speculative(sentence: Column) -> Column:
    return sentence.rlike("|".join(HEDGES[k] for k in SPECULATIVE))


def register_of(desu_masu: Column, da_dearu: Column, jotai_verb: Column, jotai_adj: Column) -> Column:
    """Register of an article by its shares of endings."""
    return F.when(desu_masu >= 0.5, "desu_masu").when(da_dearu + jotai_verb + jotai_adj >= 0.5, "jotai").otherwise("mixed")


def length_stratum_of(n_chars: Column) -> Column:
    return F.when(n_chars < 800, "short").when(n_chars < 3000, "medium").otherwise("long")


def era_of(published_at: Column) -> Column:
    return F.nullif(F.regexp_extract(published_at, "^([0-9]{4})", 1), F.lit(""))


def excerpt(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def effective_length(text: Column, stop: str = URL) -> Column:
    """Characters of a text that are neither white space nor match the stop pattern."""
    return F.length(F.regexp_replace(F.regexp_replace(text, stop, " "), SPACE + "+", ""))


def unmasked(text: Column, masked: Column) -> Column:
    """The text without its masked spans (array<struct<s, e>>)."""
    ends = F.concat(F.array(F.lit(0)), F.transform(masked, lambda m: m["e"]))
    starts = F.concat(F.transform(masked, lambda m: m["s"]), F.array(F.length(text)))
    return F.when(masked.isNull() | (F.size(masked) == 0), text).otherwise(
        F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(text, p["a"] + 1, F.greatest(p["b"] - p["a"], F.lit(0)))), "")
    )


def raw_offset(raw_map: Column, char_start: Column, offset: Column) -> Column:
    """The raw offset of a prose offset: last map entry that begins at or before it (the first one if none does),
    clamped to its length; without a map the segment's start."""
    before = F.filter(raw_map, lambda m: m["out"] <= offset)
    last = F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(raw_map, F.lit(1)))
    return F.coalesce(last["raw"] + F.when(last["len"] > 0, F.least(offset - last["out"], last["len"])).otherwise(0), char_start)


def raw_span(raw_map: Column, char_start: Column, start: Column, end: Column) -> Column:
    """Struct (s, e): the raw range of a prose range; its end is one after the raw place of the last character."""
    s = raw_offset(raw_map, char_start, start)
    e = raw_offset(raw_map, char_start, F.greatest(end - 1, start)) + 1
    return F.struct(s.cast("int").alias("s"), F.greatest(e, s).cast("int").alias("e"))


def masked_in(masked: Column, start: Column, end: Column) -> Column:
    """The masked spans that overlap a range, clipped to it and counted from its start."""
    hit = F.filter(masked, lambda m: (m["s"] < end) & (m["e"] > start))
    return F.transform(hit, lambda m: F.struct((F.greatest(m["s"], start) - start).cast("int").alias("s"), (F.least(m["e"], end) - start).cast("int").alias("e")))


def windows(text: Column, n: int) -> Column:
    """All runs of n characters. A match at a zero width could begin inside a surrogate pair, which the pattern rules out."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?![\\x{{dc00}}-\\x{{dfff}}])(?=(.{{{n}}}))"), F.lit(1))


def ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams after white space is removed; a shorter text has itself, an empty one none."""
    t = F.regexp_replace(text, SPACE + "+", "")
    short = F.when(t == "", F.array().cast("array<string>")).otherwise(F.array(t))
    return F.when(F.length(t) < n, short).otherwise(F.array_distinct(windows(t, n)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats: 1 if both are empty, 0 if one is."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def containment(a: Column, b: Column) -> Column:
    """The share of a's elements that b has; 0 if a is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
