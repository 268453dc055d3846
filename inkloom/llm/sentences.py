r"""Sentence units in any script, as offsets, all in SQL expressions.

1. Marks that end nothing are masked one character for one by private-use placeholders: points in
   numbers, file names, URLs, initials and abbreviations, and all marks inside quotes or brackets.
2. A separator is inserted after each remaining terminator, by rules of its script; after quotations that
   stand alone; after line breaks that follow complete text.
3. The text is cut at the separators. As masking keeps lengths, lengths give offsets in the original
   text (a running sum over the pieces), and the original text is restored by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime

SEP, DOT, MARK = "", "", ""
# Brackets of one kind share an opener and two or three closers: after no end mark, a point, another mark.
# Kinds of brackets.
KINDS = {
    "a": ("「", "」", ""),
    "b": ("『《【〈", "』》】〉", ""),
    "c": ("（(", "）)", ""),
    "d": ('"“„«‹', '"”“»›', ""),
}
# Terminators that need no space after them, and those of scripts with spaces.
FULL = "。｡．！？।॥։۔؟።"
ALL = FULL + ".!?"
# Abbreviations (before their point) that never end a sentence.
ABBREVIATIONS = (
    "Dr Prof Mr Mrs Ms St No Fig Figs Vol Ch Sec Eq Ver ver cf vs approx Jr Sr Nr Abs bzw usw Bd Hr Fr Str ca evtl ggf inkl vgl "
    "Mme Mlle MM ex env chap डॉ श्री पं"
).split()
# German months, which make a point after a number an ordinal's.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# Verbs of saying after a quotation.
SAYING = "said asked replied answered cried shouted whispered added called wrote".split()

_SPACES = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# What goes on with a sentence after a quotation that could stand alone.
_GOES_ON = "|".join(
    (
        r"[ 　]?(?:と|って|などと|との|という)",
        r"\s*[\p{Ll},،、，;:]",
        r"\s+\p{Lu}[\p{L}\p{M}'-]*(?:\s\p{Lu}[\p{L}'-]*)?\s(?:" + "|".join(SAYING) + r")\b",
        r"(?:[A-Za-z]+|[他她我你它]们?|\p{IsHan}{2,3})(?:一边|一面|说|問|问|答|道|笑|喊)",
        r"\s?(?:라고|라며|이라고|하고|고 )",
        r"\s*(?:कह|पूछ|बोल)",
    )
)


def _pair(kind: str) -> list[tuple[str, str]]:
    opened, closed, code = KINDS[kind]
    inside = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(opened + closed)) + "]*"
    steps = []
    pairs = [("[" + "".join("\\" + c if c in "([" else c for c in opened) + "]", "[" + "".join("\\" + c if c in ")]" else c for c in closed) + "]")]
    if kind == "d":
        pairs = [('"', '"'), ("„", "[“”]"), ("“", "”"), ("[«‹]", "[»›]")]
        insides = ['[^"]*', "[^„“”]*", "[^“”]*", "[^«»‹›]*"]
    else:
        insides = [inside]
    for (o, c), within in zip(pairs, insides):
        steps.append((rf"{o}({within}[{FULL}!?][ \x{{a0}}\x{{202f}}]?){c}", f"{code[0]}$1{code[3]}"))
        steps.append((rf"{o}({within}\.){c}", f"{code[0]}$1{code[2]}"))
        steps.append((rf"{o}({within}){c}", f"{code[0]}$1{code[1]}"))
    steps.append((rf"[{ALL}…](?=[^{code}]*[{code[1:]}])", MARK))
    return steps


def _groups() -> list[tuple[str, list[tuple[str, str]]]]:
    """(condition, steps) in order: steps, (pattern, replacement), run on texts in which the condition is found.

    Each pattern begins with a literal or a class, so that it fails fast.
    """
    space = r"[\s\x{a0}\x{3000}\x{2000}-\x{200a}\x{202f}]"
    point = [
        (r"[.．](?<=[0-9０-９].)(?=[0-9０-９])|\.(?<=[\p{L}\p{N}_]\.)(?=[\p{Ll}\p{N}_/])|\?(?<=[/.\w-]\?)(?=\w)", DOT),
        (rf"\.(?=\.)|\.(?<=[.{DOT}]\.)(?={space}*\p{{Ll}})", DOT),
        (rf"\.(?=[0-9]|{space}|$)(?<=(?:^|[^\p{{L}}\p{{M}}])(?:{'|'.join(ABBREVIATIONS)})\.)", DOT),
        (rf"\.(?<=(?:^|[^\p{{L}}\p{{M}}\p{{N}}.{DOT}])\p{{IsLatin}}\.)(?={space}*\p{{IsLatin}})", DOT),
        (rf"\.(?<=[0-9]\.)(?={space}(?:{'|'.join(MONTHS)}))", DOT),
    ]
    bang = [(r"!(?=!\s)(?<=\s!)|!(?<=\s!!)(?=\s)|!(?<=<!)|!(?=\[)|!(?<=(?:^|\n)!)", MARK)]
    out = [("[.．?]", point), ("!", bang)]
    out += [("[" + KINDS[kind][0].replace("(", r"\(") + "]", _pair(kind)) for kind in KINDS]
    closers = "[」』）)】》〉”’»]*"
    # Separators: scripts without spaces, then scripts with spaces.
    out.append((f"[{FULL}]", [(rf"([{FULL}][{ALL}]*{closers})", f"$1{SEP}")]))
    out.append(("[!?]", [(rf"([!?]+[\"”’»)]*)(?={space}|$|[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsHangul}}])", f"$1{SEP}")]))
    out.append((r"\.", [
        (rf"(\.[\"”’»)]*)(?={space}+(?!\p{{Ll}})(?!{space})|{space}*$)", f"$1{SEP}"),
        (r"\.(?<=[\p{Ll}\p{M}]{2}\.)(?=\p{Lu}\p{Ll})", f".{SEP}"),
        (rf"\.(?<=[\p{{IsHangul}}\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}]\.)(?={space}+\p{{Ll}})", f".{SEP}"),
    ]))
    # Thai: a space parts sentences unless it stands at a name or number.
    out.append((r"[\x{e01}-\x{e5b}]", [(r"([\x{e01}-\x{e5b}])(?=\s+[\x{e01}-\x{e5b}])", f"$1{SEP}"), (r"(ครับ|ค่ะ|คะ)(?=\s)", f"$1{SEP}")]))
    # A Latin quotation that ends with a point ends its sentence if no small letter follows.
    stop = KINDS["d"][2][2]
    out.append((stop, [(rf"({stop})(?={space}+(?!\p{{Ll}})(?!{space})|{space}*$)", f"$1{SEP}")]))
    # Line breaks: after an emoticon, a closing bracket, a Japanese predicate; around markup lines.
    ended = "".join(code[2:] for _, _, code in KINDS.values()) + KINDS["c"][2][1]
    out.append((r"\n", [
        (rf"\n(?<=[\p{{So}}♪♡♥☆★wｗ\x{{1f000}}-\x{{1faff}}\x{{fe0f}}{ended})）たすんるいうくぐつぬぶむだ][ \t\x{{3000}}]{{0,9}}\n)", f"\n{SEP}"),
        (r"\n(?=[ \t]*(?:©|\||!|\{\||\|\}|==|--+|<!--|:::|\[[^\]\n]+\]:))", f"\n{SEP}"),
        (r"(?m)(^[ \t]*(?:\||" + MARK + r"|\{\||==|<!--|-->|\\\w+\{)[^\n]*\n|[=}>]\n|^[^\n|]*\|[^\n|]*\|[^\n]*\n)", f"$1{SEP}"),
    ]))
    # Quotations and brackets that stand alone or after a colon.
    alone = "|".join(f"{c[0]}[^{c}]*{c[3]}" if k == "d" else f"{c[0]}[^{c}]*[{c[2:]}]" for k, (_, _, c) in KINDS.items())
    lone = (rf"(^{space}*|{SEP}{space}*)({alone})(?!\s*{SEP}|{_GOES_ON})", f"$1$2{SEP}")
    after_colon = (rf"([：:]{space}?)({alone})(?!\s*{SEP}|{_GOES_ON})", f"$1$2{SEP}")
    out.append((f"[{''.join(code[2:] for _, _, code in KINDS.values())}]", [lone, lone, lone, after_colon]))
    return out


def with_marks(texts: DataFrame) -> DataFrame:
    """``texts(text, kind, ...)`` and _marked: the text with masks and separators, but for these as long as the text."""
    # Characters of the text that masks stand for are put aside, one for one: only places are taken from marked text.
    own = "[\\x{e000}-\\x{e0ff}]"
    out = texts.withColumn("_marked", F.when(F.col("text").rlike(own), F.regexp_replace("text", own, "¤")).otherwise(F.col("text")))
    for condition, steps in _groups():
        new = F.col("_marked")
        for pattern, to in steps:
            new = F.regexp_replace(new, pattern, to)
        out = out.withColumn("_marked", F.when(F.col("_marked").rlike(condition), new).otherwise(F.col("_marked")))
    return out.withColumn("_marked", F.when(F.col("kind") == "list", F.regexp_replace("text", "\n", f"\n{SEP}")).otherwise(F.col("_marked")))


def with_spans(texts: DataFrame) -> DataFrame:
    """``texts(text, kind, ...)`` and spans, array<struct<sent_start, sent_end>>: the units of each text.

    In a ``list`` text each line is a unit. Ends are exclusive; both count code points. Null text gives
    null, blank text an empty array; columns spans and those that begin with _ are replaced. Each step is a projection of its own, so that no step is evaluated
    once for each use; for the same reason spans are exploded with explode_outer, below which no filter is
    inferred.
    """
    cut = with_marks(texts.drop("spans", "_pieces", "_sizes")).withColumn("_pieces", F.split("_marked", SEP, -1)).drop("_marked")
    cut = cut.withColumn("_sizes", F.transform("_pieces", lambda p: F.struct(F.length(p).alias("all"), (F.length(p) - F.length(F.regexp_replace(p, rf"^{_SPACES}+", ""))).alias("lead"), F.length(F.regexp_replace(p, rf"{_SPACES}+\z", "")).alias("body"))))
    # One pass over the pieces carries the place and the units found so far.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<sent_start:int,sent_end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        unit = F.struct((acc["at"] + p["lead"]).cast("int").alias("sent_start"), (acc["at"] + p["body"]).cast("int").alias("sent_end"))
        return F.struct((acc["at"] + p["all"]).alias("at"), F.when(p["body"] > p["lead"], F.array_append(acc["out"], unit)).otherwise(acc["out"]).alias("out"))

    return cut.withColumn("spans", F.aggregate("_sizes", start, step, lambda acc: acc["out"])).drop("_pieces", "_sizes")


def sentence_units(segments: DataFrame) -> DataFrame:
    """(article_id, block_index, sent_start, sent_end, sentence) of each distinct segment.

    Segments with null text or keys give no rows; repeated rows count once.
    """
    kept = segments.where("article_id is not null and block_index is not null and text is not null").select("article_id", "block_index", "kind", "text").distinct()
    spans = with_spans(kept).select("article_id", "block_index", "text", F.explode_outer("spans").alias("s")).where("s is not null")
    return spans.select(
        "article_id", "block_index", "s.sent_start", "s.sent_end", F.expr("substring(text, s.sent_start + 1, s.sent_end - s.sent_start)").alias("sentence")
    )


def article_lengths(segments: DataFrame) -> DataFrame:
    """(article_id, n_sents, sent_len): the fields of the feature record from these units, one row an article.

    ``sent_len`` is a struct of median, iqr (first and third quartile) and max of the units' lengths in characters.
    Articles without a unit have n_sents 0 and a null sent_len; null ids and repeated rows take no part.
    """
    kept = segments.where("article_id is not null").select("article_id", "block_index", "kind", "text").distinct()
    units = with_spans(kept).select("article_id", F.explode_outer("spans").alias("s"))
    n = F.col("s.sent_end") - F.col("s.sent_start")
    stats = units.groupBy("article_id").agg(F.count("s").alias("n_sents"), F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(n).alias("max"))
    sent_len = F.struct(F.col("q")[1].alias("median"), F.array(F.col("q")[0], F.col("q")[2]).alias("iqr"), F.col("max").cast("int").alias("max"))
    return stats.select("article_id", F.col("n_sents").cast("int").alias("n_sents"), F.when(F.col("n_sents") > 0, sent_len).alias("sent_len"))


def p3_lengths(spark, folder: str) -> DataFrame:
    """(article_id, n_sents, sent_len_median, sent_len_q1, sent_len_q3, sent_len_max) of articles with a features row."""
    segments = runtime.table(spark, folder, "segments").join(runtime.table(spark, folder, "features").select("article_id"), "article_id", "left_semi")
    s = F.col("sent_len")
    return article_lengths(segments).select(
        "article_id", "n_sents", s["median"].alias("sent_len_median"), s["iqr"][0].alias("sent_len_q1"), s["iqr"][1].alias("sent_len_q3"), s["max"].alias("sent_len_max")
    )


def p3_found(spark, folder: str) -> DataFrame:
    """(article_id, block_index, sent_start, sent_end): sentences of segments of articles with a features row.

    Spans are made next to the scan; only they are shuffled.
    """
    segments = runtime.table(spark, folder, "segments").where("article_id is not null and block_index is not null and text is not null")
    known = runtime.table(spark, folder, "features").select("article_id")
    spans = with_spans(runtime.spread(segments.select("article_id", "block_index", "kind", "text"))).select("article_id", "block_index", "spans")
    kept = spans.join(known, "article_id", "left_semi")
    return kept.select("article_id", "block_index", F.explode_outer("spans").alias("s")).where("s is not null").select("article_id", "block_index", "s.sent_start", "s.sent_end").distinct()
