"""Lines repeated within one site: templates in fixed-depth token trees.

1. A line is parsed into tokens of its normalised form (compatibility forms, one case, no white space, no
   digits): pieces of up to ``PIECE`` letters of one script, and runs of signs. It walks a tree of fixed depth:
   site, number of tokens, first token, second token. Lines equal by the problem's definition have equal
   tokens, so they reach the same leaf.
2. Each partition grows its own tree, whose leaves keep up to ``least`` different articles; trees are merged
   leaf by leaf. Only leaves of at least ``least`` articles can hold a repeated line.
3. In such a leaf a place at which the lines have more than ``BRANCH`` different tokens is a wildcard slot. A
   template is the leaf's tokens with its slots; templates that cover ``least`` articles stay. As slots are
   set after merging, they don't depend on the order of lines or partitions.
4. Within these templates a line is repeated if its whole form is that of ``least`` articles (exact check).

A hot site, leaf or line meets no single task with more than its distinct (line, article) pairs of one
partition: all counts are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime

LEAST_ARTICLES = 5
LEAST_LETTERS = 6
TYPES = ("body", "quote", "editorial")
#: Most letters of a token; different tokens at a place of a leaf, above which it is a slot.
PIECE, BRANCH = 4, 8
_SLOTS = re.compile(r"[\s\d]+")
_TOKENS = re.compile(rf"[ぁ-ゖ]{{1,{PIECE}}}|[ァ-ヶー]{{1,{PIECE}}}|[一-鿿々]{{1,{PIECE}}}|[^\W\d_ぁ-ゖァ-ヶー一-鿿々]{{1,{PIECE}}}|[\W\d_]+")


def site_of(url: Column) -> Column:
    """The host of a URL, lower case, without user, port and leading ``www.``; null without a host."""
    host = F.lower(F.regexp_extract(F.trim(url), r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host == "", F.lower(F.regexp_extract(F.trim(url), r"(?i)^\s*((?:[\w-]+\.)+[\w-]+)(?::\d+)?(?:[/?#]|$)", 1))).otherwise(host)
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    return F.when(host != "", host)


def template(line: str) -> str:
    """The line with its slots cut out: NFKC, case folded, no white space, no digits."""
    return _SLOTS.sub("", unicodedata.normalize("NFKC", line).casefold())


def letters(text: str) -> int:
    return sum(map(str.isalpha, text)) if not text.isalpha() else len(text)


def tokens(form: str) -> list[str]:
    """Pieces of letters of one script and runs of signs of a line's form."""
    return _TOKENS.findall(form)


def parsed_lines(articles: DataFrame) -> DataFrame:
    """(article_id, block_index, line_no, leaf, form, tokens): a row per line that can be a template.

    ``leaf`` is a 64-bit hash of the path below the site (number of tokens, first two tokens), ``form`` one of the
    whole form, ``tokens`` 32-bit hashes. Input: (article_id, blocks). Blank and short lines, other block
    types, null blocks and texts give no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def small(token: str) -> int:
            h = known.get(token)
            if h is None:
                if len(known) > 1 << 18:  # a bounded memory of tokens
                    known.clear()
                h = known[token] = xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 31)
            return h

        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for article, blocks in zip(*(batch.column(c).to_pylist() for c in ("article_id", "blocks"))):
                for block in blocks or ():
                    if not block["text"] or block["block_index"] is None:
                        continue
                    for n, line in enumerate(block["text"].split("\n")):
                        t = template(line)
                        if len(t) < LEAST_LETTERS or letters(t) < LEAST_LETTERS:
                            continue
                        form = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
                        path = [small(x) for x in tokens(t)]
                        leaf = hash((len(path), *path[:2])) & 0x7FFFFFFFFFFFFFFF
                        for to, x in zip(rows, (article, block["block_index"], n, leaf, form - (1 << 64) if form >> 63 else form, path)):
                            to.append(x)
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=["article_id", "block_index", "line_no", "leaf", "form", "tokens"])

    wanted = F.filter("blocks", lambda b: b["type"].isin(*TYPES))
    slim = F.transform(wanted, lambda b: F.struct(b["block_index"].alias("block_index"), b["text"].alias("text")))
    return runtime.spread(articles.where("article_id is not null").select("article_id", slim.alias("blocks"))).mapInArrow(
        parse, "article_id string, block_index int, line_no int, leaf long, form long, tokens array<int>"
    )


def live_leaves(lines: DataFrame, least: int = LEAST_ARTICLES) -> DataFrame:
    """(site, leaf): leaves of at least ``least`` different articles, from the merged trees of all partitions."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: dict[tuple, set] = {}
        held = 0
        for batch in batches:
            for key in zip(*(batch.column(c).to_pylist() for c in ("site", "leaf", "article_id"))):
                articles = tree.setdefault(key[:2], set())
                if len(articles) < least and key[2] not in articles:
                    articles.add(key[2])
                    held += 1
            if held > 1_000_000:  # a bounded tree; the rest of the partition grows a new one
                yield _leaves(tree)
                tree, held = {}, 0
        yield _leaves(tree)

    def _leaves(tree: dict[tuple, set]) -> pa.RecordBatch:
        flat = [(*k, list(v)) for k, v in tree.items()]
        cols = list(zip(*flat)) or [(), (), ()]
        types = (pa.string(), pa.int64(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["site", "leaf", "articles"])

    trees = lines.select("site", "leaf", "article_id").mapInArrow(grow, "site string, leaf long, articles array<string>")
    return _covering(trees.select("site", "leaf", F.explode("articles").alias("article_id")), ["site", "leaf"], least)


def _covering(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """The keys of at least ``least`` different articles."""
    return rows.select(*key, "article_id").distinct().groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def with_templates(lines: DataFrame) -> DataFrame:
    """``lines(site, leaf, tokens, ...)`` with template: a hash of the tokens, those in slots left out."""
    seen = lines.select("site", "leaf", F.posexplode("tokens").alias("at", "token")).distinct()
    slots = seen.groupBy("site", "leaf", "at").agg(F.count("*").alias("n")).where(F.col("n") > BRANCH)
    slots = slots.groupBy("site", "leaf").agg(F.collect_list("at").alias("slots"))  # places of one line's tokens
    kept = F.transform("tokens", lambda t, i: F.when(F.array_contains("slots", i), F.lit(None).cast("int")).otherwise(t))
    known = lines.join(slots, ["site", "leaf"], "left")
    return known.withColumn("template", F.xxhash64(F.when(F.col("slots").isNull(), F.col("tokens")).otherwise(kept), F.coalesce("slots", F.array().cast("array<int>")))).drop("slots")


def repeated_lines(lines: DataFrame, least: int = LEAST_ARTICLES) -> DataFrame:
    """(article_id, block_index, line_no) of lines(site, ...) that ``least`` different articles of the site have."""
    live = runtime.materialize(lines.join(live_leaves(lines, least), ["site", "leaf"], "left_semi"), "live")
    known = with_templates(live)
    key = ["site", "leaf", "template"]
    known = known.select(*key, "form", "article_id", "block_index", "line_no").join(_covering(known, key, least), key, "left_semi")
    exact = _covering(known, [*key, "form"], least)
    return known.join(exact, [*key, "form"], "left_semi").select("article_id", "block_index", "line_no").distinct()


def sites_of(manifest: DataFrame) -> DataFrame:
    """(site, article_id): the sites of all URLs of each article; those without URL are left out."""
    return manifest.select(site_of(F.col("canonical_url")).alias("site"), "article_id").where("article_id is not null and site is not null").distinct()


def site_lines(manifest: DataFrame, clean: DataFrame) -> DataFrame:
    """Repeated lines of clean's articles by the sites of manifest. Lines are parsed next to the scan; no text is shuffled."""
    lines = runtime.materialize(parsed_lines(clean).join(sites_of(manifest), "article_id"), "lines")
    return repeated_lines(lines)


def p5_found(spark, folder: str) -> DataFrame:
    """(article_id, block_index, line_no): lines in at least five different articles of the site."""
    return site_lines(runtime.table(spark, folder, "manifest"), runtime.table(spark, folder, "clean"))


def p5_clean(spark, folder: str) -> DataFrame:
    """(article_id, block_index, type, text): the blocks of clean without the repeated lines."""
    return without_repeated_lines(runtime.table(spark, folder, "clean"), p5_found(spark, folder))


def without_repeated_lines(articles: DataFrame, found: DataFrame) -> DataFrame:
    """(article_id, block_index, type, text): blocks with the found lines cut out; emptied blocks stay, empty.

    An article's found lines are one row beside it, so that texts are shuffled once; repeated rows count once.
    """
    line = F.struct(F.col("block_index").alias("b"), F.col("line_no").alias("n"))
    cut = found.groupBy("article_id").agg(F.collect_set(line).alias("_cut"))  # lines of one article
    both = articles.select("article_id", "blocks").join(cut, "article_id", "left").select("article_id", "_cut", F.explode("blocks").alias("b"))
    mine = F.transform(F.filter("_cut", lambda x: x["b"] == F.col("b.block_index")), lambda x: x["n"])
    kept = F.array_join(F.filter(F.split("b.text", "\n", -1), lambda _, i: F.col("_cut").isNull() | ~F.array_contains(mine, i)), "\n")
    return both.select("article_id", "b.block_index", "b.type", kept.alias("text")).distinct()
