r"""Markup residue: documents to clean text that keeps headings, lists, code and formulas.

1. Code and formulas are set aside first, one placeholder each, so that no rule runs inside them; they come
   back as fenced or ticked code and as formulas between dollars.
2. ``_Events`` is a streaming parser of the standard library. Its events (known tags, comments, declarations,
   references) decide whether a text holds HTML, and put clean text in the markup's place. LaTeX, wiki and
   Markdown are scanned by rules whose matches are events too; each notes its family.
3. ``content_lines`` selects the content regions of a whole document: text and tags of each line are
   counted from the parser's events, the text-to-tag ratio is smoothed by a Gaussian, and lines are clustered
   by a threshold of the ratios' own spread.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

FAMILIES = ("html", "latex", "markdown", "wiki")
# HTML element names.
TAGS = frozenset(
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav nobr noscript "
    "object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike "
    "strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
# LaTeX commands that take no braces.
COMMANDS = (
    "item alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega sum prod int frac sqrt infty times cdot cdots ldots dots leq geq neq approx "
    "quad qquad par noindent newline newpage clearpage maketitle tableofcontents LaTeX TeX hline centering bigskip medskip smallskip to rightarrow left right"
).split()
_BLOCKS = {"p": "\n\n", "div": "\n", "br": "\n", "tr": "\n", "ul": "\n", "ol": "\n", "table": "\n", "blockquote": "\n\n", "pre": "\n", "section": "\n", "article": "\n"}

_PLAIN_LESS = re.compile(r"<(?!/?[A-Za-z]|!--|!DOCTYPE|!\[CDATA\[)", re.I)
_PLAIN_AND = re.compile(r"&(?!(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)")
_TAG_START = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?=[\s/>]|$)")

# What is set aside before any rule runs: (kind, pattern).
_ATOMS = {
    "fence": r"^[ \t]*(?P<fence_mark>`{3,}|~{3,})[^\n`]*\n(?:.*?\n)??[ \t]*(?P=fence_mark)[`~]*[ \t]*$",
    "pre": r"<pre(?:\s[^>]*)?>.*?</pre\s*>",
    "code": r"<code(?:\s[^>]*)?>.*?</code\s*>",
    "ticks": r"(?<!`)(?P<tick_mark>`+)(?!`)[^\n]*?[^`\n](?P=tick_mark)(?!`)",
    "environment": r"\\begin\{(?P<env>equation|align|gather|math|displaymath)\*?\}.*?\\end\{(?P=env)\*?\}",
    "display": r"\$\$[^$]+\$\$|\\\[[^\n]*?\\\]",
    "inline": r"\\\([^\n]*?\\\)",
    "dollars": (
        r"(?<![\w$\\])\$(?=[^\s\d$]|\d[^$\n]{0,60}[\\^_{}=])(?:[^$\n]{0,80}[\\^_{}=<>+][^$\n]{0,80}|[A-Za-z](?:['′]|\d)?)(?<!\s)\$(?!\d)"
        r"|(?<![\w$\\])\$(?=[^\s$])[^$\n]{0,80}[\\^_{}][^$\n]{0,80}(?<!\s)\$"
    ),
}
_ATOM = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _ATOMS.items()), re.M | re.S | re.A)
_ATOM_SIGNS = re.compile(r"[`~$\\]|<(?:pre|code)", re.I)
_ENVIRONMENT = re.compile(r"^\\begin\{[a-z]+\*?\}|\\end\{[a-z]+\*?\}$")

# Stand for "# " and "- " until all families have run, so that one family's output is no other's input.
_HEAD, _ITEM = "\ue0f0", "\ue0f1"
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327"}

# (pattern, replacement) per family; replacements keep the meaning of headings, lists, code and formulas.
_LATEX = [
    (re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}\n]*)\}"), f"\n{_HEAD}\\1\n"),
    (re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?"), "\n"),
    (re.compile(r"(?<![A-Za-z0-9:\\/])\\item(?:\[[^\]\n]*\])?\s*"), f"\n{_ITEM}"),
    (re.compile(r"\\(['`^\"~])\{?([A-Za-z])\}?"), lambda m: unicodedata.normalize("NFC", m[2] + _ACCENTS[m[1]])),
    (re.compile(r"(?<![A-Za-z0-9:\\/])\\(?:cite|ref|label|eqref|pageref|footnotemark|bibliography|usepackage|documentclass|includegraphics|vspace|hspace)[a-z]*\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"), ""),
    (re.compile(r"(?<![A-Za-z0-9:\\/])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"(?<![A-Za-z0-9:\\/])\\(?:" + "|".join(COMMANDS) + r")(?![A-Za-z])"), lambda m: m[0][1:]),
]
_WIKI = [
    (re.compile(r"\[\[(?:File|Image|Datei|Fichier|ファイル|画像|文件|파일|Category|Kategorie|カテゴリ|分类|分類)\s*:[^\[\]]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}]*\}\}"), lambda m: " ".join(x.strip() for x in m[0][2:-2].split("|")[1:] if "=" not in x)),
    (re.compile(r"(?<!')'{2,5}(?!')([^'\n]+(?:'[^'\n]+)*)(?<!')'{2,5}(?!')"), r"\1"),
    (re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", re.M), f"{_HEAD}\\2"),
    (re.compile(r"^[ \t]*(?:\{\|[^\n]*|\|\}[^\n]*|\|-[^\n]*|\|\+[^\n]*)$", re.M), ""),
    (re.compile(r"^[ \t]*![^\n]*!![^\n]*$|^[ \t]*\|[^\n|]*\|\|[^\n]*$", re.M), lambda m: re.sub(r"\s*(?:\|\||!!)\s*", "\t", m[0].strip(" \t|!"))),
    (re.compile(r"\[https?://[^\s\]]+ ([^\]\n]+)\]"), r"\1"),
    (re.compile(r"</?ref\b[^>]*>|__(?:NO)?TOC__|#(?:REDIRECT|転送)\s*(?=\[\[)", re.I), ""),
]
_CELLS = re.compile(r"(?:^[^\n|]+(?:\|[^\n|]+){2,}$\n?){2,}|(?:^[ \t]*\|(?:[^\n|]*\|){2,}[ \t]*$\n?){1,}", re.M)
_MARKDOWN = [
    (re.compile(r"(?<![A-Za-z0-9:\\])\\([*_`#\[\]~])"), r"\1"),
    (re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n`]*$", re.M), ""),
    (re.compile(r"!\[([^\]\n]*)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\[[^\]\n]*\])"), r"\1"),
    (re.compile(r"(?<!\[)\[([^\[\]\n]+)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)"), r"\1"),
    (re.compile(r"(?<!\[)\[([^\[\]\n^]+)\]\[[^\[\]\n]*\](?!\])"), r"\1"),
    (re.compile(r"^[ ]{0,3}\[[^\]\n]+\]:[ \t]*\S[^\n]*$", re.M), ""),
    (re.compile(r"\[\^[^\]\s]+\]:?"), ""),
    (re.compile(r"<(https?://[^>\s]+|[\w.+-]+@[\w-]+\.[\w.]+)>"), r"\1"),
    (re.compile(r"(?<![*\\A-Za-z0-9])(\*{2,3})(?=[^\s*])([^*\n]*?[^\s*])\1(?!\*)"), r"\2"),
    (re.compile(r"(?<![*\\A-Za-z0-9])\*(?=[^\s*])(?!\d+\*)([^*\n]*?[^\s*])\*(?![*A-Za-z0-9])"), r"\1"),
    (re.compile(r"(?<![_A-Za-z0-9\\])__(?=[^\s_])(?![a-z_]+__)([^\n]*?[^\s_])__(?![_A-Za-z0-9])"), r"\1"),
    (re.compile(r"(?<![_A-Za-z0-9\\])_(?=[^\s_])([^_\n]*?[^\s_])_(?![_A-Za-z0-9])"), r"\1"),
    (re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]+?)~~(?!~)"), r"\1"),
    (re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)(?:[ \t]+#+)?[ \t]*$", re.M), r"# \2"),
    (re.compile(r"^(?=[^\n]*\S)([^\n]+)\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*$", re.M), r"# \1"),
    (re.compile(r"^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M), ""),
    (re.compile(r"^[ ]{0,3}>[ \t]+", re.M), ""),
    (re.compile(r"^[ \t]*(?:[-*+][ \t]+)?\[[ xX]\][ \t]+", re.M), "- "),
    (_CELLS, lambda m: re.sub(r"[ \t]*\|[ \t]*", "\t", m[0])),
]


class _Events(HTMLParser):
    """Text of an HTML fragment with headings, list items and code kept; notes whether markup was met, and on which lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.met = False
        self.skip = 0
        self.tags: dict[int, int] = {}
        self.text: dict[int, int] = {}

    def _tag(self) -> None:
        self.met = True
        line = self.getpos()[0]
        self.tags[line] = self.tags.get(line, 0) + 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in TAGS:
            self.handle_data(self.get_starttag_text() or "")
            return
        self._tag()
        if tag in ("script", "style"):
            self.skip += 1
        self.out.append(f"\n{_HEAD}" if re.fullmatch("h[1-6]", tag) else f"\n{_ITEM}" if tag == "li" else _BLOCKS.get(tag, ""))

    def handle_endtag(self, tag: str) -> None:
        if tag not in TAGS:
            self.handle_data(f"</{tag}>")
            return
        self._tag()
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        self.out.append("\n" if re.fullmatch("h[1-6]", tag) else _BLOCKS.get(tag, ""))

    def handle_data(self, data: str) -> None:
        if "-->" in data:  # the end of a comment that began elsewhere
            self._tag()
            data = data.replace("-->", "")
        if not self.skip:
            self.out.append(data)
            for i, part in enumerate(data.split("\n"), self.getpos()[0]):
                self.text[i] = self.text.get(i, 0) + len(part.strip())

    def handle_comment(self, data: str) -> None:
        self._tag()

    def handle_decl(self, decl: str) -> None:
        self._tag()

    def unknown_decl(self, data: str) -> None:
        self._tag()
        self.out.append(data.removeprefix("CDATA["))

    def handle_entityref(self, name: str) -> None:
        self._reference(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._reference(f"&#{name};")

    def _reference(self, ref: str) -> None:
        text = html.unescape(ref)
        self.met |= ref[1] == "#" or ref[1:] in html5
        self.out.append(text)

    def read(self, text: str) -> _Events:
        """Parse a text. What opens no markup is text; of a tag or comment that doesn't end, the sign is an event."""
        free = _free(text)
        less, amp = next(free), next(free)
        rest = _PLAIN_AND.sub(amp, _PLAIN_LESS.sub(less, text))
        while rest:
            self.feed(rest)
            rest, self.rawdata = self.rawdata, ""
            if not rest:
                break
            m = _TAG_START.match(rest)
            if rest.startswith("<!") or m and m[1].lower() in TAGS:
                self._tag()
                rest = "" if rest.startswith("<!--") else rest[m.end() if m else 2 :]
            else:
                self.handle_data(rest[0])
                rest = rest[1:]
        self.out = ["".join(self.out).replace(less, "<").replace(amp, "&")]
        return self


def _free(text: str) -> Iterator[str]:
    """Private-use characters that the text doesn't hold."""
    return (c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in text)


def _html(text: str) -> tuple[str, bool]:
    """Text without HTML, and whether the parser met any: tags of known elements, comments, references."""
    if "<" not in text and "&" not in text and "-->" not in text:
        return text, False
    events = _Events().read(text)
    return (events.out[0], True) if events.met else (text, False)


def _kept(m: re.Match) -> tuple[str, str]:
    """(clean form, family) of code or a formula that is set aside."""
    kind, found = m.lastgroup, m[0]
    if kind in ("fence", "ticks"):
        return found, "markdown"
    if kind in ("pre", "code"):
        inner = _html(re.sub(r"^<\w+[^>]*>|</\w+\s*>$", "", found))[0]
        return (f"\n```\n{inner.strip(chr(10))}\n```\n" if kind == "pre" else f"`{inner}`"), "html"
    if kind == "environment":
        return f"$${_ENVIRONMENT.sub('', found).strip()}$$", "latex"
    body = found.strip("$") if kind == "dollars" or found[0] == "$" else found[2:-2]
    return (f"$${body.strip()}$$" if kind == "display" else f"${body.strip()}$"), "latex"


def convert(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, families of markup met, in order of name). Null stays null."""
    if not text:
        return text, []
    met: set[str] = set()
    atoms: dict[str, str] = {}
    if _ATOM_SIGNS.search(text):
        free = _free(text)

        def aside(m: re.Match) -> str:
            mark = next(free, None)
            if mark is None:  # more atoms in one text than private-use characters
                return m[0]
            atoms[mark], family = _kept(m)
            met.add(family)
            return mark

        text = _ATOM.sub(aside, text)
    for family, rules in (("latex", _LATEX), ("wiki", _WIKI), ("markdown", _MARKDOWN)):
        for pattern, to in rules:
            text, n = pattern.subn(to, text)
            if n:
                met.add(family)
    text, found = _html(text)
    if found:
        met.add("html")
    if not met:
        return text, []
    text = text.replace(_HEAD, "# ").replace(_ITEM, "- ")
    text = re.sub(r"\n{3,}", "\n\n", text).strip("\n")
    return "".join(atoms.get(c, c) for c in text) if atoms else text, sorted(met)


def content_lines(document: str, sigma: float = 1.5) -> list[int]:
    """Numbers of the lines of a document that belong to content regions.

    Text-to-tag ratio per line from the parser's events, smoothed by a Gaussian; lines from one deviation of
    the ratios on (or their mean, if that is less) are content, and so are lines between two of content and lines
    without a tag that hold text. A document without tags is all content.
    """
    n = document.count("\n") + 1
    events = _Events().read(document)
    if not events.tags:
        return list(range(n))
    ratios = [events.text.get(i, 0) / max(1, events.tags.get(i, 0)) for i in range(1, n + 1)]
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    smooth = []
    for i in range(n):
        parts = [(w, ratios[i + k]) for k, w in zip(range(-reach, reach + 1), kernel) if 0 <= i + k < n]
        smooth.append(sum(w * r for w, r in parts) / sum(w for w, _ in parts))
    mean = sum(smooth) / n
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / n)
    kept = [x >= min(spread, mean) and x > 0 or not events.tags.get(i) and events.text.get(i, 0) > 0 for i, x in enumerate(smooth, 1)]
    return [i for i, k in enumerate(kept) if k or 0 < i < n - 1 and kept[i - 1] and kept[i + 1]]


def clean_article(blocks: list[dict]) -> list[tuple[int, str, list[str]]]:
    """(block_index, clean text, families) of an article's blocks: lines outside its content regions left out.

    Regions are those of the whole article, its blocks joined; code blocks are content and stay as they are.
    """
    texts = [b["text"] or "" for b in blocks]
    content = set(content_lines("\n".join(texts)))
    out, at = [], 0
    for b, text in zip(blocks, texts):
        lines = text.split("\n")
        if b["type"] == "code":
            out.append((b["block_index"], text, []))
        else:
            kept = "\n".join(line for i, line in enumerate(lines, at) if i in content)
            out.append((b["block_index"], *convert(kept)))
        at += len(lines)
    return out


def converted(texts: DataFrame) -> DataFrame:
    """``texts(text, ...)`` with clean and families, in place of columns of these names.

    Null and empty texts have no families.
    """
    texts = texts.drop("clean", "families")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [convert(t) for t in batch.column("text").to_pylist()]
            yield batch.append_column("clean", pa.array([c for c, _ in rows], pa.string())).append_column("families", pa.array([f for _, f in rows], pa.list_(pa.string())))

    return texts.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", clean string, families array<string>")


def _segments(spark, folder: str) -> DataFrame:
    segments = runtime.table(spark, folder, "segments").where("article_id is not null and block_index is not null")
    return converted(runtime.spread(segments.select("article_id", "block_index", "text")))


def p2_found(spark, folder: str) -> DataFrame:
    """(article_id, block_index, family): segments whose text still contains markup, one row a family."""
    return _segments(spark, folder).select("article_id", "block_index", F.explode("families").alias("family")).distinct()


def p2_clean(spark, folder: str) -> DataFrame:
    """(article_id, block_index, clean): clean text of each segment, once."""
    return _segments(spark, folder).select("article_id", "block_index", "clean").distinct()


def p2_articles(spark, folder: str) -> DataFrame:
    """(article_id, block_index, clean, families): clean text of each block of each article, by content regions, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, *x) for a, blocks in zip(batch.column("article_id").to_pylist(), batch.column("blocks").to_pylist()) for x in clean_article([b for b in blocks or () if b])]
            cols = list(zip(*rows)) or [()] * 4
            types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["article_id", "block_index", "clean", "families"])

    slim = F.transform("blocks", lambda b: F.struct(b["block_index"].alias("block_index"), b["type"].alias("type"), b["text"].alias("text")))
    articles = runtime.table(spark, folder, "clean").where("article_id is not null").select("article_id", slim.alias("blocks"))
    return runtime.spread(articles).mapInArrow(run, "article_id string, block_index int, clean string, families array<string>").distinct()
