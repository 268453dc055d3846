"""Evaluation passages in documents: SimHash windows, multi-index Hamming lookup, exact verification.

Windows of an item are as long as the clean part that a shortest passage keeps when a character is
mistyped in its middle. Each window of each document gets a 64-bit SimHash of its character pairs; four
16-bit blocks find every item window within ``RADIUS`` bits (three differing bits leave a block equal).
Windows that agree exactly in all but two characters count as hits. A document with hits at enough places
of an item is verified: exact runs along diagonals, joined over one mistyped character, must cover half
of the item's letters and digits.

Windows as long as whole items can't see half of an item in pieces (the README has figures), so windows have
the length of the shortest passage's clean half.

The items are a stated query set, sent to the executors in blocks of ``BLOCK`` items; ``PASS`` blocks are looked
up in one pass over the documents, whose SimHashes are made once a pass. Documents are neither shuffled
nor collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import runtime
from .vec import code_points, mix, slices

RADIUS = 3
BLOCK, PASS = 5000, 8
#: Shortest passage and window (its clean half) for Japanese and Chinese, and for others.
DENSE, SPACED = (20, 9), (30, 14)
LEAST = 20
#: Code points whose bit planes are held at once.
PIECE = 1 << 16
_PREFIX = re.compile(r"^[ \t　]*(?:(?:[>#*+|•・-]+|//+|\d{1,4}[.):\]|])[ \t　]+|[>|]+)+", re.M)
_OTHER = re.compile(r"[\W_]+")
_DENSE_SCRIPT = re.compile("[぀-ヿ㐀-䶿一-鿿]")


def squeeze(text: str | None) -> str:
    """Letters and digits of a text, one form of case and width, without line prefixes."""
    if not text:
        return ""
    return _OTHER.sub("", unicodedata.normalize("NFKC", _PREFIX.sub("", text)).casefold())


def simhashes(flat: np.ndarray, windows: tuple[int, ...]) -> list[np.ndarray]:
    """64-bit SimHashes of all windows of the given lengths over the code points, by running sums per bit."""
    n = len(flat)
    out = [np.zeros(max(0, n - w + 1), dtype=np.uint64) for w in windows]
    longest = max(windows)
    for at in range(0, n, PIECE):
        part = flat[at : at + PIECE + longest].astype(np.uint64)
        if len(part) < 2:
            break
        pairs = mix(part[:-1] * np.uint64(0x9E3779B97F4A7C15) + part[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(bits) + 1, 64), dtype=np.int16)
        np.cumsum(bits, axis=0, dtype=np.int16, out=sums[1:])  # differences stay right when it wraps
        for w, to in zip(windows, out):
            k = min(PIECE, len(part) - w + 1, len(to) - at)
            if k > 0:
                ones = sums[w - 1 : w - 1 + k] - sums[:k]
                to[at : at + k] = np.packbits(ones * 2 > w - 1, axis=1).view(np.uint64).ravel()
    return out


class Index:
    """Windows of items by the four blocks of their SimHashes."""

    def __init__(self, items: list[tuple[int, str, bool]]) -> None:
        """``items``: (item_id, squeezed text, whether a short passage is enough)."""
        self.items = items
        self.by_window: dict[int, tuple] = {}
        for length, w in (DENSE, SPACED):
            own, pos, prints = [], [], []
            for k, (_, text, dense) in enumerate(items):
                if dense == (w == DENSE[1]) and len(text) >= w:
                    own.append(np.full(len(text) - w + 1, k))
                    pos.append(np.arange(len(text) - w + 1))
                    prints.append(simhashes(code_points([text])[0], (w,))[0])
            if not own:
                continue
            own, pos, prints = np.concatenate(own), np.concatenate(pos), np.concatenate(prints)
            blocks = []
            for b in range(4):
                key = (prints >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                blocks.append((order, np.searchsorted(key[order], np.arange(65537))))
            self.by_window[w] = (length, own, pos, prints, blocks)
        self.codes = [code_points([t])[0] for _, t, _ in items]

    def hits(self, prints: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of print, index of item window) of all pairs within RADIUS bits, each once."""
        _, _, _, mine, blocks = self.by_window[w]
        left, right = [], []
        for b, (order, starts) in enumerate(blocks):
            key = (prints >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
            count = starts[key + 1] - starts[key]
            some = np.flatnonzero(count)
            for a in range(0, len(some), PIECE):
                rows = some[a : a + PIECE]
                c = count[rows]
                i = np.repeat(rows, c)
                j = order[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(starts[key[rows]], c)]
                apart = prints[i] ^ mine[j]
                near = np.bitwise_count(apart) <= RADIUS
                for e in range(b):  # an earlier block has found it
                    near &= (apart >> np.uint64(16 * e) & np.uint64(0xFFFF)) != 0
                left.append(i[near])
                right.append(j[near])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def covered(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray, length: int) -> int:
    """Places of ``item`` in passages of ``doc`` of at least ``length``, along the given diagonals.

    A passage is an exact run, or two runs parted by one mistyped character: a wrong one, two swapped ones,
    or one too many or too few.
    """
    n, m = len(doc), len(item)
    runs: set[tuple[int, int, int]] = set()
    for d in np.unique(np.concatenate([diagonals - 1, diagonals, diagonals + 1])).tolist():
        lo, hi = max(0, -d), min(m, n - d)
        if hi - lo < 2:
            continue
        same = np.concatenate([[0], (doc[lo + d : hi + d] == item[lo:hi]).astype(np.int8), [0]])
        step = np.flatnonzero(np.diff(same))
        runs |= {(int(a) + lo, int(b) + lo, d) for a, b in zip(step[::2], step[1::2])}
    mark = np.zeros(m + 1, dtype=np.int64)
    by_start: dict[int, list[tuple[int, int]]] = {}
    for a, b, d in runs:
        by_start.setdefault(a, []).append((b, d))
    for a, b, d in runs:
        if b - a >= length:
            mark[a] += 1
            mark[b] -= 1
        for gap in (-1, 0, 1, 2):  # a letter typed twice lets the runs overlap by one place
            for end, other in by_start.get(b + gap, ()):
                if (other == d and gap > 0 or abs(other - d) == 1 and gap < 2) and end - a >= length:
                    mark[a] += 1
                    mark[end] -= 1
    return int((np.cumsum(mark)[:m] > 0).sum())


def leaked(texts: list[str | None], indexes: list[Index]) -> list[tuple[int, int, float]]:
    """(index of text, item_id, covered share) of the texts that hold half of an item."""
    flat, offsets = code_points([squeeze(t) for t in texts])
    windows = tuple(sorted({w for index in indexes for w in index.by_window}))
    if not windows or len(flat) < windows[0]:
        return []
    prints = dict(zip(windows, simhashes(flat, windows)))
    return [row for index in indexes for row in _held(flat, offsets, prints, index)]


def _held(flat: np.ndarray, offsets: np.ndarray, prints: dict[int, np.ndarray], index: Index) -> list[tuple[int, int, float]]:
    out = []
    for w in index.by_window:
        length, own, pos, _, _ = index.by_window[w]
        i, j = index.hits(prints[w], w)
        row = np.searchsorted(offsets, i, side="right") - 1
        inside = i + w <= offsets[row + 1]
        i, j, row = i[inside], j[inside], row[inside]
        # Exactly: the windows differ in at most two characters.
        equal = np.zeros(len(i), dtype=np.int64)
        item_flat = np.concatenate(index.codes)
        item_at = np.concatenate([[0], np.cumsum([len(c) for c in index.codes])])
        base = item_at[own[j]] + pos[j]
        for k in range(w):
            equal += flat[i + k] == item_flat[base + k]
        ok = equal >= w - 2
        i, j, row = i[ok], j[ok], row[ok]
        if not len(i):
            continue
        pair = row * len(index.items) + own[j]
        order = np.lexsort((pos[j], pair))
        pair, i, j = pair[order], i[order], j[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        for a, b in zip(first, np.append(first[1:], len(pair))):
            r, k = divmod(int(pair[a]), len(index.items))
            item = index.codes[k]
            at = pos[j[a:b]]
            places = 1 + int((at[1:] != at[:-1]).sum())
            if places * 2 * length < len(item):  # passages that cover half of it leave that many hits
                continue
            doc = flat[offsets[r] : offsets[r + 1]]
            share = covered(doc, item, np.unique(i[a:b] - offsets[r] - at), length) / len(item)
            if share >= 0.5:
                out.append((r, index.items[k][0], share))
    return out


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, share): documents that hold at least half of an item's letters and digits.

    ``documents`` has (doc_id, text), ``items`` (item_id, text, lang). Null and empty texts, null ids and
    items of fewer than ``least`` letters and digits give no rows; repeated rows count once.
    """
    spark = documents.sparkSession
    documents = runtime.spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    queries = items.where("item_id is not null and text is not null").select("item_id", "text", "lang").distinct()
    out = None
    parts = max(1, -(-queries.count() // (BLOCK * PASS)))
    for p in range(parts):
        block = queries if parts == 1 else queries.where(f"pmod(xxhash64(item_id), {parts}) = {p}")
        rows = [(r["item_id"], squeeze(r["text"]), r["lang"] in ("ja", "zh") if r["lang"] else bool(_DENSE_SCRIPT.search(r["text"]))) for r in block.collect()]
        shared = spark.sparkContext.broadcast([r for r in rows if len(r[1]) >= least])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            indexes = [Index(items[a : a + BLOCK]) for a in range(0, len(items), BLOCK)]
            for batch in slices(batches, "text"):
                found = leaked(batch.column("text").to_pylist(), indexes)
                ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([r for r, _, _ in found], pa.int64())), pa.array([k for _, k, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64())],
                    names=["doc_id", "item_id", "share"],
                )

        part = documents.mapInArrow(run, "doc_id long, item_id long, share double")
        out = part if out is None else out.unionByName(part)
    return out


def p8_found(spark, folder: str) -> DataFrame:
    """(doc_id, item_id): see leaks."""
    return leaks(runtime.table(spark, folder, "documents"), runtime.table(spark, folder, "benchmark")).select("doc_id", "item_id").distinct()
