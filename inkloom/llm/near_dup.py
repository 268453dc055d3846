"""Near-duplicate records: exact n-gram Jaccard similarity join by rare-first prefix filtering.

Plan, with no shuffle of all texts, one of prefix n-grams and one of candidate pairs:

1. Each text gets a class, the 64-bit hash of the text, and a sketch; they are written once as a table. Of
   equal texts one row goes on, so that a text that is repeated a million times is compared once.
2. A fixed-size table of n-gram document counts (hashed into ``BUCKETS``) and a list of the hot n-grams
   with their own counts give one global order, rare first. The order affects speed only: any total order
   gives the same pairs.
3. Each class sends the prefix of its ordered n-grams, keyed by n-gram. Within a key, rows are matched
   under the length, positional and suffix filter (bounds on the overlap from the shared n-gram on, and
   on the Hamming distance of what stands before and after it). Hot n-grams are cut into blocks of rows by
   their counts, so that no task holds a whole hot key.
4. Distinct pairs pass a second suffix filter over the whole sets: sketches, as long as the sets ask for, bound
   the Hamming distance.
5. Each remaining pair is verified once on the full sets.

Results are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .bodies import squeezed_bodies
from .vec import gram_sets, intersection_size, slices

#: Entries of the table of n-gram document counts (one byte each when broadcast): a fixed bound.
BUCKETS = 1 << 22
SLICES = 64
#: An n-gram in more documents than this is joined in blocks of about so many rows.
HOT = 1 << 13
#: An n-gram in so many documents of one slice of texts is counted on its own.
LOCAL = 16
#: Most ids (eight bytes each) that are broadcast.
SENT_IDS = 1 << 20
#: Most n-grams a counter of a sketch, on average; a sketch has a power of two of counters, 16 at least.
LOAD = 8
#: Characters of a block of texts; pairs of blocks are compared in rounds.
ROUND_CHARS = 48_000_000
#: Prefix n-grams a partition is made for, and those packed at once.
PART_ROWS, FLUSH = 2_000_000, 1 << 21


class Ranks(NamedTuple):
    """Rank classes by bucket (0 rarest), and the hot n-grams (sorted hashes) with their document counts."""

    table: np.ndarray
    hot: np.ndarray
    counts: np.ndarray

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank class of each n-gram, hot ones last by count, and its number of blocks of rows."""
        cls = self.table[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)]
        blocks = np.ones(len(grams), dtype=np.int64)
        if len(self.hot):
            maybe = np.flatnonzero(cls >= LOCAL)
            at = np.searchsorted(self.hot, grams[maybe])
            at[at == len(self.hot)] = 0
            same = self.hot[at] == grams[maybe]
            where, count = maybe[same], self.counts[at[same]]
            blocks[where] = -(-count // HOT)
            cls = cls.copy()
            cls[where] = np.minimum(255, 192 + np.log2(count).astype(np.int64)).astype(np.uint8)
        return cls, blocks


def rarity(texts: DataFrame, n: int) -> Ranks:
    """Ranks of n-grams over all rows of ``texts(body)``, equal texts given once.

    Each partition sends counts in SLICES fixed-size slices, one byte a bucket (a count above 255 in one
    partition is frequent enough to come last), and the counts of n-grams that are frequent in a slice of
    its texts. An n-gram counts as hot from ``HOT`` documents and ``LOCAL`` a slice on, so that the hot ones are
    at most (characters a slice) / LOCAL, about 131,000, whatever the size of the data.
    """
    width = BUCKETS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.uint32)
        frequent: dict[int, int] = {}
        parts = 0
        for batch in slices(batches, "body"):
            grams, _ = gram_sets(batch.column(0).to_pylist(), n)
            bucket = (grams & np.uint64(BUCKETS - 1)).astype(np.int64)
            here = np.bincount(bucket, minlength=BUCKETS).astype(np.uint32)
            total += here
            parts += 1
            many = grams[here[bucket] >= LOCAL]
            if len(many):
                h, c = np.unique(many, return_counts=True)
                for x, y in zip(h[c >= LOCAL].tolist(), c[c >= LOCAL].tolist()):
                    frequent[x] = frequent.get(x, 0) + y
        if parts:
            for s in range(SLICES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([np.minimum(total[s * width : (s + 1) * width], 255).astype(np.uint8).tobytes()], pa.binary())],
                    names=["slice", "counts"],
                )
            keys = np.array(list(frequent), dtype=np.uint64)
            own = (keys & np.uint64(SLICES - 1)).astype(np.int64)
            values = np.array(list(frequent.values()), dtype=np.uint64)
            for s in range(SLICES):
                held = np.concatenate([[np.uint64(parts)], keys[own == s], values[own == s]]).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([s - SLICES], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["slice", "counts"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = key[0].as_py()
        if place < 0:
            parts, sums = 0, {}
            for batch in batches:
                for counts in batch.column("counts").to_pylist():
                    held = np.frombuffer(counts, dtype=np.uint64)
                    parts += int(held[0])
                    half = (len(held) - 1) // 2
                    for x, y in zip(held[1 : 1 + half].tolist(), held[1 + half :].tolist()):
                        sums[x] = sums.get(x, 0) + y
            hot = sorted((x, y) for x, y in sums.items() if y >= max(HOT, LOCAL * parts))
            out = np.array(hot, dtype=np.uint64).tobytes()
        else:
            total = np.zeros(width, dtype=np.uint64)
            for batch in batches:
                for counts in batch.column("counts").to_pylist():
                    total += np.frombuffer(counts, dtype=np.uint8)
            # Four classes per doubling, exact below eight documents; hot n-grams come after all classes.
            cls = np.where(total < 8, total, np.floor(np.log2(np.maximum(total, 1).astype(np.float64)) * 4) - 4)
            out = np.minimum(cls, 191).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([out], pa.binary())], names=["slice", "classes"])

    merged = texts.select("body").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(merge, "slice int, classes binary")
    table, hot = np.zeros(BUCKETS, dtype=np.uint8), [np.zeros((0, 2), dtype=np.uint64)]
    for row in merged.collect():  # 2 * SLICES rows of bounded size
        if row["slice"] < 0:
            hot.append(np.frombuffer(row["classes"], dtype=np.uint64).reshape(-1, 2))
        else:
            table[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["classes"], dtype=np.uint8)
    pairs = np.concatenate(hot)
    pairs = pairs[np.argsort(pairs[:, 0])]
    return Ranks(table, pairs[:, 0].copy(), pairs[:, 1].astype(np.int64))


def as_given(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows by their column part, each value a partition of its own; ids go to partitions as they are, not by hash."""
    return rows.repartitionById(partitions, "part")


def prefix_rows(classes: DataFrame, n: int, threshold: Fraction, ranks: Ranks, partitions: int) -> DataFrame:
    """(part, rows): the prefix n-grams of each class in rare-first order, packed by partition of the n-gram.

    Packed rows hold (g, id, size, pos); 40 bits of the n-gram's hash are a key good enough, as pairs are verified.

    N-grams that occur in one document only are left out, but keep their position. ``g`` of a hot n-gram
    also holds the cell of a triangular grid of row blocks; each row goes to every cell of its block.
    """
    shared = classes.sparkSession.sparkContext.broadcast(tuple(ranks))  # BUCKETS bytes and a bounded list
    num, den = threshold.numerator, threshold.denominator

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = Ranks(*shared.value)
        held, waiting = [], 0
        for batch in slices(batches, "body"):
            ids = batch.column(0).to_numpy()
            grams, offsets = gram_sets(batch.column(1).to_pylist(), n)
            cls, blocks = order_of.of(grams)
            # Sorting (class, upper bits of the hash) of a text by one 64-bit key; ties end in the same order everywhere.
            key = (cls.astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
            keep, pos, size, owner = [], [], [], []
            for i in range(len(ids)):
                a, b = int(offsets[i]), int(offsets[i + 1])
                m = b - a
                p = m - (m * num + den - 1) // den + 1 if m else 0
                order = np.argsort(key[a:b])[:p] if p * 4 > m else np.argpartition(key[a:b], p)[:p]
                if p * 4 <= m:
                    order = order[np.argsort(key[a:b][order])]
                at = np.flatnonzero(cls[a:b][order] > 1)
                keep.append(order[at] + a)
                pos.append(at)
                size.append(m)
                owner.append(len(at))
            at = np.concatenate(keep) if keep else np.zeros(0, np.int64)
            if not len(at):
                continue
            rows = (grams[at], np.repeat(ids, owner), np.repeat(np.array(size), owner), np.concatenate(pos))
            held.append(_cells(*rows, blocks[at]))
            waiting += len(held[-1][0])
            if waiting >= FLUSH:
                yield _packed(*(np.concatenate(x) for x in zip(*held)), partitions)
                held, waiting = [], 0
        if held:
            yield _packed(*(np.concatenate(x) for x in zip(*held)), partitions)

    return classes.select("id", "body").mapInArrow(emit, "part int, rows binary")


def ordered(major: np.ndarray, minor: np.ndarray, bits: int) -> np.ndarray:
    """Order by major, then minor: by one 64-bit key where minor has so many bits at most and major fits beside it."""
    if len(major) and int(minor.max()) < 1 << bits and int(major.max()) < 1 << 64 - bits:
        return np.argsort(major.astype(np.uint64) << np.uint64(bits) | minor.astype(np.uint64))
    return np.lexsort((minor, major))


def _packed(g, own, sizes, where, partitions: int) -> pa.RecordBatch:
    """One binary a partition: sorted 40-bit keys as differences, numbers of documents, positions; documents once."""
    docs, first, doc = np.unique(own, return_index=True, return_inverse=True)
    key = g >> np.uint64(24)
    part = (key % np.uint64(partitions)).astype(np.int64)
    order = ordered(part, key, 40)
    key, doc, where, part = key[order], doc[order], where[order], part[order]
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    big, far, own_size = ("<u2" if most < 1 << 16 else "<u4" for most in (len(docs), int(where.max(initial=0)), int(sizes.max(initial=0))))
    near = "<u4" if len(docs) and int(docs[-1]) - int(docs[0]) < 1 << 32 else "<i8"
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        p = int(part[a])
        used, mine = np.unique(doc[a:b], return_inverse=True)
        steps = np.diff(key[a:b], prepend=np.uint64(0)).astype("<u8")
        head = np.array([b - a, len(used), int(big[2]) + 16 * int(far[2]) + 256 * int(own_size[2]) + 4096 * int(near[2]), int(docs[used[0]])], dtype="<i8")
        # The first step has 8 bytes; the others 5.
        tail = steps.view(np.uint8).reshape(-1, 8)[:, :5]
        out.append((p, b"".join((head.tobytes(), np.ascontiguousarray(tail.T).tobytes(), mine.astype(big).tobytes(), where[a:b].astype(far).tobytes(), (docs[used] - docs[used[0]]).astype(near).tobytes(), sizes[first[used]].astype(own_size).tobytes()))))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["part", "rows"])


def _unpacked(rows: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(g, id, size, pos) of packed rows."""
    n, m, widths, base = np.frombuffer(rows, "<i8", 4).tolist()
    width, far, own_size, near = (widths >> k & 15 for k in (0, 4, 8, 12))
    at = 32
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :5] = np.frombuffer(rows, np.uint8, 5 * n, at).reshape(5, n).T
    key = np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)
    at += 5 * n
    doc = np.frombuffer(rows, f"<u{width}", n, at)
    at += width * n
    pos = np.frombuffer(rows, f"<u{far}", n, at)
    at += far * n
    ids = np.frombuffer(rows, "<i8" if near == 8 else "<u4", m, at).astype(np.int64) + base
    sizes = np.frombuffer(rows, f"<u{own_size}", m, at + near * m)
    return key, ids[doc], sizes[doc].astype(np.int64), pos.astype(np.int64)


def _cells(g, own, sizes, where, blocks):
    """Copy the rows of hot n-grams to each cell (i, j), i <= j, of their block."""
    cold = blocks <= 1
    if cold.all():
        return [g, own, sizes, where]
    out = [[x[cold] for x in (g, own, sizes, where)]]
    for i in np.flatnonzero(~cold):
        nb = int(blocks[i])
        mine = int((int(own[i]) * 0x9E3779B97F4A7C15 >> 20) % nb)
        other = np.arange(nb, dtype=np.uint64)
        cell = np.minimum(other, mine) * np.uint64(nb) + np.maximum(other, mine) + np.uint64(1)
        salted = g[i] ^ (cell * np.uint64(0xD6E8FEB86659FD93))
        out.append([salted, np.full(nb, own[i]), np.full(nb, sizes[i]), np.full(nb, where[i])])
    return [np.concatenate(x) for x in zip(*out)]


def matched_pairs(rows: DataFrame, threshold: Fraction, partitions: int, blocks: int = 1, across: bool = False) -> DataFrame:
    """(a, b): classes that share a prefix n-gram and pass the length, positional and suffix filter at it.

    With ``across``, only classes of different blocks (id modulo ``blocks``).
    """
    num, den = threshold.numerator, threshold.denominator

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpacked(rows) for batch in batches for rows in batch.column("rows").to_pylist()]
        if not got:
            return
        g, ident, size, pos = (np.concatenate(x) for x in zip(*got))
        del got
        order = ordered(g, size, 24)
        g, ident, size, pos = g[order], ident[order], size[order], pos[order]
        run = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]).astype(np.int64)]))
        # Length filter: in a run, partners to the right have at most size * den / num n-grams.
        span = np.int64(1) << 32
        last = np.searchsorted(run * span + size, run * span + size * den // num, side="right")
        first = np.arange(len(g)) + 1
        for a, b in _expanded(first, last):
            rest_a, rest_b, both = size[a] - pos[a], size[b] - pos[b], size[a] + size[b]
            # Positional filter: at the first shared n-gram, the overlap is at most the smaller rest.
            near = np.minimum(rest_a, rest_b) * (den + num) >= both * num
            # Suffix filter: what stands before and after it differs in at most (1 - t) / (1 + t) of both sizes.
            near &= (np.abs(pos[a] - pos[b]) + np.abs(rest_a - rest_b)) * (den + num) <= both * (den - num)
            x, y = ident[a[near]], ident[b[near]]
            if across:
                apart = x % blocks != y % blocks
                x, y = x[apart], y[apart]
            x, y = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            new = np.ones(len(x), dtype=bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            new &= x != y
            yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], names=["a", "b"])

    return as_given(rows, partitions).mapInArrow(match, "a long, b long")


def _expanded(first: np.ndarray, last: np.ndarray, most: int = 1 << 20):
    """Index pairs (i, j) for j in first[i]:last[i], in pieces of bounded size."""
    count = np.maximum(last - first, 0)
    has = np.flatnonzero(count)
    first, count = first[has], count[has]
    done, total = 0, np.cumsum(count)
    while done < (int(total[-1]) if len(total) else 0):
        end = min(done + most, int(total[-1]))
        # The rows of this piece, and where each begins and ends in it.
        rows = slice(int(np.searchsorted(total, done, side="right")), int(np.searchsorted(total, end - 1, side="right")) + 1)
        begin = np.maximum(total[rows] - count[rows], done)
        size = np.minimum(total[rows], end) - begin
        yield np.repeat(has[rows], size), np.arange(done, end) + np.repeat(first[rows] - (total[rows] - count[rows]), size)
        done = end


def with_sketch(texts: DataFrame, n: int) -> DataFrame:
    """``texts`` and sketch: numbers of n-grams by their hashes modulo the number of counters, modulo 16, two a byte.

    A sketch has one counter for ``LOAD`` / 2 to ``LOAD`` n-grams, so that it tells sets of any size apart (see ``least_apart``).
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            grams, offsets = gram_sets(batch.column("body").to_pylist(), n)
            size = np.diff(offsets)
            width = np.int64(1) << np.ceil(np.log2(np.maximum(size / LOAD, 16))).astype(np.int64)
            ends = np.cumsum(width)
            place = np.repeat(ends - width, size) + ((grams >> np.uint64(24)).astype(np.int64) & np.repeat(width - 1, size))
            counts = (np.bincount(place, minlength=int(ends[-1])) & 15).astype(np.uint8)
            at = np.concatenate([[0], ends // 2]).astype(np.int32)
            packed = pa.py_buffer((counts[::2] | counts[1::2] << 4).tobytes())
            yield batch.append_column("sketch", pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.tobytes()), packed]))

    return texts.mapInArrow(sketch, texts.schema.simpleString()[7:-1].replace(":", " ") + ", sketch binary")


def _counters(sketches: list[bytes], width: int) -> np.ndarray:
    """The counters of sketches of equal length, a row each, added up to ``width`` a row."""
    packed = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1)
    counts = np.empty((len(sketches), 2 * packed.shape[1]), dtype=np.uint8)
    counts[:, ::2], counts[:, 1::2] = packed & 15, packed >> 4
    while counts.shape[1] > width:
        half = counts.shape[1] // 2
        counts = counts[:, :half] + counts[:, half:]
    return counts & 15


def least_apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """A lower bound of the Hamming distance of each pair of sets, by their sketches.

    Each n-gram in which two sets differ changes one counter by one, and no more on the circle of 16. Counters of the longer
    sketch are added up, as moduli are powers of two.
    """
    apart = np.zeros(len(a), dtype=np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)], dtype=np.int64).reshape(-1, 2)
    for one, other in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (one, other)).all(1))
        width = 2 * min(one, other)
        d = (_counters([a[i] for i in at], width) - _counters([b[i] for i in at], width)) & 15
        apart[at] = np.minimum(d, 16 - d).sum(1, dtype=np.int64)
    return apart


def candidate_pairs(matches: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): the distinct matched pairs whose sketches are near enough.

    Pairs go to a's partition at once, for being made distinct and for a's sketch.
    """
    num, den = threshold.numerator, threshold.denominator
    a = classes.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    b = classes.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = least_apart(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())
            ok = pa.array(apart * (num + den) <= batch.column("both").to_numpy() * (den - num))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    pairs = matches.repartition("a").distinct().join(a, "a").join(b, "b")
    return pairs.select("a", "b", (F.col("size_a") + F.col("size_b")).cast("long").alias("both"), "sketch_a", "sketch_b").mapInArrow(near, "a long, b long")


def verified_pairs(pairs: DataFrame, classes: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(a, b, similarity): the candidate pairs whose exact similarity reaches the threshold.

    Where the candidates' ids are few (counted: at most SENT_IDS), they are broadcast, so that only their
    bodies are shuffled; otherwise all bodies are.
    """
    num, den = threshold.numerator, threshold.denominator
    pairs = runtime.materialize(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    if 2 * pairs.count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    bodies = classes.select("id", "body").join(wanted, "id", "left_semi")
    left = bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a"))
    right = bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body_a"):
            ga, oa = gram_sets(batch.column("body_a").to_pylist(), n)
            gb, ob = gram_sets(batch.column("body_b").to_pylist(), n)
            both = np.array([intersection_size(ga[oa[i] : oa[i + 1]], gb[ob[i] : ob[i + 1]]) for i in range(batch.num_rows)], dtype=np.int64)
            union = np.diff(oa) + np.diff(ob) - both
            ok = both * den >= union * num
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array((both / np.maximum(union, 1))[ok])],
                names=["a", "b", "similarity"],
            )

    return pairs.join(left, "a").join(right, "b").select("a", "b", "body_a", "body_b").mapInArrow(verify, "a long, b long, similarity double")


def near_duplicates(bodies: DataFrame, n: int = 5, threshold: float = 0.8, min_chars: int = 20) -> tuple[DataFrame, DataFrame]:
    """Classes and links of near-duplicate texts.

    ``bodies`` has (article_id, body), white space already removed. Bodies below ``min_chars`` and null
    ones take no part; repeated rows count once; an id with several bodies belongs to each one's class.
    Returns members(article_id, id), one row per article and class of equal texts, and links(a, b,
    similarity) between classes with similarity >= threshold. Empty input gives empty results.
    """
    spark = bodies.sparkSession
    t = Fraction(str(threshold))
    kept = bodies.where(F.length("body") >= min_chars).select(
        "article_id", "body", F.xxhash64("body").alias("id"), F.length("body").alias("chars"), F.monotonically_increasing_id().alias("row")
    )
    texts = runtime.materialize(with_sketch(runtime.spread(kept), n), "texts")
    one = first_rows(texts)
    size = one.agg(F.sum("chars")).first()[0] or 0
    sized = one.withColumn("size", F.greatest(F.lit(1), F.col("chars") - (n - 1)))
    pairs = _pairs_in_rounds(one, sized, n, t, rarity(one, n), size)
    return texts.select("article_id", "id").distinct(), verified_pairs(pairs, one, n, t)


def _pairs_in_rounds(one: DataFrame, sized: DataFrame, n: int, t: Fraction, ranks: Ranks, size: int) -> DataFrame:
    """(a, b): candidate pairs of all texts of so many characters.

    Texts that share an n-gram by chance grow with the square of the input, and so would one shuffle of them. So texts are cut
    into blocks of about ``ROUND_CHARS``: each block's prefixes are written once, pairs of blocks are compared one after
    the other, and what the sketches leave of a round is kept while its shuffle is freed.
    """
    spark = one.sparkSession
    blocks = max(1, -(-size // ROUND_CHARS))
    in_round = size if blocks == 1 else 2 * size // blocks
    partitions = max(runtime.shuffle_partitions(spark), math.ceil(in_round * (1 - float(t)) / PART_ROWS))
    if blocks == 1:
        return candidate_pairs(matched_pairs(prefix_rows(one, n, t, ranks, partitions), t, partitions), sized, t)
    of = lambda i: F.pmod("id", F.lit(blocks)) == i
    rows = [runtime.materialize(prefix_rows(one.where(of(i)), n, t, ranks, partitions), "prefix") for i in range(blocks)]
    out = None
    for i in range(blocks):
        for j in range(i, blocks):
            matches = matched_pairs(rows[i] if i == j else rows[i].unionByName(rows[j]), t, partitions, blocks, i != j)
            out = runtime.materialize(candidate_pairs(matches, sized.where(of(i) | of(j)), t), "round", out)
            del matches
            runtime.free_shuffles(spark)
    runtime.drop(*rows)
    return out


def first_rows(texts: DataFrame) -> DataFrame:
    """One row of ``texts(id, row, ...)`` for each id. What is shuffled is ids and row numbers, not texts.

    The rows to leave out are broadcast where they are few (counted: at most SENT_IDS), and joined otherwise.
    """
    first = texts.groupBy("id").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("id", "first")
    more = runtime.materialize(texts.select("id", "row").join(first, "id").where("row <> first").select("row"), "copies")
    return texts.join(F.broadcast(more) if more.count() <= SENT_IDS else more, "row", "left_anti")


def p1_found(spark, folder: str) -> DataFrame:
    """(article_a, article_b): pairs of different articles with 5-gram similarity of at least 0.8."""
    members, links = near_duplicates(squeezed_bodies(runtime.table(spark, folder, "clean")))
    a = members.select(F.col("article_id").alias("x"), F.col("id").alias("a"))
    b = members.select(F.col("article_id").alias("y"), F.col("id").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b").where("x <> y")
    same = a.join(b, a["a"] == b["b"]).where("x < y")
    both = across.select("x", "y").unionByName(same.select("x", "y"))
    return both.select(F.least("x", "y").alias("article_a"), F.greatest("x", "y").alias("article_b")).distinct()
