"""Records that appear in an evaluation split and in training: content-defined chunks.

A rolling hash of ``WINDOW`` characters cuts each normalised record where the hash is 0 modulo
``MEAN``, so that an edit changes only the chunks it touches. Digests of chunks are joined across
splits; the lengths of shared chunks sum to overlap fractions. A pair goes on if its kept chunks share at
least ``FRACTION`` of the longer record, and is verified exactly by n-gram similarity.

Before the join, chunks are ordered rare first and the most frequent ones left out as long as what is left
out is shorter than ``FRACTION`` of the record. Chunks found on one side only are dropped by a fixed-size
table of both sides' counts; a digest frequent in training is joined in blocks, by its count.

Chunks guarantee nothing for pairs whose edits stand close together, so every record also sends the
rare-first prefix of its n-grams (``gram_pairs``), which no pair above the threshold can escape. Results are
exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .bodies import squeezed_bodies
from .near_dup import FLUSH, SENT_IDS, Ranks, _cells, _expanded, _packed, _unpacked, as_given, ordered, rarity
from .vec import code_points, gram_sets, intersection_size, mix, rolling_hashes, slices

WINDOW = 4
MEAN = 16
#: A pair goes on from the chunk stage if it shares this part of the longer record: the limit of similarity. Pairs of
#: less are found by their n-grams.
FRACTION = 0.3
#: A digest of more training records than this is joined in blocks of about so many.
HOT = 1 << 12
#: Entries of the table of chunk counts, two bytes each when broadcast: a fixed bound.
BUCKETS = 1 << 22
SLICES = 64
#: Characters of all records a partition of prefix n-grams, where the shuffle partitions are fewer.
PART_CHARS = 2_000_000
#: Partitions of n-grams for the sake of cores, at most: the more there are, the less each one's counts tell.
SPREAD = 16
#: Characters of either side that are compared in one round.
ROUND_CHARS = 32_000_000
#: Pairs of rows that share an n-gram, compared at once.
PAIRS = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... base^n modulo 2^64."""
    steps = np.full(n + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests and lengths of the distinct chunks of each text, flat, and the texts' offsets in them."""
    flat, offsets = code_points(texts)
    rolled = rolling_hashes(flat, WINDOW)
    points = rolled % np.uint64(MEAN) == 0
    # Prefix sums of position-free terms give the digest of any chunk in one subtraction and product.
    power, back = (_powers(x, len(flat)) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
    spread = mix(flat.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * power[: len(flat)], dtype=np.uint64)])
    cuts = np.flatnonzero(points) + WINDOW
    cuts = cuts[cuts < offsets[np.searchsorted(offsets, cuts - WINDOW, side="right")]]
    starts = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cuts]))
    ends = np.append(starts[1:], len(flat))[: len(starts)]
    size = ends - starts
    own = np.searchsorted(offsets, starts, side="right") - 1
    d = mix((sums[ends] - sums[starts]) * back[starts] + size.astype(np.uint64))
    order = np.lexsort((d, own))
    d, size, own = d[order], size[order], own[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (own[1:] != own[:-1])
    return d[new], size[new], np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(texts)))])


def _counts(records: DataFrame) -> np.ndarray:
    """Classes of counts of records by chunk bucket for both sides, over all records: two bytes a bucket.

    A class of c stands for about 2 ** (c / 8) - 1 records, and is exact for none; a partition counts up to 255.
    """
    width = BUCKETS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.uint32)
        for batch in slices(batches, "body"):
            d, _, offsets = chunks(batch.column("body").to_pylist())
            b = (d & np.uint64(BUCKETS - 1)).astype(np.int64)
            for side, name in enumerate(("in_train", "in_eval")):
                on = np.repeat(batch.column(name).to_numpy(zero_copy_only=False), np.diff(offsets))
                total[side] += np.bincount(b[on], minlength=BUCKETS).astype(np.uint32)
        if total.any():
            small = np.minimum(total, 255).astype(np.uint8)
            for s in range(SLICES):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([small[:, s * width : (s + 1) * width].tobytes()], pa.binary())], names=["slice", "counts"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * width, dtype=np.uint32)
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                total += np.frombuffer(counts, dtype=np.uint8)
        classes = np.minimum(np.ceil(8 * np.log2(total + 1.0)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([classes.tobytes()], pa.binary())], names=["slice", "counts"])

    rows = records.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(merge, "slice int, counts binary").collect()  # SLICES rows of fixed size
    table = np.zeros((2, BUCKETS), dtype=np.uint8)
    for r in rows:
        table[:, r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], dtype=np.uint8).reshape(2, width)
    return table


def chunk_rows(records: DataFrame, table: np.ndarray) -> DataFrame:
    """(digest, id, total, length, blocks, in_train, in_eval): the chunks of each record that are joined."""
    shared = records.sparkSession.sparkContext.broadcast(table)  # 2 * BUCKETS bytes

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in slices(batches, "body"):
            d, lengths, offsets = chunks(batch.column("body").to_pylist())
            n = np.diff(offsets)
            own = np.repeat(np.arange(len(n)), n)
            b = (d & np.uint64(BUCKETS - 1)).astype(np.int64)
            both = counts[:, b]
            order = np.lexsort((d, np.maximum(both[0], both[1]), own))
            d, lengths, both, own = d[order], lengths[order], both[:, order], own[order]
            upto = np.cumsum(lengths)
            total = np.bincount(own, weights=lengths, minlength=len(n)).astype(np.int64)
            rest = np.cumsum(total)[own] - upto
            keep = (rest + lengths >= FRACTION * total[own]) & (both > 0).all(0)
            at = own[keep]
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(d[keep].view(np.int64)), batch.column("id").take(pick), pa.array(total[at]), pa.array(lengths[keep].astype(np.int64)),
                    pa.array(np.ceil(2.0 ** (both[0][keep] / 8.0) / HOT).astype(np.int32)), batch.column("in_train").take(pick), batch.column("in_eval").take(pick),
                ],
                names=["digest", "id", "total", "length", "blocks", "in_train", "in_eval"],
            )

    return records.mapInArrow(emit, "digest long, id long, total long, length long, blocks int, in_train boolean, in_eval boolean")


def gram_rows(records: DataFrame, n: int, t: Fraction, ranks: Ranks, partitions: int) -> DataFrame:
    """(part, rows): the prefix n-grams of each record in rare-first order, packed by partition of the n-gram.

    The prefix of m n-grams leaves out the last floor(t * m). Packed rows hold (g, id, size, pos), where
    size is 4 * m, plus 1 in train, plus 2 in evaluation. N-grams of one record only keep their position.
    """
    shared = records.sparkSession.sparkContext.broadcast(tuple(ranks))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = Ranks(*shared.value)
        held, waiting = [], 0
        for batch in slices(batches, "body"):
            ids = batch.column("id").to_numpy()
            sides = batch.column("in_train").to_numpy(zero_copy_only=False) + 2 * batch.column("in_eval").to_numpy(zero_copy_only=False).astype(np.int64)
            grams, offsets = gram_sets(batch.column("body").to_pylist(), n)
            cls, blocks = order_of.of(grams)
            key = (cls.astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
            keep, pos = [], []
            for i in range(len(ids)):
                a, b = int(offsets[i]), int(offsets[i + 1])
                m = b - a
                order = np.argsort(key[a:b])[: m - m * t.numerator // t.denominator]
                at = np.flatnonzero(cls[a:b][order] > 1)
                keep.append(order[at] + a)
                pos.append(at)
            count = [len(x) for x in pos]
            if not sum(count):
                continue
            at = np.concatenate(keep)
            held.append(_cells(grams[at], np.repeat(ids, count), np.repeat(4 * np.diff(offsets) + sides, count), np.concatenate(pos), blocks[at]))
            waiting += len(held[-1][0])
            if waiting >= FLUSH:
                yield _packed(*(np.concatenate(x) for x in zip(*held)), partitions)
                held, waiting = [], 0
        if held:
            yield _packed(*(np.concatenate(x) for x in zip(*held)), partitions)

    return records.select("id", "body", "in_train", "in_eval").mapInArrow(emit, "part int, rows binary")


def counted(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values below ``most``, in order, and how often each occurs; sorted in half the width where they fit."""
    values = np.sort(values.astype(np.uint32) if most <= 1 << 32 else values)
    edges = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)) if len(values) else np.zeros(0, np.int64)
    return values[edges - 1].astype(np.int64), np.diff(edges, prepend=0)


def matched_records(rows: DataFrame, t: Fraction, partitions: int) -> DataFrame:
    """(a, b, k, shared): records a in train and b in evaluation that can have a similarity above t, by partition.

    Such a pair shares at least ``least`` = floor(t / (1 + t) * (m_a + m_b)) + 1 n-grams. Of these the first
    k = least - floor(t * max(m_a, m_b)) have more than t * max(m_a, m_b) n-grams at or after them in both
    records, so they lie in both prefixes, and one of the partitions holds at least k / partitions of them.
    ``shared`` counts them where a partition holds as many.
    """
    num, den = t.numerator, t.denominator
    span = np.int64(1) << 32

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpacked(rows) for batch in batches for rows in batch.column("rows").to_pylist()]
        if not got:
            return
        g, ident, size, pos = (np.concatenate(x) for x in zip(*got))
        del got
        ids, doc = np.unique(ident, return_inverse=True)
        side, m = size & 3, size >> 2
        of = np.zeros(len(ids), dtype=np.int64)
        of[doc] = m
        rest = m - pos
        e = np.flatnonzero(side & 2)
        e = e[ordered(g[e], m[e], 24)]
        x = np.flatnonzero(side & 1)
        keys = np.unique(g[e])
        run = np.searchsorted(keys, g[x])
        run[run == len(keys)] = 0
        if not len(keys) or not len(x):
            return
        x, run = x[keys[run] == g[x]], run[keys[run] == g[x]]
        by = np.argsort(doc[x])
        x, run = x[by], run[by]
        place = np.searchsorted(keys, g[e]) * span + m[e]
        # Partners have more than t * m_a n-grams, and fewer than what a has from here on / t.
        first = np.searchsorted(place, run * span + m[x] * num // den, side="right")
        last = np.searchsorted(place, run * span + (-(-rest[x] * den // num) if num else span - 1), side="left")
        doc_x, doc_e, rest_e, m_x = doc[x], doc[e], rest[e] * den, m[x] * num
        del g, ident, size, pos, doc, side, m, rest, place, run
        # Whole records of train a piece, so that all n-grams that a pair shares here are counted at once.
        cost = np.cumsum(np.maximum(last - first, 0))
        ends = np.append(np.flatnonzero(doc_x[1:] != doc_x[:-1]) + 1, len(x))
        start = 0
        while start < len(x):
            before = int(cost[start - 1]) if start else 0
            one, fit = np.searchsorted(ends, start, side="right"), np.searchsorted(cost[ends - 1], before + PAIRS, side="right")
            end = int(ends[max(one, fit - 1)])
            pairs = []
            for i, j in _expanded(first[start:end], last[start:end], PAIRS):
                i = i + start
                near = rest_e[j] > m_x[i]
                pairs.append((doc_x[i[near]] - doc_x[start]) * len(ids) + doc_e[j[near]])
            base, most = int(doc_x[start]), (int(doc_x[end - 1]) - int(doc_x[start]) + 1) * len(ids)
            start = end
            pair, count = counted(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), most)
            a, b = np.divmod(pair, len(ids))
            a += base
            least = (of[a] + of[b]) * num // (num + den) + 1
            k = least - np.maximum(of[a], of[b]) * num // den
            ok = (a != b) & (count * partitions >= k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]]), pa.array(k[ok]), pa.array(count[ok])], names=["a", "b", "k", "shared"])

    return as_given(rows, partitions).mapInArrow(match, "a long, b long, k long, shared long")


def gram_pairs(records: DataFrame, n: int, t: Fraction) -> DataFrame:
    """(a, b), distinct: all pairs of a training and an evaluation record that can have a similarity above t.

    Records that share an n-gram grow with the square of the input, and counts by partition tell less the more partitions
    there are. So blocks of both sides are compared in rounds, each with few partitions; only the pairs that are left
    are kept, and a round's shuffle is freed before the next.
    """
    spark = records.sparkSession
    chars = F.length("body")
    sizes = records.agg(F.sum(F.when(F.col("in_train"), chars)), F.sum(F.when(F.col("in_eval"), chars))).first()
    rounds_a, rounds_b = (max(1, -(-(size or 0) // ROUND_CHARS)) for size in sizes)
    ranks, out = rarity(records, n), None
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k))
    for i in range(rounds_a):
        for j in range(rounds_b):
            part = records.withColumn("in_train", F.col("in_train") & (block(rounds_a) == i)).withColumn("in_eval", F.col("in_eval") & (block(rounds_b) == j))
            found = _round(part.where("in_train or in_eval"), n, t, ranks, (sizes[0] or 0) // rounds_a + (sizes[1] or 0) // rounds_b)
            if rounds_a * rounds_b == 1:
                return found
            out = runtime.materialize(found, "round", out)
            del found, part
            runtime.free_shuffles(spark)
    return out


def _round(records: DataFrame, n: int, t: Fraction, ranks: Ranks, size: int) -> DataFrame:
    """gram_pairs of records of about so many characters."""
    partitions = max(min(SPREAD, runtime.cores(records.sparkSession)), -(-size // PART_CHARS))
    parts = matched_records(gram_rows(records, n, t, ranks, partitions), t, partitions)
    # A partition that does not give the pair holds fewer than k / partitions of its n-grams.
    unseen = (F.lit(partitions) - F.count("*")) * (F.ceil(F.max("k") / partitions) - 1)
    return parts.groupBy("a", "b").agg((F.sum("shared") + unseen >= F.max("k")).alias("may")).where("may").select("a", "b")


def overlapping_records(records: DataFrame, n: int, above: float) -> DataFrame:
    """(a, b, similarity): classes a with a training record and b with an evaluation record, a <> b.

    ``records`` has (id, body, in_train, in_eval), one row a distinct text. The overlap fraction is a
    lower bound: it counts the kept chunks, and is 0 where only n-grams show the pair. Pairs are verified
    once, exactly.
    """
    t = Fraction(str(above))
    rows = runtime.materialize(chunk_rows(records, _counts(records)), "chunks")  # read by both sides of the join
    train = rows.where("in_train").select("digest", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "length", F.col("id").alias("a"), F.col("total").alias("total_a"))
    other = rows.where("in_eval").select("digest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("b"), F.col("total").alias("total_b"))
    fractions = (
        train.join(other, ["digest", "block"])
        .where("a <> b")
        .groupBy("a", "b")
        .agg(F.sum("length").alias("overlap"), F.max(F.greatest("total_a", "total_b")).alias("total"))
        .withColumn("fraction", F.col("overlap") / F.col("total"))
        .where(F.col("fraction") >= FRACTION)
    )
    both = fractions.select("a", "b", "fraction").unionByName(gram_pairs(records, n, t).withColumn("fraction", F.lit(0.0)))
    return verified_records(both.groupBy("a", "b").agg(F.max("fraction").alias("fraction")), records, n, t)


def verified_records(pairs: DataFrame, records: DataFrame, n: int, t: Fraction) -> DataFrame:
    """(a, b, fraction, similarity): the pairs(a, b, fraction) whose exact similarity is above t."""
    pairs = runtime.materialize(pairs, "overlaps")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    if 2 * pairs.count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    bodies = records.select("id", "body").join(wanted, "id", "left_semi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body_a"):
            ga, oa = gram_sets(batch.column("body_a").to_pylist(), n)
            gb, ob = gram_sets(batch.column("body_b").to_pylist(), n)
            both = np.array([intersection_size(ga[oa[i] : oa[i + 1]], gb[ob[i] : ob[i + 1]]) for i in range(batch.num_rows)], dtype=np.int64)
            union = np.diff(oa) + np.diff(ob) - both
            ok = both * t.denominator > union * t.numerator
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), batch.column("fraction").filter(pa.array(ok)), pa.array((both / np.maximum(union, 1))[ok])],
                names=["a", "b", "fraction", "similarity"],
            )

    return (
        pairs.select("a", "b", "fraction")
        .join(bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
        .join(bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
        .mapInArrow(verify, "a long, b long, fraction double, similarity double")
    )


def split_texts(bodies: DataFrame, sides: DataFrame) -> DataFrame:
    """(text, id, in_train, in_eval): for each distinct text of bodies(text, id, article_id) the id of its first row and the sides of all its articles.

    Texts of articles without a side are left out. ``text`` is a hash; ids are row numbers.
    """
    known = bodies.select("article_id", "text", "id").join(sides, "article_id")
    return runtime.materialize(known.groupBy("text").agg(F.min("id").alias("id"), F.max("in_train").alias("in_train"), F.max("in_eval").alias("in_eval")), "first")


def split_records(bodies: DataFrame, first: DataFrame) -> DataFrame:
    """(id, body, in_train, in_eval): the rows of bodies(id, body) that ``first`` names.

    Texts are not shuffled; the rows to keep are broadcast where they are few (counted: at most SENT_IDS), and
    joined otherwise.
    """
    kept = first.select("id", "in_train", "in_eval")
    return bodies.select("id", "body").join(F.broadcast(kept) if first.count() <= SENT_IDS else kept, "id").select("id", "body", "in_train", "in_eval")


def split_overlaps(clean: DataFrame, splits: DataFrame, n: int = 8, above: float = 0.3, min_chars: int = 20) -> DataFrame:
    """(article_a, article_b, eval_split): overlaps of train with dev and holdout, smaller id first.

    Also each article that is in train and an evaluation split at once, whatever its body. Articles
    without a split, unknown splits, null ids and short bodies take no part otherwise; repeated rows count once.
    """
    parts = splits.where("article_id is not null and split in ('train', 'dev', 'holdout')").select("article_id", "split").distinct()
    sides = parts.groupBy("article_id").agg(F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval"))
    kept = squeezed_bodies(clean).where(F.length("body") >= min_chars)
    bodies = runtime.materialize(runtime.spread(kept.select("article_id", "body", F.xxhash64("body").alias("text"), F.monotonically_increasing_id().alias("id"))), "bodies")
    first = split_texts(bodies, sides)
    records = split_records(bodies, first)
    links = overlapping_records(records.select("id", "body", "in_train", "in_eval"), n, above)
    # Equal texts are one record: it overlaps itself if it lies on both sides.
    same = first.where("in_train and in_eval").select(F.col("id").alias("a"), F.col("id").alias("b"))
    members = runtime.materialize(bodies.select("text", "article_id").join(parts, "article_id").join(first.select("text", "id"), "text").select("id", "article_id", "split").distinct(), "members")
    train = members.where("split = 'train'").select(F.col("id").alias("a"), F.col("article_id").alias("x"))
    other = members.where("split <> 'train'").select(F.col("id").alias("b"), F.col("article_id").alias("y"), F.col("split").alias("eval_split"))
    pairs = links.select("a", "b").unionByName(same).join(train, "a").join(other, "b").where("x <> y")
    both = parts.where("split = 'train'").select("article_id").join(parts.where("split <> 'train'"), "article_id")
    return (
        pairs.select(F.least("x", "y").alias("article_a"), F.greatest("x", "y").alias("article_b"), "eval_split")
        .unionByName(both.select(F.col("article_id").alias("article_a"), F.col("article_id").alias("article_b"), F.col("split").alias("eval_split")))
        .distinct()
    )


def p6_found(spark, folder: str) -> DataFrame:
    """(article_a, article_b, eval_split): see split_overlaps."""
    return split_overlaps(runtime.table(spark, folder, "clean"), runtime.table(spark, folder, "splits"))


def p6_report(spark, folder: str) -> DataFrame:
    """(eval_split, site, pairs, articles): overlaps by split and site of the evaluation article."""
    from .site_lines import site_of

    found = runtime.materialize(p6_found(spark, folder), "found")
    parts = runtime.table(spark, folder, "splits").select("article_id", "split").distinct()
    both = found.select("eval_split", F.explode(F.array_distinct(F.array("article_a", "article_b"))).alias("article_id"), F.struct("article_a", "article_b").alias("pair"))
    held = both.join(parts, [both["article_id"] == parts["article_id"], both["eval_split"] == parts["split"]]).select("eval_split", both["article_id"], "pair")
    sites = runtime.table(spark, folder, "manifest").select("article_id", site_of(F.col("canonical_url")).alias("site")).where("site is not null").distinct()
    return held.join(sites, "article_id", "left").groupBy("eval_split", "site").agg(F.count_distinct("pair").alias("pairs"), F.count_distinct("article_id").alias("articles"))
