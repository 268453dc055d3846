"""Set similarity over character n-grams by inverted index: exact pairs, no cross joins.

N-grams travel as 64-bit hashes; results are exact up to collisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions import text as T
from ..llm import near_dup, split_overlap, vec


def gram_rows(texts: DataFrame, key: str, n: int, column: str = "text") -> DataFrame:
    """key, g: distinct hashed n-grams; null texts give none."""
    return texts.select(key, F.explode(T.ngrams(F.col(column), n)).alias("gram")).select(key, F.xxhash64("gram").alias("g")).distinct()


def gram_counts(texts: DataFrame, key: str, n: int, column: str = "text") -> DataFrame:
    """key, n_grams: size of each text's set of n-grams."""
    return texts.select(key, F.size(T.ngrams(F.col(column), n)).alias("n_grams"))


def _shared(left: DataFrame, right: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """a, b, shared, n_a, n_b over pairs that share an n-gram."""
    la, rb = gram_rows(left, a, n), gram_rows(right, b, n)
    n_a, n_b = la.groupBy(a).agg(F.count("*").alias("n_a")), rb.groupBy(b).agg(F.count("*").alias("n_b"))
    return la.join(rb, "g").groupBy(a, b).agg(F.count("*").alias("shared")).join(n_a, a).join(n_b, b)


def shared_with_few(left: DataFrame, right: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """a, b, shared, n_a, n_b by rows of ``right``: numbers of n-grams that each text shares with the texts of ``left``, which are broadcast.

    One pass over ``right`` without a shuffle; texts are taken as they are, one row a key of ``right``.
    """
    spark = left.sparkSession
    held: dict = {}
    for k, text in left.select(a, "text").where(F.col(a).isNotNull() & F.col("text").isNotNull()).collect():  # few, counted by the caller
        held.setdefault(k, []).append(vec.gram_sets([text], n)[0])
    sets = [np.unique(np.concatenate(x)) for x in held.values()]
    grams, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sets, [np.full(len(x), i, np.int64) for i, x in enumerate(sets)]))
    order = np.argsort(grams, kind="stable")
    keys, first = np.unique(grams[order], return_index=True)
    index = spark.sparkContext.broadcast((keys, np.append(first, len(grams)), owner[order], len(sets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ends, owner, m = index.value
        if not len(keys):
            return
        for batch in vec.slices(batches, "text"):
            grams, offsets = vec.gram_sets([t or "" for t in batch.column("text").to_pylist()], n)
            size = np.diff(offsets)
            at = np.searchsorted(keys, grams)
            at[at == len(keys)] = 0
            hit = keys[at] == grams
            at, own = at[hit], np.repeat(np.arange(len(size)), size)[hit]
            count = ends[at + 1] - ends[at]
            place = np.arange(int(count.sum())) + np.repeat(ends[at] - (np.cumsum(count) - count), count)
            pair, shared = np.unique(np.repeat(own, count) * m + owner[place], return_counts=True)
            doc, i = np.divmod(pair, m)
            yield pa.RecordBatch.from_arrays([pa.array(i), batch.column(b).take(pa.array(doc)), pa.array(shared.astype(np.int64)), pa.array(size[doc])], names=["_i", b, "shared", "n_b"])

    named = spark.createDataFrame([(i, k, len(x)) for i, (k, x) in enumerate(zip(held, sets))], f"_i bigint, `{a}` {left.schema[a].dataType.simpleString()}, n_a bigint")
    found = right.select(b, "text").mapInArrow(run, f"_i bigint, `{b}` {right.schema[b].dataType.simpleString()}, shared bigint, n_b bigint")
    return found.join(F.broadcast(named), "_i").select(a, b, "shared", "n_a", "n_b")


def _shared_few(left: DataFrame, right: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """_shared for few texts of ``left``; keys of ``right`` with several texts go the general way."""
    several = runtime.materialize(right.groupBy(b).agg(F.count("*").alias("n")).where("n > 1").select(b), "several")
    squeezed = lambda df, k: df.select(k, F.regexp_replace("text", T.SPACE + "+", "").alias("text"))
    one = shared_with_few(squeezed(left, a), squeezed(right.join(several, b, "left_anti"), b), a, b, n)
    return one if several.isEmpty() else one.unionByName(_shared(left, right.join(several, b, "left_semi"), a, b, n))


def jaccard_pairs(left: DataFrame, right: DataFrame, a: str, b: str, n: int, few: bool = False) -> DataFrame:
    """a, b, jaccard of texts(key, text) that share an n-gram; all other pairs are 0. With ``few``, ``left`` is broadcast."""
    shared = _shared_few if few else _shared
    return shared(left, right, a, b, n).select(a, b, (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def containments(parts: DataFrame, sources: DataFrame, a: str, b: str, n: int, few: bool = False) -> DataFrame:
    """a, b, containment: the share of a's n-grams that b has, for pairs that share one. With ``few``, ``parts`` are broadcast."""
    shared = _shared_few if few else _shared
    return shared(parts, sources, a, b, n).select(a, b, (F.col("shared") / F.col("n_a")).alias("containment"))


def best_source(contained: DataFrame, a: str, b: str) -> DataFrame:
    """a, best, source: the greatest containment, ties to the first source."""
    w = Window.partitionBy(a).orderBy(F.desc("containment"), b)
    return contained.withColumn("r", F.row_number().over(w)).where("r = 1").select(a, F.col(b).alias("source"), F.col("containment").alias("best"))


def _expanded(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Pairs of members(id, key) of different linked classes and, with similarity 1, of one class."""
    x, y = members.select(F.col("id").alias("a"), F.col(key).alias("x")), members.select(F.col("id").alias("b"), F.col(key).alias("y"))
    across = links.join(x, "a").join(y, "b").select("x", "y", "jaccard")
    same = x.join(y, x["a"] == y["b"]).select("x", "y", F.lit(1.0).alias("jaccard"))
    out = across.unionByName(same).where("x <> y")
    return out.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("jaccard").alias("jaccard"))


def _similar_classes(texts: DataFrame, key: str, n: int, threshold: float, column: str) -> tuple[DataFrame, DataFrame]:
    """members(id, key) of classes of texts that are equal but for white space, and links(a, b, jaccard) between classes.

    Texts without n-grams are left out. By ``near_dup``: packed rare-first prefixes, in rounds, pairs verified once.
    """
    bodies = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("article_id"), F.regexp_replace(column, T.SPACE + "+", "").alias("body"))
    members, links = near_dup.near_duplicates(bodies, n, threshold, 1)
    return members.select("id", F.col("article_id").alias(key)), links.withColumnRenamed("similarity", "jaccard")


def similar_pairs(texts: DataFrame, key: str, n: int = 5, threshold: float = 0.8, column: str = "text") -> DataFrame:
    """a, b, jaccard of different keys with Jaccard of at least the threshold. Equal texts are compared once."""
    members, links = _similar_classes(texts, key, n, threshold, column)
    return _expanded(links, members, key)


def similar_edges(texts: DataFrame, key: str, n: int = 5, threshold: float = 0.8, column: str = "text") -> DataFrame:
    """a, b: edges that connect the same keys as ``similar_pairs``: each class's keys to its least, and the least of linked classes."""
    members, links = _similar_classes(texts, key, n, threshold, column)
    members = runtime.materialize(members, "members")
    least = members.groupBy("id").agg(F.min(key).alias("least"))
    a, b = (least.select(F.col("id").alias(c), F.col("least").alias(f"least_{c}")) for c in ("a", "b"))
    own = members.join(least, "id").select(F.col("least").alias("a"), F.col(key).alias("b"))
    return own.unionByName(links.join(a, "a").join(b, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))).where("a <> b")


def cross_pairs(texts: DataFrame, parts: DataFrame, key: str, side: str, n: int, above: float, column: str = "text") -> DataFrame:
    """a, b, side_a, side_b, jaccard: pairs above a limit whose keys lie on different sides.

    ``texts`` has key and text, ``parts`` key and side; sides are few (a bit each). Equal texts are compared once. Sides
    are compared one by one with all later ones, by packed prefixes (``split_overlap.gram_pairs``), so that no table of all n-grams is written.
    """
    t = Fraction(str(above))
    parts = parts.select(key, side).where(F.col(key).isNotNull() & F.col(side).isNotNull()).distinct()
    # The largest first, so that later passes are small; few by definition.
    names = [r[0] for r in parts.groupBy(side).agg(F.count("*").alias("n")).orderBy(F.desc("n"), side).collect()]
    bit = F.element_at(F.create_map(*(x for i, s in enumerate(names) for x in (F.lit(s), F.lit(1 << i).cast("long")))), F.col(side)) if names else F.lit(0).cast("long")
    squeezed = texts.select(key, F.regexp_replace(column, T.SPACE + "+", "").alias("body")).where("body <> ''")
    bodies = runtime.materialize(squeezed.select(key, "body", F.xxhash64("body").alias("text"), F.monotonically_increasing_id().alias("id")), "bodies")
    held = bodies.select(key, "text", "id").join(parts, key)
    first = runtime.materialize(held.groupBy("text").agg(F.min("id").alias("id"), F.bit_or(bit).alias("mask")), "first")
    kept = first.select("id", "mask")
    records = bodies.select("id", "body").join(F.broadcast(kept) if first.count() <= near_dup.SENT_IDS else kept, "id")
    links = None
    for i in range(len(names) - 1):
        own, later = F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.shiftright("mask", i + 1) > 0
        sided = records.select("id", "body", own.alias("in_train"), later.alias("in_eval")).where("in_train or in_eval")
        found = split_overlap.verified_records(split_overlap.gram_pairs(sided, n, t).withColumn("fraction", F.lit(0.0)), sided, n, t)
        links = runtime.materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("similarity").alias("jaccard")), "links", links)
        runtime.free_shuffles(texts.sparkSession)
    members = runtime.materialize(held.select(key, side, "text").join(first.select("text", "id"), "text").select("id", key, side).distinct(), "members")
    x, y = (members.select(F.col("id").alias(c), F.col(key).alias(k), F.col(side).alias(f"side_{c}")) for c, k in (("a", "x"), ("b", "y")))
    both = x.join(y, x["a"] == y["b"]).select("x", "y", "side_a", "side_b", F.lit(1.0).alias("jaccard"))
    if links is not None:
        both = both.unionByName(links.distinct().join(x, "a").join(y, "b").select("x", "y", "side_a", "side_b", "jaccard"))
    first_x = F.col("x") < F.col("y")
    return both.where("x <> y and side_a <> side_b").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first_x, F.col("side_a")).otherwise(F.col("side_b")).alias("side_a"), F.when(first_x, F.col("side_b")).otherwise(F.col("side_a")).alias("side_b"), "jaccard"
    ).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, root: connected components by least id; only nodes with an edge. Null ends and loops count as no edge.

    Each round hooks every root to its least neighbour if that is smaller, follows these hooks to their
    ends, and contracts the edges to the roots. A root that stays has been hooked to, or is hooked in
    the next round, so that the roots of a component halve in two rounds whatever its shape; rounds go on
    until no edge is left. Each round is written to the shared folder.
    """
    x, y = F.col(a).alias("x"), F.col(b).alias("y")
    half = edges.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    left = runtime.materialize(half.select(x, y).unionByName(half.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    label = runtime.materialize(left.select(F.col("x").alias("id"), F.col("x").alias("root")).distinct(), "label")
    while not left.isEmpty():
        hooks = runtime.materialize(left.groupBy("x").agg(F.min("y").alias("to")).where("to < x"), "hooks")
        hooks = _followed(hooks)
        new = runtime.materialize(label.join(hooks.withColumnRenamed("x", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "label")
        to = hooks.select(F.col("x").alias("end"), "to")
        moved = left.join(to, left["x"] == to["end"], "left").select(F.coalesce("to", "x").alias("x"), "y")
        moved = moved.join(to, moved["y"] == to["end"], "left").select("x", F.coalesce("to", "y").alias("y"))
        kept = runtime.materialize(moved.where("x <> y").distinct(), "edges")
        runtime.drop(label, left, hooks)
        label, left = new, kept
    return label


def _followed(hooks: DataFrame) -> DataFrame:
    """Hooks (x, to) followed to their ends: three times the length that is followed in each round."""
    while True:
        one, two = (hooks.select(F.col("x").alias(f"at{i}"), F.col("to").alias(f"far{i}")) for i in (1, 2))
        jumped = hooks.join(one, hooks["to"] == one["at1"], "left").join(two, one["far1"] == two["at2"], "left")
        step = runtime.materialize(jumped.select("x", F.coalesce("far2", "far1", "to").alias("to"), F.col("far1").isNotNull().alias("moved")), "hooks")
        runtime.drop(hooks)
        moved = not step.where("moved").isEmpty()
        hooks = step.select("x", "to")
        hooks._inkloom_path = step._inkloom_path
        if not moved:
            return hooks


def canonical(members: DataFrame, cluster: str, key: str, date: str) -> DataFrame:
    """cluster, canonical: the oldest member, undated ones last, ties by key."""
    w = Window.partitionBy(cluster).orderBy(F.coalesce(date, F.lit("9999-99-99")), key)
    return members.withColumn("r", F.row_number().over(w)).where("r = 1").select(cluster, F.col(key).alias("canonical"))
