"""Groups from links: distributed union-find, and candidate pairs from buckets of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.sources.storage import cut, free


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of all linked nodes, the component being its smallest node.

    ``links(a, b)`` in any direction, repeated or to itself; null ends are left out. Large-star and
    small-star steps (each node's neighbours are handed to its least neighbour) halve depths in each
    round; neighbours are never gathered, only joined with the least one.
    """
    star = cut(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _fingerprint(star)
    while seen[0]:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut(small.unionByName(roots.select("u", F.col("m").alias("v"))).distinct())
        free(star.sparkSession)
        now = _fingerprint(star)
        if now == seen:
            break
        seen = now
    roots = star.select(F.col("v").alias("u"), "v").distinct()
    return star.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _fingerprint(star: DataFrame) -> tuple:
    return tuple(star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


# Rounds in which every member of a bucket meets one other, before what is left is compared in full.
ROUNDS = 12
# Buckets up to this size are compared pair by pair, larger ones in blocks where the caller can.
FEW = 16


def linked_groups(
    members: DataFrame | list[DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    in_blocks: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(node, component)`` over all links among members of one bucket.

    ``members(bucket, id)``, without repeats, or several such frames without a common bucket, which are
    dealt one after the other, so that no more than one is on disk at once; ``verify`` takes ``(a, b)``, a < b, and gives the pairs that
    are links. First every member meets the least one of its bucket, which makes one group of a bucket
    of copies for a pair a member. Buckets that still hold more than one group are then compared in full:
    small ones pair by pair, larger ones by ``in_blocks``, which takes ``(bucket, id, own)`` and gives
    links ``(a, b)`` that join whatever the bucket's links join, without writing out all its pairs.

    Without ``in_blocks``, members meet a further chosen one of another group in each round first; when
    that no longer helps, or little is left, all pairs between a bucket's groups are compared. Either way
    no link is missed: two members that are never compared are in one group already.
    """
    shared = None
    for some in members if isinstance(members, list) else [members]:
        some = some.repartition("bucket")  # dealt once, for the pivots and for what meets them
        least = some.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
        met = cut(some.join(least.drop("n").hint("shuffle_hash"), "bucket"))
        shared = met if shared is None else shared.unionByName(met)
        free(some.sparkSession)
    links, tried = _compared(shared.where("id != pivot"), "pivot", verify)
    groups = components(links)
    crossing = None
    for number in range(ROUNDS + 1):
        named, open_ = _open(shared, groups)
        total, crosses = open_.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("within")) / 2)).first()
        if not total:
            return groups
        stuck = crossing is not None and crosses > 0.9 * crossing
        crossing = crosses
        if in_blocks or crossing <= 4 * total or stuck or number == ROUNDS:
            few = F.col("n") <= FEW if in_blocks else F.lit(True)
            small = named.join(open_.where(few).select("bucket"), "bucket", "left_semi")
            others = small.select("bucket", F.col("id").alias("other"), F.col("own").alias("of"))
            pairs = small.join(others, "bucket").where("own != of AND id < other")
            found = links.unionByName(_compared(pairs, "other", verify, tried)[0])
            if in_blocks:
                large = named.join(open_.where(~few).select("bucket"), "bucket", "left_semi")
                found = found.unionByName(cut(in_blocks(large)))
            return components(found)
        named = named.join(open_.select("bucket"), "bucket", "left_semi")
        chosen = named.groupBy("bucket").agg(
            F.min_by(F.struct("id", "own"), F.xxhash64("id", F.lit(number))).alias("p")
        ).select("bucket", F.col("p.id").alias("pivot"), F.col("p.own").alias("of"))
        more, now = _compared(named.join(chosen, "bucket").where("own != of"), "pivot", verify, tried)
        links, tried = cut(links.unionByName(more)), tried.unionByName(now)
        groups = components(links)


def _open(shared: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their group, and the buckets that hold more than one group, with their sizes."""
    named = shared.select("bucket", "id").join(groups.withColumnRenamed("node", "id"), "id", "left")
    named = cut(named.select("bucket", "id", F.coalesce("component", "id").alias("own")))
    free(shared.sparkSession)
    sizes = named.groupBy("bucket", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count(F.lit(1)).alias("groups")
    )
    return named, cut(sizes.where("groups > 1"))


def _compared(
    pairs: DataFrame, other: str, verify: Callable[[DataFrame], DataFrame], tried: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The links among pairs of ``id`` and ``other``, and the pairs looked at: each once, without those ``tried`` before."""
    once = pairs.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b")).distinct()
    if tried is not None:
        once = once.join(tried, ["a", "b"], "left_anti")
    once = cut(once)
    found = cut(verify(once).select("a", "b"))
    free(pairs.sparkSession)
    return found, once
