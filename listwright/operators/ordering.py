"""Order among siblings from ``first`` and ``after`` annotations.

A row has at most one predecessor, so the rows to order form a forest. Taking always the
available row with the least position, rows come in the order of this key: on the way from
its root to the row, the positions greater than all later ones. Keys of a path's two halves
combine, so jumps double each round and a chain of n rows takes about log2(n) rounds of
equi-joins; no sibling group is gathered in one task.

Groups counted to have few rows skip the rounds: they are ordered inside one short array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import cells
from listwright.operators.grouping import SHORT, by_size
from listwright.operators.ranking import sorted_numbers
from listwright.sources.storage import cut


def _kahn_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, id, cyclic, sort_key)`` of section 1 of ``rows (*keys, id, pos, section, pred)``; pred null for roots.

    A row of another section ends the ways that lead to it and adds nothing to their keys, so nobody has to look
    for such rows first. A round writes only the rows that are still on their way.
    """
    inner = F.col("section") == 1
    own = F.array(F.col("pos").cast("long"))
    state = rows.select(
        *keys, "id", "pos", "section", F.when(inner, own).otherwise(F.array().cast("array<bigint>")).alias("sort_key"),
        F.when(inner, F.col("pred")).alias("jump"), F.lit(False).alias("cyclic"),
    )
    done, moving = state.where("jump IS NULL"), state.where("jump IS NOT NULL")
    waiting = moving.count()
    while waiting:
        ahead = done.unionByName(moving).select(
            *keys, F.col("id").alias("jump"), F.col("sort_key").alias("_up"), F.col("jump").alias("_next"),
            F.col("cyclic").alias("_cyclic"),
        )
        back = F.col("_cyclic") | F.coalesce(F.col("_next") == F.col("id"), F.lit(False))
        moved = cut(
            moving.join(ahead.hint("merge"), [*keys, "jump"]).select(
                *keys, "id", "pos", "section",
                F.concat(F.filter("_up", lambda x: x > F.get("sort_key", F.lit(0))), "sort_key").alias("sort_key"),
                F.when(~back, F.col("_next")).alias("jump"), back.alias("cyclic"),
            )
        )
        done, moving = done.unionByName(moved.where("jump IS NULL")), moved.where("jump IS NOT NULL")
        still = moving.count()
        if still == waiting:
            break
        waiting = still
    # What still moves after a round in which nothing ended is on circles or leads to one.
    found = done.where(inner).unionByName(moving.withColumn("cyclic", F.lit(True)))
    return found.select(*keys, "id", "cyclic", F.when(F.col("cyclic"), own).otherwise(F.col("sort_key")).alias("sort_key"))


def _place(rows: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Numbers ``rows (*keys, id, pos, section, pred)``: section, then key; cycles close section 1."""
    ordered = _kahn_keys(rows, keys)
    loose = rows.where("section <> 1").select(
        *keys, "id", "section", F.lit(False).alias("cyclic"), F.array(F.col("pos").cast("long")).alias("sort_key")
    )
    both = loose.unionByName(ordered.withColumn("section", F.lit(1)))
    return sorted_numbers(both, keys, ["section", "cyclic", "sort_key"], out, plain_rows=0).select(*keys, "id", out)


def _ids(rows: Column, test=None) -> Column:
    return F.transform(rows if test is None else F.filter(rows, test), lambda r: r["id"])


def _sequence(rows: Column) -> Column:
    """Ids in order; ``rows`` is an array of ``(section, pos, id, after)``.

    A predecessor counts only inside the ordered section; what it never frees is a cycle and
    closes that section.
    """

    def with_inner(sorted_rows: Column, inner: Column, inner_ids: Column) -> Column:
        def free(done: Column) -> Column:
            def ready(r: Column) -> Column:
                waits = F.array_contains(inner_ids, r["after"]) & ~F.array_contains(done, r["after"])
                return ~F.array_contains(done, r["id"]) & ~F.coalesce(waits, F.lit(False))

            return _ids(F.slice(F.filter(inner, ready), 1, 1))

        ordered = F.aggregate(inner, F.slice(inner_ids, 1, 0), lambda done, _: F.concat(done, free(done)))
        return cells.once(
            ordered,
            lambda done: F.concat(
                _ids(sorted_rows, lambda r: r["section"] == 0), done, F.array_except(inner_ids, done),
                _ids(sorted_rows, lambda r: r["section"] == 2),
            ),
        )

    return cells.once(
        F.array_sort(rows),
        lambda all_rows: cells.once(
            F.filter(all_rows, lambda r: r["section"] == 1),
            lambda inner: cells.once(_ids(inner), lambda inner_ids: with_inner(all_rows, inner, inner_ids)),
        ),
    )


def _sectioned(section: Column, r: Column, after: Column) -> Column:
    return F.struct(section.alias("section"), r["pos"].alias("pos"), r["id"].alias("id"), after.alias("after"))


def _numbered(grouped: DataFrame, keys: Sequence[str], ids: Column, out: str) -> DataFrame:
    return grouped.select(*keys, F.posexplode(ids).alias("_at", "id")).select(*keys, "id", (F.col("_at") + 1).cast("bigint").alias(out))


def _short_siblings(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    item = F.struct("pos", "id", "after", F.coalesce("first", F.lit(False)).alias("first"))
    grouped = df.groupBy(*keys).agg(F.collect_list(item).alias("_g"))

    def order(ids: Column) -> Column:
        def row(r: Column) -> Column:
            valid = F.coalesce(F.array_contains(ids, r["after"]), F.lit(False))
            return _sectioned(F.when(r["first"], 0).when(valid, 1).otherwise(2), r, r["after"])

        return _sequence(F.transform("_g", row))

    return _numbered(grouped, keys, cells.once(_ids(F.col("_g")), order), out)


def _short_columns(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    item = F.struct("pos", F.col("path").alias("id"), "title", "after", F.coalesce("first", F.lit(False)).alias("first"))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_g"))

    def resolved(r: Column) -> Column:
        def hit(test) -> Column:
            return F.try_element_at(_ids(F.col("_g"), test), F.lit(-1))

        target = F.coalesce(
            hit(lambda x: x["id"] == r["after"]),
            hit(lambda x: cells.tail(x["id"]) == r["after"]),
            hit(lambda x: x["title"] == r["after"]),
        )
        return F.struct(
            r["pos"].alias("pos"), r["id"].alias("id"), r["first"].alias("first"),
            F.when(r["after"].isNotNull(), target).alias("target"),
        )

    def order(rows: Column) -> Column:
        others = F.filter(rows, lambda r: r["target"].isNotNull() & (r["target"] != r["id"]))

        def with_refs(refs: Column) -> Column:
            def row(r: Column) -> Column:
                tied = r["target"].isNotNull() | F.array_contains(refs, r["id"])
                return _sectioned(F.when(r["first"], 0).when(tied, 1).otherwise(2), r, r["target"])

            return _sequence(F.transform(rows, row))

        return cells.once(F.transform(others, lambda r: r["target"]), with_refs)

    return _numbered(grouped, keys, cells.once(F.transform("_g", resolved), order), out)


def order_siblings(df: DataFrame, by: Sequence[str], out: str = "ord", short: int = SHORT) -> DataFrame:
    """``(*by, id, ord)``: first-flagged rows, then rows after a valid sibling, then the rest.

    ``df (*by, id, pos, after, first)``, ids unique per group.
    """
    keys = list(by)
    few, many = by_size(cut(df), keys, short)
    placed = _short_siblings(few, keys, out)
    return placed if many is None else placed.unionByName(_long_siblings(many, keys, out))


def _long_siblings(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    base = cut(df.select(*keys, "id", "pos", "after", F.coalesce("first", F.lit(False)).alias("first")))
    known = base.select(*keys, F.col("id").alias("after"), F.lit(True).alias("_hit")).hint("merge")
    sectioned = base.join(known, [*keys, "after"], "left").select(
        *keys, "id", "pos", F.when(F.col("first"), 0).when(F.col("_hit"), 1).otherwise(2).alias("section"),
        F.col("after").alias("pred"),
    )
    return _place(cut(sectioned), keys, out)


def order_columns(df: DataFrame, by: Sequence[str], out: str = "ord", short: int = SHORT) -> DataFrame:
    """``(*by, path, ord)``: as above, and a row others refer to joins the ordered block.

    ``df (*by, path, title, pos, after, first)``; ``after`` names a path, a bare name or a title.
    """
    keys = list(by)
    few, many = by_size(cut(df), keys, short)
    placed = _short_columns(few, keys, out)
    if many is not None:
        placed = placed.unionByName(_long_columns(many, keys, out))
    return placed.withColumnRenamed("id", "path")


def _long_columns(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    base = cut(df.select(*keys, F.col("path").alias("id"), "title", "pos", "after", F.coalesce("first", F.lit(False)).alias("first")))
    names = F.array(
        F.struct(F.col("id").alias("name"), F.lit(3).alias("rank")),
        F.struct(cells.tail(F.col("id")).alias("name"), F.lit(2).alias("rank")),
        F.struct(F.col("title").alias("name"), F.lit(1).alias("rank")),
    )
    refs = base.where("after IS NOT NULL")
    # Only names that some row asks for are compared with one another.
    named = (
        base.select(*keys, "id", "pos", F.inline(names)).withColumnRenamed("name", "after")
        .join(refs.select(*keys, "after").hint("merge"), [*keys, "after"], "left_semi")
        .groupBy(*keys, "after")
        .agg(F.max_by("id", F.struct("rank", "pos")).alias("target"))
    )
    refs = cut(refs.join(named.hint("merge"), [*keys, "after"], "left").select(*keys, "id", "pos", "first", "target"))
    resolved = refs.unionByName(
        base.where("after IS NULL").select(*keys, "id", "pos", "first", F.lit(None).cast("string").alias("target"))
    )
    referenced = (
        refs.where("target IS NOT NULL AND target <> id")
        .select(*keys, F.col("target").alias("id")).distinct().withColumn("_ref", F.lit(True)).hint("merge")
    )
    sectioned = resolved.join(referenced, [*keys, "id"], "left").select(
        *keys, "id", "pos",
        F.when(F.col("first"), 0).when(F.col("target").isNotNull() | F.col("_ref"), 1).otherwise(2).alias("section"),
        F.col("target").alias("pred"),
    )
    return _place(cut(sectioned), keys, out)


def condition_last(df: DataFrame, by: Sequence[str], out: str = "ord", short: int = SHORT) -> DataFrame:
    """``(*by, id, dependent, ord)``: rows that depend on a trigger come after the others.

    ``df (*by, id, pos, after, first, trigger, value)``. Both parts are ordered by themselves;
    read them by ``(dependent, ord)``.
    """
    keys = list(by)
    triggers = df.where("trigger IS NOT NULL AND value IS NOT NULL").select(*keys, "trigger").distinct()
    # Only a row whose own value is missing has to look for another one with its trigger.
    is_open = F.col("trigger").isNotNull() & F.col("value").isNull()
    told = df.where(~is_open).withColumn("dependent", F.col("trigger").isNotNull())
    asked = df.where(is_open).join(triggers.withColumn("dependent", F.lit(True)).hint("merge"), [*keys, "trigger"], "left")
    split = told.unionByName(asked.withColumn("dependent", F.coalesce("dependent", F.lit(False))).select(told.columns))
    return order_siblings(split, [*keys, "dependent"], out, short)
