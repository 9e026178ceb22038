"""Lists of options, each different list stored once.

Many fields offer the same few lists. Fields point at a list, schemes with the same options share one,
and what is stored is a row per field reference and a row per option, never a row per field and option.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import cells
from listwright.operators.ranking import row_numbers
from listwright.sources.releases import expand_curie
from listwright.sources.storage import cut, small


def _mark(seed: int) -> Column:
    """64 bits of an option and its place, for a fold without order; a missing text is not an empty one."""
    parts = [p for c in ("value", "label") for p in (F.col(c).isNull(), F.col(c))]
    return F.bit_xor(F.xxhash64(F.lit(seed), "pos", *parts))


def intern_lists(tops: DataFrame, prefixes, **sizes) -> tuple[DataFrame, DataFrame]:
    """``(scheme, list)`` and ``(list, pos, value, label)`` of all schemes with options.

    ``tops (scheme, pos, concept, label)``, repeated rows counting once. Options are numbered from 1 in the
    order ``(pos, value, label)``; values are expanded ids, and stand for empty labels. Schemes whose
    numbered options are the same share a list, which has the name of the least of them. Lists are
    compared by two 64-bit folds and their length, so a long one is never gathered.
    """
    full = expand_curie(tops.where("concept IS NOT NULL"), "concept", prefixes, "value").select(
        "scheme", F.col("pos").alias("_at"), "value", F.coalesce(F.nullif("label", F.lit("")), "value").alias("label")
    )
    # Written once: to number rows they are counted, sampled and then moved.
    full = cut(full.distinct())
    numbered = cut(row_numbers(full, ["scheme"], ["_at", "value", "label"], "pos", **sizes).drop("_at"))
    marks = numbered.groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), _mark(1).alias("one"), _mark(2).alias("two"))
    marks = cut(marks)
    least = marks.groupBy("n", "one", "two").agg(F.min("scheme").alias("list"))
    names = marks.join(least, ["n", "one", "two"]).select("scheme", "list")
    kept = names.where("scheme = list").select("list")
    options = numbered.withColumnRenamed("scheme", "list").join(kept, "list", "left_semi")
    return names, options.select("list", "pos", "value", "label")


def lists_of_fields(fields: DataFrame, names: DataFrame, external: Sequence[str] = ()) -> DataFrame:
    """``(field, list_pos, list)``: the lists that each field offers, in order of ``list_pos``.

    ``fields (field, ref, pos)``, ``names (scheme, list)``. References to something else than a scheme
    with options give no row.
    """
    local = fields.where(cells.classify_reference(F.col("ref"), external).isin("local", "excluded"))
    return local.join(names, F.col("ref") == F.col("scheme")).select("field", F.col("pos").alias("list_pos"), "list")


def values_outside(values: DataFrame, lists: DataFrame, options: DataFrame) -> DataFrame:
    """The rows of ``values (field, value, …)`` whose value none of the field's lists has.

    A field without a list asks for nothing, and neither does an absent value. Each different
    pair of field and value is looked up once, so a frequent one costs no more than a rare one.
    """
    pairs = values.where("field IS NOT NULL AND value IS NOT NULL").select("field", "value").distinct()
    offered = small(cut(lists.select("field", "list").distinct()))
    known = options.select("list", "value", F.lit(True).alias("_has")).distinct()
    outside = (
        pairs.join(offered, "field")
        .join(known, ["list", "value"], "left")
        .groupBy("field", "value")
        .agg(F.max(F.coalesce("_has", F.lit(False))).alias("_has"))
        .where("NOT _has")
        .select("field", "value")
    )
    return values.join(outside, ["field", "value"], "left_semi").select(*values.columns)
