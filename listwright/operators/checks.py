"""Integrity checks and violation reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions import cells, vocab
from listwright.operators.ranking import row_numbers
from listwright.sources.storage import small

_CURIE = r"^[a-zA-Z][a-zA-Z0-9_-]+:[a-zA-Z0-9_/.:-]+\z"


class ViolationsFound(Exception):
    """Raised by a fail-fast check."""


def cells_of(rows: DataFrame, row_col: str, source_col: str = "__source") -> DataFrame:
    """Wide rows -> ``(source, row, at, col, value)``, one per filled cell, ``at`` being the
    column's place. No shuffle."""
    names = [c for c in rows.columns if c not in (row_col, source_col)]
    types = dict(rows.dtypes)
    pairs = [
        F.struct(
            F.lit(i).alias("at"),
            F.lit(c).alias("col"),
            (F.col(c) if types[c].startswith("array") else F.array(F.col(c).cast("string"))).alias("v"),
        )
        for i, c in enumerate(names)
    ]
    wide = rows.select(
        F.col(source_col).alias("source"), F.col(row_col).alias("row"), F.explode(F.array(*pairs)).alias("p")
    )
    return wide.select("source", "row", "p.at", "p.col", F.explode("p.v").alias("value")).where(
        "value IS NOT NULL"
    )


def occurrence_samples(issues: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 3) -> DataFrame:
    """First ``n`` rows per group; each task passes on at most ``n`` rows of a group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return issues.withColumn("sample", F.row_number().over(w)).where(F.col("sample") <= n).withColumn(
        "sample", F.col("sample").cast("bigint")
    )


def undeclared_prefix_check(
    cell_rows: DataFrame, prefixes: Iterable[str], n: int = 3
) -> DataFrame:
    """Prefixes used but not declared: total uses, the first ``n`` of them, how many more.

    ``cell_rows (source, row, at, col, value)``; the first uses are those first read: by row,
    column and place in the cell.
    """
    known = sorted(set(prefixes) | set(vocab.WELL_KNOWN_PREFIXES))
    value = F.col("value")
    pieces = F.transform(F.split(value, r"\|", -1), cells.strip)
    part = F.col("part")
    used = (
        cell_rows.where(value.contains(":") & ~cells.is_http(cells.strip(value)))
        .select("source", "row", "at", "col", F.posexplode(pieces).alias("place", "part"))
        .where(part.rlike(_CURIE) & ~cells.is_http(part))
        .withColumn("prefix", cells.curie_prefix(part))
        .where(~F.col("prefix").isin(*known))
    )
    totals = used.groupBy("prefix").agg(F.count(F.lit(1)).alias("uses"))
    samples = occurrence_samples(used, ["prefix"], ["row", "at", "place"], n)
    return samples.join(totals, "prefix").select(
        "prefix", "uses", "sample", "source", "row", "col", F.col("part").alias("value"),
        F.greatest(F.col("uses") - n, F.lit(0)).alias("more"),
    )


def dangling_reference_check(
    rows: DataFrame, refs_col: str, ids: DataFrame, skip_prefixes: Sequence[str] = ("http://", "https://")
) -> DataFrame:
    """Rows of references (comma lists or arrays) that point at no known id."""
    text = dict(rows.dtypes)[refs_col].startswith("array")
    refs = F.col(refs_col) if text else F.array_compact(F.array(refs_col))
    pieces = F.filter(
        F.flatten(F.transform(refs, lambda r: F.transform(F.split(r, ",", -1), cells.strip))),
        lambda r: r != "",
    )
    wanted = rows.withColumn("ref", F.explode(pieces)).where(
        ~cells.starts_with_any(F.col("ref"), skip_prefixes)
    )
    # Each distinct reference is looked up once; the rows are only filtered by the few bad ones.
    known = ids.select(F.col("id").alias("ref"))
    bad = small(wanted.select("ref").distinct().join(known, "ref", "left_anti"))
    return wanted.join(bad, "ref", "left_semi")


def drop_excluded_subjects(
    violations: DataFrame, excluded: Sequence[str] = vocab.EXCLUDED_VOCABULARIES, col: str = "focus"
) -> DataFrame:
    return violations.where(~cells.is_excluded(F.col(col), excluded))


def constraint_counts(
    violations: DataFrame, by: Sequence[str], excluded: Sequence[str] = vocab.EXCLUDED_VOCABULARIES
) -> DataFrame:
    """Reported and excluded violations per shape and constraint."""
    out = cells.is_excluded(F.col("focus"), excluded)
    return violations.groupBy(*by).agg(
        F.count_if(~out).alias("reported"), F.count_if(out).alias("excluded")
    )


def violation_report(
    violations: DataFrame,
    order: Sequence[str],
    labels: dict[str, str] = vocab.CONSTRAINT_LABELS,
    fail: bool = False,
    **sizes,
) -> DataFrame:
    """Violations of own subjects, numbered, with names for people.

    ``violations (focus, path, component, shape, message, …)``; ``order`` starts with a number.
    """
    kept = drop_excluded_subjects(violations)
    if fail and not kept.limit(1).isEmpty():
        raise ViolationsFound("shape constraints are violated; see the report")
    named = row_numbers(kept, [], order, "no", **sizes)
    local = F.substring_index(F.col("component"), "#", -1)
    return named.select(
        "no",
        "focus",
        cells.iri_short_name("focus").alias("focus_name"),
        cells.iri_short_name("path").alias("path_name"),
        F.coalesce(cells.lookup(F.col("component"), labels), local).alias("constraint_name"),
        F.substring_index(F.col("shape"), "/", -1).alias("shape_name"),
    )
