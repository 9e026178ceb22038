"""Rows to triples and back; merging sightings of a node."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions import cells, vocab
from listwright.operators.ranking import row_numbers


@dataclass(frozen=True)
class Term:
    """What a column means: its predicate and the kind of its values."""

    predicate: str
    kind: str = "literal"
    datatype: str | None = None
    lang: str | None = None


def rows_to_triples(
    rows: DataFrame, context: Mapping[str, Term], id_col: str = "_id"
) -> DataFrame:
    """One triple per value of every declared column; other columns drop out. No shuffle."""
    types = dict(rows.dtypes)
    cols = []
    for name, term in context.items():
        if name not in types:
            continue
        value = F.col(f"`{name}`")
        values = value if types[name].startswith("array") else F.array(value.cast("string"))
        datatype = term.datatype
        if term.kind == "literal" and datatype is None:
            datatype = vocab.RDF_LANG_STRING if term.lang else vocab.XSD + "string"
        cols.append(
            F.struct(
                F.lit(term.predicate).alias("predicate"),
                F.lit(term.kind).alias("object_kind"),
                F.lit(datatype).cast("string").alias("datatype"),
                F.lit(term.lang).cast("string").alias("lang"),
                values.alias("objects"),
            )
        )
    per_column = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("subject"), F.explode(F.array(*cols)).alias("t")
    )
    return per_column.select(
        "subject", "t.predicate", "t.object_kind", "t.datatype", "t.lang",
        F.posexplode("t.objects").alias("pos", "object"),
    ).where("object IS NOT NULL")


def triples_to_rows(
    triples: DataFrame, predicates: Mapping[str, str], part_size: int = 1000, pos: str = "pos", **sizes
) -> DataFrame:
    """One wide row per subject: predicate -> column with the list of its values in order.

    A subject with more than ``part_size`` values of one predicate goes on in further rows
    (``part`` 1, 2 …), so a hub never becomes one huge row and no value is lost.
    """
    wanted = triples.where(F.col("predicate").isin(*predicates.values()))
    ranked = row_numbers(wanted, ["subject", "predicate"], [pos, "object"], "_rank", **sizes)
    parts = ranked.withColumn("part", F.expr(f"(_rank - 1) div {part_size}"))
    ordered = [
        F.transform(
            F.array_sort(
                F.collect_list(F.when(F.col("predicate") == iri, F.struct("_rank", "object")))
            ),
            lambda s: s["object"],
        ).alias(name)
        for name, iri in predicates.items()
    ]
    return parts.groupBy("subject", "part").agg(*ordered)


def merge_nodes(node_props: DataFrame) -> DataFrame:
    """Many sightings of an id -> one value per key: the first defined one in walk order."""
    return node_props.groupBy("id", "key").agg(F.min_by("value", "pos").alias("value"))


def subject_property_set(triples: DataFrame) -> DataFrame:
    """The set of predicates of every subject, one row per member."""
    return triples.select("subject", "predicate").distinct()


def orphan_filter(
    triples: DataFrame,
    excluded: Sequence[str] = vocab.EXCLUDED_VOCABULARIES,
    label_iri: str = vocab.PREF_LABEL,
    scheme_iri: str = vocab.IN_SCHEME,
) -> DataFrame:
    """Drops subjects of excluded vocabularies that have neither a label nor a scheme.

    Only triples of those vocabularies are shuffled; all others pass straight through.
    """
    outside = cells.is_excluded(F.col("subject"), excluded)
    suspects = triples.where(outside)
    described = (
        suspects.where(F.col("predicate").isin(label_iri, scheme_iri)).select("subject").distinct()
    )
    kept = suspects.join(described, "subject", "left_semi")
    return triples.where(~outside).unionByName(kept.select(*triples.columns))
