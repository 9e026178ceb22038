"""Release comparison and version stamps.

A release is a table of nodes: an id, any property columns, and the version columns
``created, modified, is_version_of, status``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from listwright.functions import vocab
from listwright.operators.rules import last_wins_dedupe
from listwright.operators.triples import Term, rows_to_triples

VERSION = ("created", "modified", "is_version_of", "status")
_TYPES = {"created": "string", "modified": "string", "is_version_of": "array<string>", "status": "string"}
WITHDRAWN = vocab.STATUS_BASE + "Withdrawn"


def status_of(label: str) -> str:
    """IRI of a status label known when the plan is built."""
    if label.startswith(("http://", "https://")):
        return label
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in label).split()
    return vocab.STATUS_BASE + "".join(w[0].upper() + w[1:] for w in words)


def with_version_columns(df: DataFrame) -> DataFrame:
    for name, kind in _TYPES.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def content_hash(df: DataFrame, ignore: Sequence[str]) -> Column:
    """Hash of a node's content: keys and lists sorted, nulls and ``ignore`` left out."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name not in ignore:
            c = F.col(f"`{f.name}`")
            parts.append((F.array_sort(c) if isinstance(f.dataType, ArrayType) else c).alias(f.name))
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def diff_releases(
    prev: DataFrame,
    curr: DataFrame,
    id_col: str = "id",
    ignore: Sequence[str] = VERSION,
    pos: str | None = None,
    carry: bool = True,
) -> DataFrame:
    """All ids of both releases with their ``change`` and the current content.

    ``added``, ``edited``, ``deleted``, ``unchanged`` or ``withdrawn`` (already withdrawn before
    and still absent). Rows without id are left out; with ``pos`` the last of equal ids counts.
    ``carry`` brings the previous version columns along. One shuffle per release: both sides
    are hashed before the join, and of the previous one only id, hash and version columns move.
    """
    prev, curr = (with_version_columns(d.where(F.col(id_col).isNotNull())) for d in (prev, curr))
    if pos is not None:
        prev, curr = (last_wins_dedupe(d, [id_col], pos).drop(pos) for d in (prev, curr))
    skip = [*ignore, id_col]
    before = prev.select(
        F.col(id_col).alias("_id"),
        content_hash(prev, skip).alias("_before"),
        (F.coalesce(F.col("status") == WITHDRAWN, F.lit(False))).alias("_gone"),
        *[F.col(v).alias(f"_{v}") for v in VERSION],
    )
    after = curr.withColumn("_after", content_hash(curr, skip))
    both = after.join(before, F.col(id_col) == F.col("_id"), "full")
    live = F.col("_id").isNotNull() & ~F.coalesce("_gone", F.lit(False))
    here = F.col(id_col).isNotNull()
    change = (
        F.when(here & ~live, F.lit("added"))
        .when(here & (F.col("_before") != F.col("_after")), F.lit("edited"))
        .when(here, F.lit("unchanged"))
        .when(live, F.lit("deleted"))
        .otherwise(F.lit("withdrawn"))
    )
    props = [c for c in curr.columns if c not in (*VERSION, id_col)]

    def version(v: str) -> Column:
        carried = F.when(live | ~here, F.col(f"_{v}"))
        return (F.coalesce(F.col(v), carried) if carry else F.coalesce(F.col(v), F.when(~here, F.col(f"_{v}")))).alias(v)

    return both.select(
        F.coalesce(F.col(id_col), F.col("_id")).alias(id_col), change.alias("change"), *props, *[version(v) for v in VERSION]
    )


def stamp_created(diff: DataFrame, now: str, status: str = "active") -> DataFrame:
    added = F.col("change") == "added"
    return diff.withColumn("created", F.when(added, F.lit(now)).otherwise(F.col("created"))).withColumn(
        "status", F.when(added, F.lit(status_of(status))).otherwise(F.col("status"))
    )


def stamp_modified(diff: DataFrame, now: str, id_col: str = "id", accumulate: bool = True) -> DataFrame:
    """Edited nodes get a time and a link to their previous version, added or in place of older ones."""
    edited = F.col("change") == "edited"
    link = F.array(F.col(id_col))
    none = F.array().cast("array<string>")
    links = F.array_union(F.coalesce("is_version_of", none), link) if accumulate else link
    return diff.withColumn("modified", F.when(edited, F.lit(now)).otherwise(F.col("modified"))).withColumn(
        "is_version_of", F.when(edited, links).otherwise(F.col("is_version_of"))
    )


def tombstone_deleted(diff: DataFrame, now: str) -> DataFrame:
    """Deleted nodes stay as markers: withdrawn, modified now, nothing else."""
    deleted = F.col("change") == "deleted"
    return (
        diff.withColumn("status", F.when(deleted, F.lit(WITHDRAWN)).otherwise(F.col("status")))
        .withColumn("modified", F.when(deleted, F.lit(now)).otherwise(F.col("modified")))
        .withColumn("created", F.when(~deleted, F.col("created")))
        .withColumn("is_version_of", F.when(~deleted, F.col("is_version_of")))
    )


def apply_release(
    prev: DataFrame | None,
    curr: DataFrame,
    now: str,
    id_col: str = "id",
    status: str = "active",
    accumulate: bool = True,
    carry: bool = True,
    pos: str | None = None,
) -> DataFrame:
    """The stamped release, with ``change`` telling what happened to each node."""
    if curr is None or not now:
        raise ValueError("apply_release needs the current nodes and a timestamp")
    if id_col not in curr.columns:
        raise ValueError(f"the current nodes have no column {id_col}")
    diff = diff_releases(curr.limit(0) if prev is None else prev, curr, id_col, pos=pos, carry=carry)
    return tombstone_deleted(stamp_modified(stamp_created(diff, now, status), now, id_col, accumulate), now)


def change_summary(diff: DataFrame, id_col: str = "id") -> DataFrame:
    """``(change, id)`` of all changes, sorted; the sort is spread over all tasks."""
    return diff.where(F.col("change").isin("added", "edited", "deleted")).select("change", id_col).orderBy("change", id_col)


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def init_versioning(df: DataFrame, now: str, id_col: str = "id") -> tuple[DataFrame, int]:
    """Fills missing creation time and status only; also tells how many nodes that changed."""
    df = with_version_columns(df)
    has_id = F.col(id_col).isNotNull()
    gaps = has_id & (F.col("created").isNull() | F.col("status").isNull())
    updated = df.where(gaps).count()
    filled = df.withColumn("created", F.when(has_id, F.coalesce("created", F.lit(now)))).withColumn(
        "status", F.when(has_id, F.coalesce("status", F.lit(status_of("active"))))
    )
    return filled, updated


def id_difference(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    return a.select(id_col).exceptAll(b.select(id_col))


def id_intersection(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    return a.select(id_col).intersect(b.select(id_col))


def sort_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.select(id_col).orderBy(id_col)


# Version columns as predicates.
VERSION_TERMS = {
    "created": Term(vocab.CREATED, datatype=vocab.XSD + "dateTime"),
    "modified": Term(vocab.MODIFIED, datatype=vocab.XSD + "dateTime"),
    "is_version_of": Term(vocab.IS_VERSION_OF, "iri"),
    "status": Term(vocab.STATUS, "iri"),
}


def triple_nodes(triples: DataFrame) -> DataFrame:
    """Triples -> one row per subject: a print of its content and its version columns.

    The print is a count and two sums over the triples' hashes, so it does not depend on order
    and a subject with very many triples is folded before the shuffle, never listed.
    """
    own = ~F.col("predicate").isin(*[t.predicate for t in VERSION_TERMS.values()])
    parts = ["predicate", "object", "object_kind", "datatype", "lang"]
    filled = [F.coalesce(p, F.lit("")) for p in parts]

    def total(seed: str) -> Column:
        return F.sum(F.when(own, F.xxhash64(F.lit(seed), *filled).cast("decimal(38,0)")))

    def value(name: str) -> Column:
        return F.max(F.when(F.col("predicate") == VERSION_TERMS[name].predicate, F.col("object")))

    links = F.when(F.col("predicate") == vocab.IS_VERSION_OF, F.col("object"))
    return triples.groupBy(F.col("subject").alias("id")).agg(
        F.count_if(own).alias("n"), total("a").alias("print_a"), total("b").alias("print_b"),
        value("created").alias("created"), value("modified").alias("modified"),
        F.nullif(F.array_sort(F.collect_set(links)), F.array().cast("array<string>")).alias("is_version_of"),
        value("status").alias("status"),
    )


def release_triples(
    prev: DataFrame | None, curr: DataFrame, now: str, status: str = "active", accumulate: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``(triples, diff)``: the current triples with version triples, and what changed per node."""
    nodes = triple_nodes(curr)
    before = nodes.limit(0) if prev is None else triple_nodes(prev)
    stamped = apply_release(before, nodes, now, status=status, accumulate=accumulate)
    versions = rows_to_triples(stamped, VERSION_TERMS, "id")
    plain = curr.where(~F.col("predicate").isin(*[t.predicate for t in VERSION_TERMS.values()]))
    cols = ["subject", "predicate", "object", "object_kind", "datatype", "lang"]
    return plain.select(*cols).unionByName(versions.select(*cols)), stamped.select("id", "change")
