"""Concepts, schemes and the references between them.

References are edge rows ``(src, ref, pos)``; ``pos`` keeps the written order. A scheme with a
third of all concepts stays many rows and is never gathered into one list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions import cells, vocab
from listwright.operators.grouping import paired
from listwright.sources.releases import expand_curie
from listwright.sources.storage import table_of

SCHEME_TYPE = "skos:ConceptScheme"
CONCEPT_TYPE = "skos:Concept"

# Column -> names it is known by in source documents, first present one wins. References to the
# structure a field describes are named by each publisher; pass theirs as ``structure_ref``.
ALIASES: dict[str, tuple[str, ...]] = {
    "pref_label": ("prefLabel", "has_pref_label"),
    "alt_label": ("altLabel", "alt_label"),
    "definition": ("definition", "has_definition"),
    "note": ("note", "has_note"),
    "code": ("code", "notation"),
    "in_scheme": ("inScheme", "in_scheme"),
    "top_concept_of": ("topConceptOf", "top_concept_of"),
    "is_part_of": ("isPartOf", "broader"),
    "has_part": ("hasPart",),
    "narrower": ("narrower",),
    "see_also": ("seeAlso", "see_also"),
    "related": ("related",),
    "relation": ("relation",),
    "data_type": ("relevantDataType", "relevant_data_type"),
    "code_list": ("relevantCodeList", "relevant_code_list"),
    "unit": ("relevantUnit", "relevant_unit"),
    "structure_ref": (),
    "class": ("relevantClass", "relevant_class"),
    "property": ("relevantProperty", "relevant_property"),
    "condition_path": ("conditionPath", "condition_path"),
    "condition_value": ("conditionValue", "condition_value"),
    "is_required": ("isVerplicht", "is_verplicht"),
    "is_repeatable": ("isMeervoudig", "is_meervoudig"),
    "is_measurable": ("isMeetbaar", "is_meetbaar"),
    "is_hidden": ("isOnzichtbaar", "is_onzichtbaar"),
    "is_multiselect": ("isMultiselect", "is_multiselect"),
    "ui_first": ("_ui_first", "ui_first"),
    "ui_after": ("_ui_after", "ui_after"),
    "min_value": ("minValue",),
    "max_value": ("maxValue",),
}
_LISTS = ("alt_label", "is_part_of", "has_part", "narrower", "see_also", "related", "code_list", "unit", "structure_ref")
_BOOLEANS = ("is_required", "is_repeatable", "is_measurable", "is_hidden", "is_multiselect", "ui_first")
_NUMBERS = ("min_value", "max_value")


def classify_nodes(nodes: DataFrame) -> DataFrame:
    """Marks nodes as scheme and concept by their types; a node can be both or neither."""
    types = F.coalesce(F.col("types"), F.array().cast("array<string>"))
    return nodes.withColumn("is_scheme", F.array_contains(types, SCHEME_TYPE)).withColumn(
        "is_concept", F.array_contains(types, CONCEPT_TYPE)
    )


def project_concepts(
    nodes: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES, id_col: str = "id"
) -> DataFrame:
    """Nodes with source names -> concepts with typed columns; absent columns become null."""
    types = dict(nodes.dtypes)
    out = [F.col(id_col).alias("id")]
    for name, sources in aliases.items():
        present = [s for s in sources if s in types]
        is_list = name in _LISTS
        as_lists = [
            F.col(f"`{s}`") if types[s].startswith("array") else F.array_compact(F.array(F.col(f"`{s}`").cast("string")))
            for s in present
        ]
        if is_list:
            refs = [cells.split_refs(F.when(F.size(c) > 0, c)) for c in as_lists]
            c = F.coalesce(*refs) if refs else F.lit(None).cast("array<string>")
            if name == "alt_label" and refs:
                c = F.coalesce(*[F.when(F.size(x) > 0, x) for x in as_lists])
        else:
            firsts = [F.get(x, F.lit(0)) for x in as_lists]
            c = F.coalesce(*firsts) if firsts else F.lit(None).cast("string")
            if name in _BOOLEANS:
                c = cells.parse_boolean(c)
            elif name in _NUMBERS:
                c = cells.parse_number(c)
            elif name == "condition_path":
                c = F.get(cells.split_refs(F.array_compact(F.array(c))), F.lit(0))
        out.append(c.alias(name))
        if name == "condition_value":
            values = [cells.split_refs(F.when(F.size(x) > 0, x)) for x in as_lists]
            many = F.coalesce(*values) if values else F.lit(None).cast("array<string>")
            out[-1] = cells.normalize_condition_value(F.get(many, F.lit(0))).alias(name)
            out.append(F.transform(many, cells.normalize_condition_value).alias("condition_values"))
    return nodes.select(*out)


def edges(concepts: DataFrame, col: str, id_col: str = "id") -> DataFrame:
    """An array column as ``(src, ref, pos)`` rows."""
    return concepts.select(F.col(id_col).alias("src"), F.posexplode(col).alias("pos", "ref"))


def top_concepts(refs: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(scheme, pos, concept)`` for references that hit a concept, in written order."""
    known = concepts.select(F.col("id").alias("ref"))
    return refs.join(known, "ref", "left_semi").select(
        F.col("src").alias("scheme"), "pos", F.col("ref").alias("concept")
    )


def children_of(parts: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(parent, pos, child, …)`` for part references that hit a concept."""
    return parts.join(concepts.withColumnRenamed("id", "ref"), "ref").select(
        F.col("src").alias("parent"), "pos", F.col("ref").alias("child"),
        *[c for c in concepts.columns if c != "id"],
    )


def parent_of(concepts: DataFrame) -> DataFrame:
    """Every concept with its first parent; null when there is none or it is unknown."""
    first = F.get("is_part_of", F.lit(0))
    known = concepts.select(F.col("id").alias("parent"))
    return (
        concepts.select("id", first.alias("wanted"))
        .join(known, F.col("wanted") == F.col("parent"), "left")
        .select("id", "parent")
    )


def top_level_only(tops: DataFrame, concepts: DataFrame) -> DataFrame:
    """Top concepts that are not part of another concept."""
    inner = concepts.where(F.size("is_part_of") > 0).select(F.col("id").alias("concept"))
    return tops.join(inner, "concept", "left_anti")


def resolve_refs(refs: DataFrame, schemes: DataFrame, concepts: DataFrame) -> DataFrame:
    """Reference -> scheme, else concept, else dropped. Both lookups share one join."""
    targets = (
        schemes.select("id", F.lit("a scheme").alias("rank"))
        .unionByName(concepts.select("id", F.lit("b concept").alias("rank")))
        .groupBy("id")
        .agg(F.substring(F.min("rank"), 3, 10).alias("kind"))
    )
    return refs.join(targets, refs["ref"] == targets["id"]).select("src", "pos", "ref", "kind")


def resolve_theme_scheme(see_also: DataFrame, fallback: DataFrame, schemes: DataFrame) -> DataFrame:
    """Theme -> first see-also target that is a scheme, else first fallback target that is one."""
    ranked = see_also.withColumn("rank", F.lit(0)).unionByName(fallback.withColumn("rank", F.lit(1)))
    hits = ranked.join(schemes.select(F.col("id").alias("ref")), "ref", "left_semi")
    return hits.groupBy(F.col("src").alias("theme")).agg(
        F.min_by("ref", F.struct("rank", "pos")).alias("scheme")
    )


def resolve_enum_values(
    fields: DataFrame, tops: DataFrame, prefixes, external: Sequence[str] = (), **sizes
) -> DataFrame:
    """Options of each field: top concepts of its code lists, expanded, with labels.

    ``fields (field, ref, pos)``, ``tops (scheme, pos, concept, label)``. Order is
    ``(list_pos, pos)``. Lists without top concepts give no rows; see the reference report.
    """
    local = fields.where(cells.classify_reference(F.col("ref"), external).isin("local", "excluded"))
    # An option is expanded once, not once for each field that offers it.
    options = expand_curie(tops.select("scheme", "pos", "concept", "label"), "concept", prefixes, "value").select(
        F.col("scheme").alias("ref"), "pos", "value", F.coalesce(F.nullif("label", F.lit("")), "value").alias("label")
    )
    # Options lead: what leads a merge join is read once, what is met once for every pair, and fields are shorter.
    hits = paired(options, local.select("field", "ref", F.col("pos").alias("list_pos")), "ref", **sizes)
    return hits.select("field", "list_pos", "pos", "value", "label")


def unresolved_ref_report(
    refs: DataFrame, schemes: DataFrame, tops: DataFrame, external: Sequence[str] = ()
) -> DataFrame:
    """References that yield no options, with the reason."""
    distinct = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    known = schemes.select(F.col("id").alias("ref")).distinct().withColumn("known", F.lit(True))
    filled = tops.select(F.col("scheme").alias("ref")).distinct().withColumn("filled", F.lit(True))
    kind = cells.classify_reference(F.col("ref"), external)
    reason = (
        F.when(kind.isin("placeholder", "external"), kind)
        .when(F.col("known").isNull(), F.lit("not found"))
        .when(F.col("filled").isNull(), F.lit("no top concepts"))
    )
    return (
        distinct.join(known, "ref", "left")
        .join(filled, "ref", "left")
        .select("ref", reason.alias("reason"), "n")
        .where("reason IS NOT NULL")
    )


def enrich_labels(df: DataFrame, id_col: str, uri_array_col: str, labels: DataFrame) -> DataFrame:
    """``(id, pos, uri, label, resolved)``: the label of every listed IRI, in list order.

    ``labels (uri, pref_label, code)``. Units show their code; unknown IRIs a readable rest.
    """
    items = df.select(id_col, F.posexplode(uri_array_col).alias("pos", "uri"))
    named = labels.where(F.coalesce(F.col("pref_label"), F.lit("")) != "")
    as_unit = (F.coalesce(F.col("code"), F.lit("")) != "") & F.col("uri").contains("qudt")
    shown = F.when(as_unit, F.col("code")).otherwise(F.col("pref_label"))
    table = named.select("uri", shown.alias("_label"))
    return items.join(table, "uri", "left").select(
        id_col,
        "pos",
        "uri",
        F.coalesce("_label", cells.uri_fallback_label("uri")).alias("label"),
        F.col("_label").isNotNull().alias("resolved"),
    )


def unresolved_uris(enriched: DataFrame) -> DataFrame:
    return enriched.where("NOT resolved").select("uri").distinct()


def resolve_unit_label(
    fields: DataFrame, units: DataFrame, schemes: DataFrame, overrides: Mapping[str, str] = vocab.UNIT_LABELS
) -> DataFrame:
    """Unit of each field: a list of units, else a unit's code or label, else a local name.

    ``fields (field, pos, ref)``, ``units (id, code, label)``, ``schemes (id)``.
    """
    targets = schemes.select("id", F.lit(True).alias("is_list"), F.lit(None).cast("string").alias("text"))
    named = units.select(
        "id", F.lit(False).alias("is_list"), F.coalesce("code", "label", "id").alias("text")
    )
    # A reference that is both counts as a list.
    known = targets.unionByName(named).groupBy("id").agg(
        F.bool_or("is_list").alias("is_list"), F.max("text").alias("text")
    )
    hits = fields.join(known, fields["ref"] == known["id"], "left")
    is_unit = F.col("id").isNotNull() & ~F.col("is_list")
    per_field = hits.groupBy("field").agg(
        F.min_by(F.when(F.col("is_list"), F.col("ref")), F.when(F.col("is_list"), F.col("pos"))).alias("unit_list"),
        F.max_by(F.when(is_unit, F.col("text")), F.when(is_unit, F.col("pos"))).alias("unit"),
        F.max_by("ref", "pos").alias("last"),
    )
    override = F.nullif(cells.lookup(F.col("last"), dict(overrides)), F.lit(""))
    text = F.coalesce("unit", override, cells.after_last_colon(F.col("last")))
    return per_field.select(
        "field",
        "unit_list",
        F.when(F.col("unit_list").isNull(), text).alias("unit_label"),
    )


def local_name_match(refs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Reference -> concept with that id, else the first concept with the same local name."""
    names = (
        concepts.withColumn("_name", cells.local_name("id"))
        .where("_name IS NOT NULL")
        .groupBy("_name")
        .agg(F.min_by("id", "pos").alias("by_name"))
    )
    exact = concepts.select(F.col("id").alias("by_id")).distinct()
    # Each distinct reference is resolved once, so a popular one is not shuffled many times.
    distinct = refs.select("ref").distinct()
    resolved = (
        distinct.join(exact, F.col("ref") == F.col("by_id"), "left")
        .withColumn("_wanted", cells.local_name("ref"))
        .join(names, F.col("_wanted") == F.col("_name"), "left")
        .select("ref", F.coalesce("by_id", "by_name").alias("concept"))
    )
    return refs.join(resolved, "ref", "left")


def resolve_order_anchor(
    fields: DataFrame, names: DataFrame, by: Sequence[str], relations: DataFrame | None = None
) -> DataFrame:
    """Concept id in ``after`` -> name of that concept's property.

    ``names (*by, concept, property)``; ``relations (concept, relation)`` gives the envelope
    name of concepts folded into the envelope. Unresolved ones are null.
    """
    keys = list(by)
    table = names.select(*keys, F.col("concept").alias("after"), F.col("property").alias("after_property"))
    out = fields.join(table, [*keys, "after"], "left")
    if relations is not None:
        folded = relations.where(F.col("relation").isin(*vocab.ENVELOPE_BY_RELATION)).select(
            F.col("concept").alias("after"),
            cells.lookup(F.col("relation"), vocab.ENVELOPE_BY_RELATION).alias("_envelope"),
        )
        out = out.join(folded, "after", "left").withColumn(
            "after_property", F.coalesce("after_property", "_envelope")
        )
    return out.select(*fields.columns, "after_property")


def prefix_table(spark, prefixes: Mapping[str, str]) -> DataFrame:
    return table_of(spark, list(prefixes.items()), "prefix string, base string")
