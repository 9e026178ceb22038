"""The three runs a user starts: curate the lists, derive rules, derive entry templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions import cells, vocab
from listwright.operators import checks, definitions, infer, ordering, references, rules, shapes, templates
from listwright.operators.checks import ViolationsFound
from listwright.operators.ranking import sorted_numbers
from listwright.operators.release import change_counts, release_triples
from listwright.operators.themes import ThemeTables
from listwright.operators.triples import Term, orphan_filter, rows_to_triples
from listwright.sources.csvs import csv_shape_check, csv_union_with_source, header_counts, read_lines
from listwright.sources.releases import expand_curie, release_load, release_write
from listwright.sources.storage import cut

TRIPLE = "subject string, predicate string, object string, object_kind string, datatype string, lang string"


@dataclass(frozen=True)
class Lists:
    """What the curate run is told about the source lists."""

    context: Mapping[str, Term]
    prefixes: Mapping[str, str]
    rules: Sequence[infer.Rule] = ()
    shape_rules: Sequence[shapes.ShapeRule] = ()
    reference_col: str | None = None
    strict_compat: bool = False
    # Whether also lines with too few cells stop a run, instead of being filled up.
    strict_columns: bool = False


def split_cells(rows: DataFrame, strict_compat: bool = False, keep: Sequence[str] = ("_id", "__source", "row")) -> DataFrame:
    """Every cell as a list of its values."""
    return rows.select(
        *[
            F.col(c) if c in keep else cells.split_multi_value(F.col(c), c, strict_compat).alias(c)
            for c in rows.columns
        ]
    )


def expand_triples(triples: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """Subjects and IRI objects written with a prefix become full IRIs."""
    subjects = expand_curie(triples, "subject", dict(prefixes))
    full = expand_curie(subjects.withColumn("_iri", F.when(F.col("object_kind") == "iri", F.col("object"))), "_iri", dict(prefixes))
    return full.withColumn("object", F.coalesce("_iri", "object")).drop("_iri", "pos")


def inferred(triples: DataFrame, extra: Sequence[infer.Rule] = ()) -> DataFrame:
    """Given triples and all that follow from them, with the kinds of their values."""
    graph = infer.apply_rules(triples.select(*infer.SPO), [*infer.standard_rules(), *extra])
    new = graph.join(triples.select(*infer.SPO).distinct(), list(infer.SPO), "left_anti")
    literal = triples.where("object_kind = 'literal'").select("subject", "object", "datatype", "lang").distinct()
    # A value copied to a wider property keeps its kind; everything else that is derived is an IRI.
    kinds = literal.groupBy("subject", "object").agg(F.min("datatype").alias("datatype"), F.min("lang").alias("lang"))
    typed = new.join(kinds, ["subject", "object"], "left").select(
        *infer.SPO, F.when(F.col("datatype").isNotNull(), F.lit("literal")).otherwise(F.lit("iri")).alias("object_kind"), "datatype", "lang"
    )
    return triples.unionByName(typed)


def _stop(found: DataFrame, text: str) -> None:
    first = found.limit(3).collect()
    if first:
        raise ViolationsFound(f"{text}: {[r.asDict() for r in first]}")


def curate(
    spark: SparkSession, paths: Sequence[str], lists: Lists, base_dir: str, release: str, now: str, check_only: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CSV lists -> checked, inferred and stamped release under ``base_dir``.

    Returns ``(triples, change counts, shape violations)``. Lines with more cells than their header,
    undeclared prefixes, dangling references and shape violations of own subjects stop the run before
    anything is written. Lines with too few cells are filled up, unless ``strict_columns`` is set.
    """
    lines = read_lines(spark, paths)
    issues = csv_shape_check(lines, header_counts(lines))
    _stop(issues if lists.strict_columns else issues.where("type = 'extra'"), "lines do not fit their header")
    rows = csv_union_with_source(spark, paths)
    split = cut(split_cells(rows.withColumn("row", F.monotonically_increasing_id()), lists.strict_compat))
    used = checks.cells_of(split.withColumn("_id", F.array("_id")), "row")
    _stop(checks.undeclared_prefix_check(used, lists.prefixes), "undeclared prefixes")
    if lists.reference_col:
        ids = split.where("_id IS NOT NULL").select(F.col("_id").alias("id"))
        holders = split.where(F.col(lists.reference_col).isNotNull()).select("row", "__source", lists.reference_col)
        _stop(checks.dangling_reference_check(holders, lists.reference_col, ids).select("row", "__source", "ref"), "dangling references")
    graph = expand_triples(rows_to_triples(split, lists.context), lists.prefixes)
    kept = cut(orphan_filter(inferred(cut(graph.distinct()), lists.rules)))
    schema = spark.createDataFrame([], TRIPLE).schema
    prev = release_load(spark, base_dir, schema=schema)
    triples, diff = release_triples(prev.select(*schema.names), kept, now)
    triples = cut(triples)
    violations = checks.drop_excluded_subjects(shapes.check_shapes(kept, lists.shape_rules)) if lists.shape_rules else (
        spark.createDataFrame([], "focus string, target_class string, path string, component string, detail string")
    )
    _stop(violations, "shape constraints violated")
    if not check_only:
        release_write(triples, base_dir, release)
    return triples, change_counts(diff), violations


@dataclass(frozen=True)
class ThemeRules:
    """Tables of the derived rules, each with a ``theme`` column."""

    chain: DataFrame
    fields: DataFrame
    tree: DataFrame
    variants: DataFrame
    variant_rules: DataFrame
    options: DataFrame
    required: DataFrame
    conditions: DataFrame
    measurable: DataFrame
    bounds: DataFrame


def _bounds_of_themes(fields: DataFrame) -> DataFrame:
    bounds = rules.value_bounds_rules(fields).distinct()
    themes = fields.select("theme", F.col("concept").alias("property")).distinct()
    return bounds.join(themes, "property")


def derive_rules(concepts: DataFrame, schemes: DataFrame, tops: DataFrame, prefixes: Mapping[str, str]) -> ThemeRules:
    """Rules of all themes at once.

    ``concepts`` as ``project_concepts`` gives them with a ``pos``, ``schemes (id, pos)``,
    ``tops (src, pos, ref)``.
    """
    spark = concepts.sparkSession
    prefix = references.prefix_table(spark, prefixes)
    see_also = references.edges(concepts, "see_also")
    hits = references.top_concepts(tops, concepts)
    themes = cut(infer.resolve_all_themes(schemes, hits, see_also, concepts))
    members = concepts.where("in_scheme IS NOT NULL").select(F.col("in_scheme").alias("scheme"), "pos", F.col("id").alias("concept"))
    links = infer.scheme_links(hits, members, see_also, schemes)
    start = themes.select(F.col("label").alias("theme"), "scheme")
    reached = infer.bridge_schemes(infer.scheme_reachability(start, links), see_also, schemes)
    order = F.struct("depth", "path", "scheme")
    # The place in discovery order: schemes of one depth differ, and the later one counts as deeper.
    chain = sorted_numbers(reached, ["theme"], ["depth", "path", "scheme"], "ord").select("theme", "scheme", "ord", order.alias("at"))
    mapped = rules.map_fields(concepts, prefix)
    composed = infer.compose_theme_fields(chain.select("theme", "scheme", "ord"), hits, mapped)
    fields = rules.suffix_duplicates(
        composed.withColumn("name", F.col("property")), ["theme"], "name", "pos", "final", F.col("relation").isNotNull()
    ).drop("name", "property").withColumnRenamed("final", "property")
    fields = cut(fields)
    regular = fields.where(~F.coalesce(F.col("class") == vocab.OBSERVATION_CLASS, F.lit(False)))
    coded = references.edges(concepts, "code_list").withColumnRenamed("src", "field")
    labelled = hits.join(concepts.select(F.col("id").alias("concept"), F.col("pref_label").alias("label")), "concept")
    options = references.resolve_enum_values(coded, labelled, prefix).join(
        fields.select("theme", F.col("concept").alias("field")).distinct(), "field"
    )
    conditions = fields.where("trigger IS NOT NULL").select("theme", "concept", "trigger", "property", "condition_values")
    shaped = fields.select(
        "theme", F.col("concept").alias("id"), F.get("is_part_of", F.lit(0)).alias("parent"), "pos", "label", "required",
        F.col("relation_uri").alias("relation"), F.get("condition_values", F.lit(0)).alias("condition"),
    )
    related = references.edges(concepts, "related").select(F.col("src").alias("a"), F.col("ref").alias("b"))
    components = rules.variant_components(shaped, related, ["theme"])
    children = cut(rules.variant_children(shaped, components, ["theme"]))
    return ThemeRules(
        chain=chain,
        fields=fields,
        tree=rules.nest_children(shaped, ["theme"]),
        variants=rules.merge_variants(children, ["theme", "component"]),
        variant_rules=rules.required_when(children, ["theme", "component"]),
        options=options,
        required=rules.required_set(fields, ["theme"]),
        conditions=conditions.select("theme", "trigger", F.explode("condition_values").alias("value"), "property"),
        measurable=rules.measurable_concepts(chain, concepts, prefix),
        bounds=expand_curie(_bounds_of_themes(regular), "property", prefix),
    )


def theme_tables(rules: ThemeRules) -> ThemeTables:
    """The derived rules as ``validate_by_theme`` takes them: members go by their property names."""
    plain = rules.fields.where(~F.coalesce(F.col("class") == vocab.OBSERVATION_CLASS, F.lit(False)))
    names = plain.select("theme", F.col("concept").alias("_concept"), F.col("property").alias("_name")).distinct()

    def named(df: DataFrame, concept: str, out: str) -> DataFrame:
        right = names.withColumnsRenamed({"theme": "_theme", "_name": out})
        on = (F.col("theme") == F.col("_theme")) & (F.col(concept) == F.col("_concept"))
        return df.join(right, on).drop("_theme", "_concept")

    bounds = rules.bounds
    required = rules.required.select("theme", "property")
    results = required.select("theme").distinct().select("theme", F.explode(F.lit(list(vocab.RESULT_REQUIRED))).alias("property"))
    return ThemeTables(
        required=required.unionByName(results),
        types=plain.where(F.col("type").isin("number", "boolean")).select("theme", "property", "type"),
        items=plain.where("required AND repeatable").select("theme", "property"),
        options=named(rules.options.select("theme", "field", "value"), "field", "property").select("theme", "property", "value"),
        bounds=bounds.where("minimum IS NOT NULL OR maximum IS NOT NULL").select("theme", "property", "minimum", "maximum"),
        units=bounds.select("theme", "property", F.explode("units").alias("unit")),
        conditional=named(rules.conditions.withColumnRenamed("trigger", "_asked"), "_asked", "trigger").select(
            "theme", "trigger", "value", "property"
        ),
    )


def derive_templates(
    defs: DataFrame, def_col: str, json_col: str, labels: DataFrame, base: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(columns, options)``: ordered template columns with their sheet, and labelled choices.

    References between definitions, and into those of ``base`` which get no columns of their own, are opened
    first. What conditional blocks add comes behind a definition's own columns, in the blocks' order.
    """
    given = defs.select(F.col(def_col).cast("string").alias("def"), F.col(json_col).alias("json"), F.lit(True).alias("asked"))
    if base is not None:
        given = given.unionByName(base.select(F.col(def_col).cast("string").alias("def"), F.col(json_col).alias("json"), F.lit(False).alias("asked")))
    opened = cut(definitions.resolve_references(given, "def", "json").where("asked").select("def", "json"))
    leaves = cut(templates.flatten_schema_paths(opened, "def", "json"))
    flat = templates.template_columns(leaves)
    ranked = flat.withColumn("at", F.col("pos")).drop("pos")
    numbered = sorted_numbers(ranked, ["def"], ["at"], "pos")
    best = templates.dedupe_most_complete(
        numbered.drop("at"), ["def", "path"], ["title", "description", "readonly_value", "parent_array", "ui_after"], "pos"
    )
    described = best.select("def", "path", "description", "parent_array", F.col("pos").alias("at"), "ui_first", "ui_after")
    conditional = templates.conditional_required_columns(
        best.select("def", "path", "title", "ui_type", "required", "readonly_value"),
        definitions.conditional_blocks(opened, "def", "json"), with_place=True,
    )
    both = conditional.join(described, ["def", "path"], "left").withColumns(
        {"late": F.col("at").isNull(), "ui_first": F.coalesce("ui_first", F.lit(False))}
    )
    best = cut(sorted_numbers(both, ["def"], ["late", "at", "block_pos", "path"], "pos").drop("late", "at", "block_pos"))
    placed = ordering.order_columns(
        best.select("def", "path", "title", "pos", F.col("ui_after").alias("after"), F.col("ui_first").alias("first")), ["def"]
    )
    sheets = templates.theme_group_columns(
        best.select(F.col("def").cast("string").alias("theme"), "path", "title", "parent_array", "pos")
    ).select(F.col("theme").alias("_theme"), F.col("path").alias("_path"), "sheet", "parent_path")
    columns = best.join(placed, ["def", "path"]).join(
        sheets, (F.col("def").cast("string") == F.col("_theme")) & (F.col("path") == F.col("_path"))
    ).drop("_theme", "_path")
    offered = templates.collect_enum_options(leaves.withColumn("at", F.struct("def", "path")), "at", "source")
    listed = offered.select("def.*", F.col("pos").alias("at"), F.array("option").alias("uris")).withColumn("key", F.struct("def", "path", "at"))
    options = references.enrich_labels(listed, "key", "uris", labels).select("key.*", "uri", "label", "resolved")
    return columns, options
