"""From concepts to per-theme field rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import cells, vocab
from listwright.operators.grouping import paired
from listwright.operators.infer import related_components
from listwright.operators.ranking import previous_value, row_numbers
from listwright.sources.releases import expand_curie
from listwright.sources.storage import cut


def filter_visible_fields(concepts: DataFrame) -> DataFrame:
    """Drops hidden concepts and concepts without id or label."""
    shown = ~F.coalesce(F.col("is_hidden"), F.lit(False))
    return concepts.where(shown & (F.coalesce("id", F.lit("")) != "") & (F.coalesce("pref_label", F.lit("")) != ""))


def _filled(name: str) -> Column:
    return F.coalesce(F.size(name) > 0, F.lit(False))


def map_fields(concepts: DataFrame, prefixes) -> DataFrame:
    """Concept -> rule field. One projection; the relation prefix is looked up in a small table."""
    coded = _filled("code_list")
    if "structure_ref" in concepts.columns:
        coded = coded | _filled("structure_ref")
    has_parts = _filled("narrower")
    kind = cells.map_data_type(F.col("data_type"), has_parts)
    units = F.filter(F.coalesce("unit", F.array().cast("array<string>")), lambda u: ~u.startswith("http://TODO"))
    unit_kind = F.when(F.size(units) == 1, F.lit("const")).when(F.size(units) > 1, F.lit("enum"))
    has_condition = F.col("condition_path").isNotNull() & (F.coalesce("condition_value", F.lit("")) != "")
    relation = F.col("relation")
    mapped = filter_visible_fields(concepts).select(
        F.col("id").alias("concept"),
        F.when(relation.isNotNull(), cells.relation_name(relation)).otherwise(cells.property_name("id")).alias("property"),
        F.col("pref_label").alias("label"),
        F.coalesce(F.nullif("definition", F.lit("")), F.nullif("note", F.lit(""))).alias("description"),
        kind.alias("type"),
        F.coalesce("is_required", F.lit(False)).alias("required"),
        F.coalesce("is_repeatable", F.lit(False)).alias("repeatable"),
        relation.alias("relation"),
        F.when(relation.isNotNull(), cells.map_semantic_type(F.col("data_type"), kind, coded))
        .when(~coded & (kind == "string"), cells.dated_type(F.col("data_type"))).alias("semantic_type"),
        units.alias("units"),
        unit_kind.alias("unit_kind"),
        (~coded & F.coalesce(F.col("data_type").isin("xsd:decimal", "xsd:integer"), F.lit(False))).alias("numeric"),
        F.col("min_value").alias("minimum"),
        F.col("max_value").alias("maximum"),
        F.when(has_condition, F.col("condition_path")).alias("trigger"),
        F.when(has_condition, F.coalesce("condition_values", F.array("condition_value"))).alias("condition_values"),
        (F.coalesce(relation == vocab.FEATURE_RELATION, F.lit(False))).alias("is_feature"),
        (F.coalesce(relation == vocab.RESULT_RELATION, F.lit(False))).alias("is_result"),
        F.col("class").alias("class"),
        "in_scheme",
        "is_part_of",
        F.coalesce("ui_first", F.lit(False)).alias("ui_first"),
        "ui_after",
    )
    return expand_curie(mapped, "relation", prefixes, "relation_uri")


def measurable_concepts(chain: DataFrame, concepts: DataFrame, prefixes, **sizes) -> DataFrame:
    """``(theme, concept)``: visible concepts of the theme's schemes that carry a type or unit
    and are not part of an observation composite.

    A concept that is in one scheme only gives each theme once, so only rows of concepts in several
    schemes are compared with one another.
    """
    composites = concepts.where(F.col("class") == vocab.OBSERVATION_CLASS).select(F.col("id").alias("parent"))
    carrying = concepts.where(
        ~F.coalesce(F.col("is_hidden"), F.lit(False)) & (F.col("data_type").isNotNull() | _filled("unit"))
    ).withColumn("parent", F.get("is_part_of", F.lit(0)))
    free = carrying.join(composites, "parent", "left_anti")
    full = expand_curie(free.where("in_scheme IS NOT NULL").select("id", "in_scheme"), "id", prefixes, "concept")
    schemes = full.groupBy("concept").agg(F.min("in_scheme").alias("in_scheme"), F.max("in_scheme").alias("_last"))
    schemes = cut(schemes)
    themes = cut(chain.select("theme", F.col("scheme").alias("in_scheme")).distinct())
    of_one = schemes.where("in_scheme = _last").select("concept", "in_scheme")
    hits = paired(of_one, themes, "in_scheme", **sizes).select("theme", "concept")
    several = schemes.where("in_scheme <> _last").select(F.col("concept").alias("_concept"))
    if several.isEmpty():
        return hits
    of_several = full.select("concept", "in_scheme").distinct().join(several, F.col("concept").eqNullSafe(F.col("_concept")), "left_semi")
    return hits.unionByName(paired(of_several, themes, "in_scheme", **sizes).select("theme", "concept").distinct())


def nest_children(fields: DataFrame, by: Sequence[str] = (), max_depth: int | None = None) -> DataFrame:
    """Adds ``(parent, root, depth, path)``: where each field sits in its group's tree.

    ``fields (*by, id, parent, pos, …)``. A parent outside the fields makes a root. ``path``
    sorts like the nested form; a parent with children is an ``object``. One round per level.
    """
    keys = list(by)
    known = fields.select(*keys, F.col("id").alias("parent")).distinct().withColumn("_known", F.lit(True))
    placed = cut(
        fields.select(*keys, "id", "parent", "pos")
        .join(known, [*keys, "parent"], "left")
        .select(*keys, "id", F.when(F.col("_known"), F.col("parent")).alias("parent"), "pos")
    )
    level = placed.where("parent IS NULL").select(
        *keys, "id", "parent", F.col("id").alias("root"), F.lit(0).alias("depth"),
        F.array(F.col("pos").cast("long")).alias("path"),
    )
    below = placed.where("parent IS NOT NULL")
    levels, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        up = level.select(*keys, F.col("id").alias("parent"), "root", F.col("path").alias("_up"))
        level = cut(
            below.join(up, [*keys, "parent"]).select(
                *keys, "id", "parent", "root", F.lit(depth).alias("depth"),
                F.concat("_up", F.array(F.col("pos").cast("long"))).alias("path"),
            )
        )
        if level.isEmpty():
            break
        levels = levels.unionByName(level)
    parents = below.select(*keys, F.col("parent").alias("id")).distinct().withColumn("is_object", F.lit(True))
    return levels.join(parents, [*keys, "id"], "left").withColumn(
        "is_object", F.coalesce("is_object", F.lit(False))
    )


def suffix_duplicates(
    fields: DataFrame, by: Sequence[str], name: str, pos: str, out: str, exempt: Column | None = None, **sizes
) -> DataFrame:
    """Second, third … use of a name gets 1, 2 … at its end; exempt rows keep theirs."""
    free = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    counted = row_numbers(fields.where(~free), [*by, name], [pos], "_use", **sizes)
    n = F.col("_use") - 1
    named = counted.select(
        *fields.columns, F.when(n > 0, F.concat(F.col(name), n.cast("string"))).otherwise(F.col(name)).alias(out)
    )
    if exempt is None:
        return named
    return named.unionByName(fields.where(free).withColumn(out, F.col(name)))


def prefix_on_collision(fields: DataFrame, by: Sequence[str], name: str, uri: str, pos: str) -> DataFrame:
    """``(*by, key, …)``: a name used more than once gets its vocabulary's prefix; the last of equal keys stays.

    The row to keep is chosen per (name, uri) before names are counted, so a popular name is a
    few rows by then.
    """
    rest = [c for c in fields.columns if c not in (*by, name, uri)]
    best = fields.groupBy(*by, name, uri).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(*rest), pos).alias("_row")
    )
    total = best.groupBy(*by, name).agg(F.sum("_n").alias("_total"))
    use = (F.col("_total") > 1) & F.col(uri).isNotNull()
    key = F.when(use, cells.prefixed_relation_name(F.col(uri), F.col(name))).otherwise(F.col(name))
    keyed = best.join(total, [*by, name]).withColumn("key", key)
    return (
        keyed.groupBy(*by, "key")
        .agg(F.max_by(F.struct(name, uri, F.col("_row")), F.col(f"_row.{pos}")).alias("_k"))
        .select(*by, "key", f"_k.{name}", f"_k.{uri}", "_k._row.*")
    )


def last_wins_dedupe(df: DataFrame, by: Sequence[str], pos: str) -> DataFrame:
    """One row per key: the last one."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), pos).alias("_r")).select(*by, "_r.*")


def chain_previous(fields: DataFrame, by: Sequence[str], pos: str, concept: str, out: str = "after", **sizes) -> DataFrame:
    """Every merged child renders after the one before it."""
    return previous_value(fields, by, [pos], concept, out, **sizes)


def common_prefix(df: DataFrame, by: Sequence[str], col: str, out: str = "name") -> DataFrame:
    """Longest common prefix of a group's texts: that of its least and its greatest text."""
    ends = df.groupBy(*by).agg(F.min(col).alias("_a"), F.max(col).alias("_b"))
    n = F.least(F.length("_a"), F.length("_b"))
    same = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring("_a", i, 1) == F.substring("_b", i, 1))
    # Entry 1 is a place holder (0 = empty text), entry i + 1 compares character i.
    same = F.concat(F.array(F.lit(True)), F.slice(same, 2, F.greatest(n, F.lit(1))))
    first_gap = F.array_position(same, F.lit(False))
    shared = F.when(n == 0, F.lit("")).when(first_gap == 0, F.substring("_a", F.lit(1), n)).otherwise(
        F.substring("_a", F.lit(1), (first_gap - 2).cast("int"))
    )
    return ends.select(*by, F.regexp_replace(shared, "-+$", "").alias(out))


def variant_components(fields: DataFrame, related: DataFrame, by: Sequence[str], require_condition: bool = True) -> DataFrame:
    """``(*by, component, id)``: composites that are variants of one another.

    ``fields (*by, id, parent, condition)``, ``related (a, b)``. Variants are siblings with
    children linked by ``related`` in either direction, directly or through other variants; with
    ``require_condition`` only those that show under a condition. Composites without a partner
    are left out.
    """
    keys = list(by)
    parents = fields.select(*keys, F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    composites = fields.join(parents, [*keys, "id"], "left_semi").select(*keys, "id", "parent", "condition")
    if require_condition:
        composites = composites.where("condition IS NOT NULL")
    sibling = F.struct(*keys, F.coalesce("parent", F.lit("")).alias("parent"))
    left = composites.select(F.col("id").alias("a"), sibling.alias("siblings"))
    right = composites.select(F.col("id").alias("b"), sibling.alias("siblings"))
    edges = related.where("a <> b").join(left, "a").join(right, ["siblings", "b"])
    found = related_components(edges.select("siblings", "a", "b"), "siblings")
    return found.select(*[F.col("siblings")[k].alias(k) for k in keys], "component", F.col("node").alias("id"))


def variant_children(fields: DataFrame, components: DataFrame, by: Sequence[str]) -> DataFrame:
    """Children of all variants of a component, ready for ``merge_variants``.

    ``fields (*by, id, parent, condition, relation, label, required, pos)``.
    """
    keys = list(by)
    variants = components.join(fields.select(*keys, "id", "condition"), [*keys, "id"])
    children = fields.select(
        *keys, F.col("parent"), "relation", "label", F.col("id").alias("concept"), "required", "pos"
    )
    return variants.withColumnRenamed("id", "parent").join(children, [*keys, "parent"])


def variant_key(relation: Column, label: Column) -> Column:
    return F.concat(F.coalesce(relation, F.lit("")), F.lit("::"), F.lower(cells.strip(F.coalesce(label, F.lit("")))))


def merge_variants(children: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per merged child: ``(*by, child_key, label, property, concept, first_pos, appearances, required)``.

    ``children (*by, relation, label, concept, required, pos)``. A child is required only where
    every variant requires it; it stands where it first appeared.
    """
    keyed = children.withColumn("child_key", variant_key(F.col("relation"), F.col("label")))
    return keyed.groupBy(*by, "child_key").agg(
        F.min_by("label", "pos").alias("label"),
        F.min_by("concept", "pos").alias("concept"),
        F.min("pos").alias("first_pos"),
        F.count(F.lit(1)).alias("appearances"),
        F.bool_and("required").alias("required"),
    ).withColumn("property", cells.label_name("label"))


def variant_conditions(children: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(*by, child_key, condition)``: the trigger values under which a merged child shows."""
    keyed = children.withColumn("child_key", variant_key(F.col("relation"), F.col("label")))
    return keyed.where(F.coalesce("condition", F.lit("")) != "").select(*by, "child_key", "condition").distinct()


def required_when(children: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(*by, condition, child_key)``: children a trigger value makes required.

    A null ``child_key`` says that the value makes the group itself visible.
    """
    needed = merge_variants(children, by).where("required").select(*by, "child_key")
    rules = variant_conditions(children, by).join(needed, [*by, "child_key"], "left_semi")
    shown = children.where(F.coalesce("condition", F.lit("")) != "").select(*by, "condition").distinct()
    return rules.select(*by, "condition", "child_key").unionByName(
        shown.withColumn("child_key", F.lit(None).cast("string"))
    )


def distinct_units(fields: DataFrame, by: Sequence[str], unit_col: str) -> DataFrame:
    """``(*by, unit, kind)``: units of a group without placeholders; one is a constant, more a choice."""
    plain = not dict(fields.dtypes)[unit_col].startswith("array")
    unit = F.col(unit_col) if plain else F.explode(unit_col)
    units = fields.select(*by, unit.alias("unit")).where(
        F.col("unit").isNotNull() & ~cells.is_placeholder(F.col("unit"))
    ).distinct()
    n = units.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return units.join(n, list(by)).select(
        *by, "unit", F.when(F.col("_n") == 1, F.lit("const")).otherwise(F.lit("enum")).alias("kind")
    )


def required_set(fields: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(*by, property)``: the envelope's required fields and the group's own, each once.

    ``fields (*by, property, required, is_feature)``; observation composites (``class``) have
    their own rule sets and are left out.
    """
    if "class" in fields.columns:
        fields = fields.where(~F.coalesce(F.col("class") == vocab.OBSERVATION_CLASS, F.lit(False)))
    own = fields.where(F.col("required") & ~F.coalesce(F.col("is_feature"), F.lit(False))).select(*by, "property")
    envelope = fields.select(*by).distinct().select(
        *by, F.explode(F.array(*[F.lit(x) for x in vocab.ENVELOPE_REQUIRED])).alias("property")
    )
    return envelope.unionByName(own).distinct()


def collect_conditions(fields: DataFrame) -> DataFrame:
    """``(trigger, trigger_property, value, property)`` for every condition value of every field."""
    return fields.select(
        "trigger", cells.property_name("trigger").alias("trigger_property"),
        F.explode("condition_values").alias("value"), "property",
    ).where("trigger IS NOT NULL")


def value_bounds_rules(fields: DataFrame) -> DataFrame:
    """``(property, minimum, maximum, units)`` of fields that constrain a result."""
    constrains = F.col("minimum").isNotNull() | F.col("maximum").isNotNull() | (F.size("units") > 0)
    return fields.where(constrains).select(F.col("concept").alias("property"), "minimum", "maximum", "units")


def sub_rule_sets(fields: DataFrame) -> DataFrame:
    """``(rule_set, member, role)`` of every observation composite.

    ``fields (id, parent, property, relation, class, type, condition)``, type ``object`` for
    composites. Children holding numeric results give ``bounds``; children with a relation, also those of
    plain composites below, are ``promoted``; merged groups and other children are ``field``.
    """
    sets = fields.where(F.col("class") == vocab.OBSERVATION_CLASS).select(
        F.col("id").alias("set_id"), cells.kebab("property").alias("rule_set")
    )
    members = fields.select("id", "parent", "property", "relation", "type", "condition")
    is_result = F.coalesce(F.col("relation") == vocab.RESULT_RELATION, F.lit(False))
    level1 = sets.join(members.where(~is_result | (F.col("type") == "number")), F.col("set_id") == F.col("parent"))
    merged_group = (F.col("type") == "object") & F.col("condition").isNotNull()
    role = (
        F.when(is_result, F.lit("bounds"))
        .when(merged_group, F.lit("field"))
        .when(F.col("relation").isNotNull(), F.lit("promoted"))
        .otherwise(F.lit("field"))
    )
    direct = level1.select("rule_set", F.col("property").alias("member"), role.alias("role"))
    opened = level1.where(~is_result & ~merged_group & (F.col("type") == "object")).select(
        "rule_set", F.col("id").alias("up")
    )
    level2 = opened.join(members.where("relation IS NOT NULL"), F.col("up") == F.col("parent"))
    promoted = level2.select("rule_set", F.col("property").alias("member"), F.lit("promoted").alias("role"))
    return direct.unionByName(promoted)


def rules_to_json(
    fields: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], part_size: int = 1000, **sizes
) -> DataFrame:
    """``(*by, part, n, rules)``: the rules of a group as JSON lists of at most ``part_size`` in order.

    The parts of a group together are its whole rule document, so a theme with very many rules
    is many rows and not one that fits no task.
    """
    ranked = row_numbers(fields, by, order, "_rank", **sizes)
    parts = ranked.withColumn("part", F.expr(f"(_rank - 1) div {part_size}"))
    listed = F.array_sort(F.collect_list(F.struct("_rank", F.struct(*cols).alias("rule"))))
    return parts.groupBy(*by, "part").agg(
        F.count(F.lit(1)).alias("n"), F.to_json(F.transform(listed, lambda x: x["rule"])).alias("rules")
    )
