"""Validation of observations of all themes at once, against rules kept as tables.

Every rule table has a ``theme`` column. What a theme asks of members (presence, type, items,
conditions) is folded into one row per theme, as long as the theme has fields, and meets its
observations in one join; bounds and units are joined by theme and property, options by theme, member
and value. Tables counted to be small are held by every task, so observations are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from listwright.operators.observe import _opened, type_mismatch
from listwright.sources.storage import small


@dataclass(frozen=True)
class ThemeTables:
    """Rules of all themes; names are those of the observations' members."""

    required: DataFrame  # theme, property
    types: DataFrame  # theme, property, type
    items: DataFrame  # theme, property
    options: DataFrame  # theme, property, value
    bounds: DataFrame  # theme, property, minimum, maximum
    units: DataFrame  # theme, property, unit
    conditional: DataFrame  # theme, trigger, value, property


def _violation(check: str, name: Column, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), name.alias("field"), detail.cast("string").alias("detail"))


def _members(obs: DataFrame, skip: tuple[str, ...]) -> tuple[Column, Column]:
    """Maps from a member's name to its text (``""`` for a list or record that is there), and from
    a list member's name to its items as text. Members of records count under their own names."""
    texts, lists = [], []
    for f in obs.schema.fields:
        if f.name in skip:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            texts += [F.lit(f.name), F.when(F.size(c) > 0, F.lit(""))]
            lists += [F.lit(f.name), c.cast("array<string>")]
        elif isinstance(f.dataType, StructType):
            texts += [F.lit(f.name), F.when(c.isNotNull(), F.lit(""))]
            for inner in f.dataType.names:
                texts += [F.lit(inner), c[inner].cast("string")]
        else:
            texts += [F.lit(f.name), c.cast("string")]
    empty = F.create_map().cast("map<string,array<string>>")
    return F.create_map(*texts), F.create_map(*lists) if lists else empty


def _rows_per_theme(tables: ThemeTables) -> DataFrame:
    """``(theme, required, types, items, conditional)``: a theme's rules of members in one row."""
    none = F.lit(None).cast("string")

    def tagged(df: DataFrame, kind: str, a: str, b: str | None = None, c: str | None = None) -> DataFrame:
        other = [F.col(x).cast("string") if x else none for x in (b, c)]
        return df.select("theme", F.lit(kind).alias("kind"), F.col(a).alias("a"), other[0].alias("b"), other[1].alias("c"))

    rows = (
        tagged(tables.required, "required", "property")
        .unionByName(tagged(tables.types, "types", "property", "type"))
        .unionByName(tagged(tables.items, "items", "property"))
        .unionByName(tagged(tables.conditional, "conditional", "property", "trigger", "value"))
    )
    named = F.struct("a", "b", "c")
    return rows.groupBy(F.col("theme").alias("_theme")).agg(
        *[F.collect_set(F.when(F.col("kind") == k, named)).alias(f"_{k}") for k in ("required", "types", "items", "conditional")]
    )


def _checked(obs: DataFrame, id_col: str, theme_col: str, tables: ThemeTables, absent_trigger: str) -> DataFrame:
    """Observations with the violations of all rules but the options."""
    texts, lists = _members(obs, (id_col, theme_col))
    prop, value, unit = F.col("observedProperty"), F.col("hasResult.numericValue"), F.col("hasResult.hasUnit")
    theme = F.col(theme_col)
    bounds = small(tables.bounds.select(
        F.col("theme").alias("_bt"), F.col("property").alias("_bp"), F.col("minimum").cast("double").alias("_min"), F.col("maximum").cast("double").alias("_max"),
    ))
    units = small(tables.units.groupBy(F.col("theme").alias("_ut"), F.col("property").alias("_up")).agg(F.collect_set("unit").alias("_units")))
    joined = (
        obs.withColumn("_texts", texts).withColumn("_lists", lists)
        .join(small(_rows_per_theme(tables)), theme == F.col("_theme"), "left")
        .join(bounds, (theme == F.col("_bt")) & (prop == F.col("_bp")), "left")
        .join(units, (theme == F.col("_ut")) & (prop == F.col("_up")), "left")
    )

    def text_of(name: Column) -> Column:
        return F.try_element_at(F.col("_texts"), name)

    def each(column: str, check) -> Column:
        return F.coalesce(F.transform(column, check), F.array().cast(_KIND))

    def fires(r: Column) -> Column:
        return F.coalesce(text_of(r["b"]) == r["c"], F.lit(absent_trigger == "apply"))

    found = F.concat(
        each("_required", lambda r: F.when(text_of(r["a"]).isNull(), _violation("required", r["a"], F.lit("missing")))),
        each("_types", lambda r: F.when(type_mismatch(text_of(r["a"]), r["b"]), _violation("type", r["a"], text_of(r["a"])))),
        each("_items", lambda r: F.when(
            F.coalesce(F.size(F.try_element_at(F.col("_lists"), r["a"])), F.lit(0)) < 1, _violation("minItems", r["a"], F.lit("0")))),
        each("_conditional", lambda r: F.when(
            fires(r) & text_of(r["a"]).isNull(), _violation("conditional", r["a"], F.concat(r["b"], F.lit("="), r["c"])))),
        F.array(
            F.when(value < F.col("_min"), _violation("minimum", F.lit("numericValue"), value)),
            F.when(value > F.col("_max"), _violation("maximum", F.lit("numericValue"), value)),
            F.when(~F.array_contains("_units", unit), _violation("unit", F.lit("hasUnit"), unit)),
        ),
    )
    return joined.withColumn("_violations", F.array_compact(found))


_KIND = "array<struct<check:string,field:string,detail:string>>"


def _options(obs: DataFrame, id_col: str, theme_col: str, options: DataFrame) -> DataFrame:
    """Values of members that are not among their theme's options, each item of a list by itself."""
    texts, lists = _members(obs, (id_col, theme_col))
    single = F.transform(F.map_entries(F.map_filter(texts, lambda k, v: v.isNotNull() & (v != ""))), lambda e: F.struct(e["key"], e["value"]))
    many = F.flatten(F.transform(F.map_entries(lists), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<string>")), lambda v: F.struct(e["key"], v.alias("value")))))
    given = obs.select(F.col(id_col), F.col(theme_col).alias("_theme"), F.inline(F.concat(single, many)).alias("field", "value"))
    asked = small(options.select(F.col("theme").alias("_theme"), F.col("property").alias("field")).distinct())
    allowed = small(options.select(F.col("theme").alias("_theme"), F.col("property").alias("field"), "value").distinct()).withColumn("_ok", F.lit(True))
    wrong = given.where("value IS NOT NULL").join(asked, ["_theme", "field"]).join(allowed, ["_theme", "field", "value"], "left").where("_ok IS NULL")
    return wrong.select(id_col, F.lit("enum").alias("check"), "field", F.col("value").alias("detail"))


def validate_by_theme(
    obs: DataFrame, id_col: str, theme_col: str, tables: ThemeTables, absent_trigger: str = "skip"
) -> DataFrame:
    """``(id, check, field, detail)``: one row per violation of the rules of the observation's theme.

    Observations without theme, or of one without rules, break none.
    """
    return _opened(_checked(obs, id_col, theme_col, tables, absent_trigger), id_col).unionByName(
        _options(obs, id_col, theme_col, tables.options)
    )


def verdicts_by_theme(
    obs: DataFrame, id_col: str, theme_col: str, tables: ThemeTables, absent_trigger: str = "skip"
) -> DataFrame:
    """``(id, theme, violations, valid)`` of every observation."""
    counts = validate_by_theme(obs, id_col, theme_col, tables, absent_trigger).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return obs.select(id_col, theme_col).join(counts, id_col, "left").select(id_col, theme_col, n.alias("violations"), (n == 0).alias("valid"))
