"""Validation of observations against derived rules.

Rule tables go through ``small``: held by every task while they have few rows, joined by
shuffle beyond that. The checks are row by row, so they take batch and streaming observations
alike, and observations are never shuffled for a small rule table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import cells, vocab
from listwright.sources.storage import small, small_or_none


def _violation(check: str, name: Column | str, detail: Column) -> Column:
    where = F.lit(name) if isinstance(name, str) else name
    return F.struct(F.lit(check).alias("check"), where.alias("field"), detail.cast("string").alias("detail"))


def _exploded(obs: DataFrame, id_col: str, checks: Sequence[Column]) -> DataFrame:
    return _opened(obs.withColumn("_violations", F.array_compact(F.array(*checks))), id_col)


def _opened(checked: DataFrame, id_col: str) -> DataFrame:
    """One row per violation. The outer form keeps Spark from testing the array, and so running all
    checks, a second time in a filter below."""
    return (
        checked.select(F.col(id_col), F.explode_outer("_violations").alias("v"))
        .where("v IS NOT NULL")
        .select(id_col, "v.check", "v.field", "v.detail")
    )


def _missing(required: Sequence[str]) -> list[Column]:
    return [
        F.when(F.col(name).isNull(), _violation("required", name.rsplit(".", 1)[-1], F.lit("missing")))
        for name in required
    ]


ENVELOPE = vocab.ENVELOPE_REQUIRED + tuple(f"hasResult.{n}" for n in vocab.RESULT_REQUIRED)


def validate_required(obs: DataFrame, id_col: str, required: Sequence[str] = ENVELOPE) -> DataFrame:
    """Envelope and result members that are absent."""
    return _exploded(obs, id_col, _missing(required))


def validate_enum(obs: DataFrame, id_col: str, col: str, options: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Values that are not among the options ``(*by, value)`` of their theme. A theme without options
    asks for nothing, as an empty list of options is no list."""
    keys = [F.col(k).alias(f"_{k}") for k in by]
    allowed = small_or_none(options.select(*keys, F.col("value").alias("_value")).distinct())
    given = obs.where(F.col(col).isNotNull())
    if allowed is None:
        return _exploded(given.limit(0), id_col, [_violation("enum", col, F.col(col))])
    same = [F.col(k) == F.col(f"_{k}") for k in by]
    if by:
        given = given.join(small(options.select(*keys).distinct()), same, "left_semi")
    hit = given.join(allowed, [F.col(col) == F.col("_value"), *same], "left_anti")
    return _exploded(hit, id_col, [_violation("enum", col, F.col(col))])


def validate_bounds(obs: DataFrame, id_col: str, rules: DataFrame) -> DataFrame:
    """Numeric results outside ``rules (property, minimum, maximum)`` of their property."""
    table = small(rules.select("property", F.col("minimum").cast("double"), F.col("maximum").cast("double")))
    value = F.col("hasResult.numericValue")
    joined = obs.join(table, F.col("observedProperty") == F.col("property"))
    return _exploded(
        joined,
        id_col,
        [
            F.when(value < F.col("minimum"), _violation("minimum", "numericValue", value)),
            F.when(value > F.col("maximum"), _violation("maximum", "numericValue", value)),
        ],
    )


def validate_unit(obs: DataFrame, id_col: str, rules: DataFrame) -> DataFrame:
    """Units that are not among ``rules (property, unit)``; properties without units are free."""
    unit = F.col("hasResult.hasUnit")
    bound = small(rules.select(F.col("property").alias("_bound")).distinct())
    allowed = small(rules.select(F.col("property").alias("_property"), F.col("unit").alias("_unit")).distinct())
    joined = (
        obs.where(unit.isNotNull())
        .join(bound, F.col("observedProperty") == F.col("_bound"))
        .join(allowed, (F.col("observedProperty") == F.col("_property")) & (unit == F.col("_unit")), "left")
        .where("_unit IS NULL")
    )
    return _exploded(joined, id_col, [_violation("unit", "hasUnit", unit)])


def type_mismatch(value: Column, expected: Column) -> Column:
    """True where a text value does not have the declared rule type."""
    number = cells.strip(value).try_cast("double").isNotNull()
    boolean = value.isin("true", "false")
    return value.isNotNull() & (
        F.when(expected == "number", ~number).when(expected == "boolean", ~boolean).otherwise(F.lit(False))
    )


def validate_type(obs: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """Text members whose value does not have the declared type; ``fields`` is name -> type."""
    return _exploded(
        obs,
        id_col,
        [
            F.when(type_mismatch(F.col(n), F.lit(t)), _violation("type", n, F.col(n)))
            for n, t in fields.items()
        ],
    )


def validate_min_items(obs: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Required repeatable members (arrays) without an item."""
    return _exploded(
        obs,
        id_col,
        [
            F.when(F.coalesce(F.size(c), F.lit(0)) < 1, _violation("minItems", c, F.lit("0")))
            for c in cols
        ],
    )


def validate_min_item_rows(parents: DataFrame, id_col: str, items: DataFrame, field_name: str) -> DataFrame:
    """The same for items kept as rows: parents no item row refers to."""
    empty = parents.select(id_col).join(items.select(id_col), id_col, "left_anti")
    return _exploded(empty, id_col, [_violation("minItems", field_name, F.lit("0"))])


@dataclass(frozen=True)
class ConditionalRule:
    """Where ``trigger`` has ``value``, ``field`` must be filled."""

    trigger: str
    value: str
    field: str


def _conditional(rules: Sequence[ConditionalRule], absent_trigger: str) -> list[Column]:
    out = []
    for r in rules:
        trigger = F.col(r.trigger).cast("string")
        fires = F.coalesce(trigger == r.value, F.lit(absent_trigger == "apply"))
        out.append(
            F.when(
                fires & F.col(r.field).isNull(),
                _violation("conditional", r.field, F.concat(F.lit(f"{r.trigger}={r.value}"))),
            )
        )
    return out


def validate_conditional_required(
    obs: DataFrame, id_col: str, rules: Sequence[ConditionalRule], absent_trigger: str = "skip"
) -> DataFrame:
    """Members missing where a trigger value requires them.

    With ``apply`` an absent trigger counts as met, as in a plain schema test of an absent member.
    """
    return _exploded(obs, id_col, _conditional(rules, absent_trigger))


@dataclass(frozen=True)
class RuleSet:
    """Everything one theme asks of an observation."""

    required: Sequence[str] = ENVELOPE
    options: DataFrame | None = None
    bounds: DataFrame | None = None
    units: DataFrame | None = None
    types: dict[str, str] = field(default_factory=dict)
    min_items: Sequence[str] = ()
    conditional: Sequence[ConditionalRule] = ()
    absent_trigger: str = "skip"


def _checked(obs: DataFrame, rules: RuleSet) -> DataFrame:
    """Observations with the array of their violations, in one pass over them."""
    checks = _missing(rules.required)
    prop, unit, value = F.col("observedProperty"), F.col("hasResult.hasUnit"), F.col("hasResult.numericValue")
    offered = None if rules.options is None else small_or_none(rules.options.select(F.col("value").alias("_option")).distinct())
    if offered is not None:  # an empty list of options asks for nothing
        obs = obs.join(offered.withColumn("_in", F.lit(True)), prop == F.col("_option"), "left")
        checks.append(F.when(prop.isNotNull() & F.col("_in").isNull(), _violation("enum", "observedProperty", prop)))
    if rules.bounds is not None:
        table = small(
            rules.bounds.select(
                F.col("property").alias("_bp"), F.col("minimum").cast("double").alias("_min"),
                F.col("maximum").cast("double").alias("_max"),
            )
        )
        obs = obs.join(table, prop == F.col("_bp"), "left")
        checks.append(F.when(value < F.col("_min"), _violation("minimum", "numericValue", value)))
        checks.append(F.when(value > F.col("_max"), _violation("maximum", "numericValue", value)))
    if rules.units is not None:
        bound = small(rules.units.select(F.col("property").alias("_up")).distinct())
        pairs = small(rules.units.select(F.col("property").alias("_uq"), F.col("unit").alias("_unit")).distinct())
        obs = obs.join(bound, prop == F.col("_up"), "left").join(
            pairs, (prop == F.col("_uq")) & (unit == F.col("_unit")), "left"
        )
        wrong = F.col("_up").isNotNull() & unit.isNotNull() & F.col("_unit").isNull()
        checks.append(F.when(wrong, _violation("unit", "hasUnit", unit)))
    for n, t in rules.types.items():
        checks.append(F.when(type_mismatch(F.col(n), F.lit(t)), _violation("type", n, F.col(n))))
    for c in rules.min_items:
        checks.append(F.when(F.coalesce(F.size(c), F.lit(0)) < 1, _violation("minItems", c, F.lit("0"))))
    checks += _conditional(rules.conditional, rules.absent_trigger)
    return obs.withColumn("_violations", F.array_compact(F.array(*checks)))


def validate_observations(obs: DataFrame, id_col: str, rules: RuleSet) -> DataFrame:
    """One row per violation."""
    return _opened(_checked(obs, rules), id_col)


def observation_verdicts(obs: DataFrame, id_col: str, rules: RuleSet) -> DataFrame:
    """One row per observation: how many violations, and whether it is valid."""
    n = F.size("_violations").cast("bigint")
    return _checked(obs, rules).select(id_col, n.alias("violations"), (n == 0).alias("valid"))


def field_visibility(values: DataFrame, submissions: DataFrame, fields: DataFrame) -> DataFrame:
    """``(submission, field, visible)`` for every field of the scheme a submission is at.

    ``values (submission, field, value)`` are current values, ``submissions (submission, scheme)``,
    ``fields (scheme, field, trigger, condition_values)``. A field without condition shows; others
    show when any instance of the trigger has one of the values, or for ``NaN`` when the trigger
    itself is empty. Instances are fields whose name starts with the trigger's (``#n`` removed).
    """
    asked = fields.where("trigger IS NOT NULL AND size(condition_values) > 0").select(
        "scheme", "field", "trigger", F.regexp_replace("trigger", r"#[0-9]+$", "").alias("base"),
        F.explode("condition_values").alias("expected"),
    )
    lengths = sorted(r["n"] for r in asked.select(F.length("base").alias("n")).distinct().collect())
    cuts = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("field")),
        lambda n: F.substring(F.col("field"), F.lit(1), n),
    )
    triggers = small(asked.select("base").distinct())
    given = (
        values.where(F.coalesce("value", F.lit("")) != "")
        .select("submission", F.col("field").alias("given"), "value", F.explode(cuts).alias("base"))
        .join(triggers, "base")
    )
    at = values.select("submission").distinct().join(submissions, "submission")
    is_nan = F.col("expected") == "NaN"
    meets = cells.value_matches("value", F.lower(cells.strip("expected")))
    hits = (
        given.join(submissions, "submission")
        .join(small(asked), ["scheme", "base"])
        .groupBy("submission", "field")
        .agg(
            F.bool_or(~is_nan & meets).alias("hit"),
            F.bool_or(is_nan & (F.col("given") == F.col("trigger"))).alias("nan_given"),
        )
    )
    has_nan = F.coalesce(F.array_contains("condition_values", "NaN"), F.lit(False))
    free = F.col("trigger").isNull() | (F.coalesce(F.size("condition_values"), F.lit(0)) < 1)
    table = small(fields.select("scheme", "field", free.alias("free"), has_nan.alias("has_nan")))
    asked_of = at.join(table, "scheme").join(hits, ["submission", "field"], "left")
    visible = (
        F.col("free")
        | F.coalesce("hit", F.lit(False))
        | (F.col("has_nan") & ~F.coalesce("nan_given", F.lit(False)))
    )
    return asked_of.select("submission", "field", visible.alias("visible"))
