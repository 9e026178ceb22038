"""Shape constraints as a rule table applied to triples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions import vocab
from listwright.sources.storage import cut, small, table_of


@dataclass(frozen=True)
class ShapeRule:
    """Every ``target_class`` member must meet ``component`` = ``value`` on ``path``."""

    target_class: str
    path: str
    component: str
    value: str


def _rules(spark, rules: Sequence[ShapeRule], component: str) -> DataFrame:
    rows = [(r.target_class, r.path, r.value) for r in rules if r.component == component]
    return table_of(spark, rows, "target_class string, path string, value string")


def _component(name: str):
    return F.lit(f"{vocab.SHACL}{name}ConstraintComponent").alias("component")


def targets_of(triples: DataFrame, rules: Sequence[ShapeRule]) -> DataFrame:
    """``(focus, target_class)`` of every member of a class some rule names."""
    named = sorted({r.target_class for r in rules})
    return (
        triples.where((F.col("predicate") == vocab.RDF_TYPE) & F.col("object").isin(*named))
        .select(F.col("subject").alias("focus"), F.col("object").alias("target_class"))
        .distinct()
    )


_OUT = ("focus", "target_class", "path", "component", "detail")


def _of_target(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Keeps rows ``(focus, target_class, …)`` whose focus is typed as the class."""
    return found.join(targets, ["focus", "target_class"], "left_semi").select(*_OUT)


def _counts(triples: DataFrame, rules: Sequence[ShapeRule]) -> DataFrame:
    """Violated count rules of every member of their class, members without values included.

    One aggregation by subject counts all rule paths at once, partly before the shuffle; no
    join, whatever the number of rules.
    """
    paths = sorted({r.path for r in rules})
    classes = sorted({r.target_class for r in rules})
    is_type = F.col("predicate") == vocab.RDF_TYPE
    per_subject = (
        triples.where(F.col("predicate").isin(vocab.RDF_TYPE, *paths))
        .groupBy(F.col("subject").alias("focus"))
        .agg(
            *[F.count_if(F.col("predicate") == p).alias(f"n{i}") for i, p in enumerate(paths)],
            *[F.bool_or(is_type & (F.col("object") == c)).alias(f"c{i}") for i, c in enumerate(classes)],
        )
    )
    checks = []
    for r in rules:
        n = F.col(f"n{paths.index(r.path)}")
        broken = n < int(r.value) if r.component == "MinCount" else n > int(r.value)
        row = F.struct(
            F.lit(r.target_class).alias("target_class"), F.lit(r.path).alias("path"), _component(r.component),
            n.cast("string").alias("detail"),
        )
        checks.append(F.when(F.col(f"c{classes.index(r.target_class)}") & broken, row))
    return per_subject.select("focus", F.inline(F.array_compact(F.array(*checks)))).select(*_OUT)


def _values(triples: DataFrame, rules: Sequence[ShapeRule], targets: DataFrame) -> DataFrame:
    """Violations a triple shows by itself: one pass for all such rules. Only violating triples
    are matched with their classes."""
    rows = [(r.target_class, r.path, r.component, r.value) for r in rules]
    table = table_of(triples.sparkSession, rows, "target_class string, path string, rule string, value string")
    rule, value = F.col("rule"), F.col("value")
    in_list = F.array_contains(F.split(value, r"\|"), F.col("lang"))
    broken = (
        F.when(rule == "NodeKind", F.col("object_kind") != value)
        .when(rule == "Datatype", ~F.col("datatype").eqNullSafe(value))
        .when(rule == "LanguageIn", ~F.coalesce(in_list, F.lit(False)))
    )
    component = F.concat(F.lit(vocab.SHACL), rule, F.lit("ConstraintComponent"))
    detail = F.when(rule == "LanguageIn", F.coalesce("lang", F.lit(""))).otherwise(F.col("object"))
    found = triples.join(table, F.col("predicate") == F.col("path")).where(broken)
    return _of_target(
        found.select(F.col("subject").alias("focus"), "target_class", "path", component.alias("component"), detail.alias("detail")), targets
    )


def _unique_lang(triples: DataFrame, rules: Sequence[ShapeRule], targets: DataFrame) -> DataFrame:
    table = _rules(triples.sparkSession, rules, "UniqueLang")
    repeated = (
        triples.where(F.col("lang").isNotNull() & F.col("predicate").isin(*{r.path for r in rules}))
        .groupBy("subject", "predicate", "lang")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    found = repeated.join(table, F.col("predicate") == F.col("path")).select(
        F.col("subject").alias("focus"), "target_class", "path", _component("UniqueLang"), F.col("lang").alias("detail")
    )
    return _of_target(found, targets)


def _classes(triples: DataFrame, rules: Sequence[ShapeRule], targets: DataFrame) -> DataFrame:
    """Each distinct value is looked up once, so a popular one is not shuffled many times."""
    table = _rules(triples.sparkSession, rules, "Class")
    linked = triples.join(table, F.col("predicate") == F.col("path")).select(
        F.col("subject").alias("focus"), "target_class", "path", "value", F.col("object").alias("detail")
    )
    wanted = sorted({r.value for r in rules})
    typed = triples.where((F.col("predicate") == vocab.RDF_TYPE) & F.col("object").isin(*wanted)).select(
        F.col("subject").alias("detail"), F.col("object").alias("value")
    )
    bad = small(linked.select("detail", "value").distinct().join(typed, ["detail", "value"], "left_anti"))
    found = linked.join(bad, ["detail", "value"], "left_semi").withColumn("component", _component("Class"))
    return _of_target(found, targets)


_COUNTED = ("MinCount", "MaxCount")
_BY_VALUE = ("NodeKind", "Datatype", "LanguageIn")
_KINDS = (*_COUNTED, *_BY_VALUE, "UniqueLang", "Class")


def check_shapes(triples: DataFrame, rules: Sequence[ShapeRule]) -> DataFrame:
    """All violations of all rules: one pass for counts, one for values, one each for languages
    and classes; passes without a rule are left out."""
    if not rules or not {r.component for r in rules} <= set(_KINDS):
        raise ValueError(f"rules must name components among {_KINDS}")

    def of(*kinds: str) -> list[ShapeRule]:
        return [r for r in rules if r.component in kinds]

    found = [_counts(triples, of(*_COUNTED))] if of(*_COUNTED) else []
    if of(*_BY_VALUE, "UniqueLang", "Class"):
        targets = targets_of(triples, rules)
        if len({r.component in _BY_VALUE or r.component for r in of(*_BY_VALUE, "UniqueLang", "Class")}) > 1:
            targets = cut(targets)
        for kinds, check in ((_BY_VALUE, _values), (("UniqueLang",), _unique_lang), (("Class",), _classes)):
            if of(*kinds):
                found.append(check(triples, of(*kinds), targets))
    return reduce(DataFrame.unionByName, found)


def _only(component: str):
    def check(triples: DataFrame, rules: Sequence[ShapeRule]) -> DataFrame:
        return check_shapes(triples, [r for r in rules if r.component == component])

    return check


# At least, at most ``value`` values.
shape_min_count, shape_max_count = _only("MinCount"), _only("MaxCount")
# Values are an ``iri`` or a ``literal``; have the datatype; have one of the languages ``a|b``.
shape_node_kind, shape_datatype, shape_language_in = _only("NodeKind"), _only("Datatype"), _only("LanguageIn")
# At most one value per language; values are typed as the class.
shape_unique_lang, shape_class = _only("UniqueLang"), _only("Class")


def shape_inverse_unique(triples: DataFrame, path: str) -> DataFrame:
    """Every value on ``path`` must have exactly one owner; gives the values that have more."""
    owners = triples.where(F.col("predicate") == path).select("subject", "object").distinct()
    return owners.groupBy("object").agg(F.count(F.lit(1)).alias("owners")).where("owners <> 1")
