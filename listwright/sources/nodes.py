"""Graph documents: every object with an id, found at any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import cells
from listwright.sources.storage import cut, dealt

_PERMISSIVE = {"mode": "PERMISSIVE"}


def _members(text: Column) -> Column:
    """Members of an object in written order: name, raw text, kind of value."""
    raw = F.map_entries(F.from_json(text, "map<string,string>", _PERMISSIVE))
    typed = F.map_values(F.from_json(text, "map<string,variant>", _PERMISSIVE))
    return _with_kinds(raw, typed)


def _items(text: Column) -> Column:
    """Items of a list, as members without a name."""
    values = F.from_json(text, "array<string>", _PERMISSIVE)
    raw = F.transform(values, lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    return _with_kinds(raw, F.from_json(text, "array<variant>", _PERMISSIVE))


def _with_kinds(raw: Column, typed: Column) -> Column:
    """Raw text tells kinds apart unless it begins like an object or list; only then is the typed
    form read, as a text value may begin so too."""

    def member(r: Column, kind: Column) -> Column:
        return F.struct(r["key"].alias("key"), r["value"].alias("value"), kind.alias("kind"))

    def plain(r: Column) -> Column:
        return F.when(r["value"].isNull(), F.lit("null")).otherwise(F.lit("value"))

    def kind(r: Column, t: Column) -> Column:
        def named(name: Column) -> Column:
            return (
                F.when(name.startswith("OBJECT"), F.lit("object"))
                .when(name.startswith("ARRAY"), F.lit("array"))
                .otherwise(F.lit("value"))
            )

        return F.when(_opens(r["value"]), cells.once(F.schema_of_variant(t), named)).otherwise(plain(r))

    def build(entries: Column) -> Column:
        return F.when(
            F.exists(entries, lambda r: F.coalesce(_opens(r["value"]), F.lit(False))),
            F.zip_with(entries, typed, lambda r, t: member(r, kind(r, t))),
        ).otherwise(F.transform(entries, lambda r: member(r, plain(r))))

    return cells.once(raw, build)


def _opens(value: Column) -> Column:
    return value.startswith("{") | value.startswith("[")


def _node_id(members: Column) -> Column:
    def named(name: str) -> Column:
        hit = F.filter(members, lambda m: (m["key"] == name) & (m["kind"] == "value"))
        return F.get(hit, F.lit(0))["value"]

    return F.coalesce(named("@id"), named("id"))


def node_json_read(df: DataFrame, json_col: str, pos_col: str) -> DataFrame:
    """``(id, key, value, kind, pos)`` for every member of every node with an id.

    ``pos`` is the place in a depth-first walk, as an array that sorts like the walk. One
    pass over the documents per nesting level, ending when no object or array is left.
    Documents are dealt out before they are parsed, so a small file does not become one large task.
    """
    text = F.col(json_col)
    level = dealt(df.select(pos_col, json_col), pos_col, json_col).select(
        F.array(F.col(pos_col).cast("long")).alias("pos"),
        text.alias("value"),
        F.when(F.ltrim(text).startswith("["), F.lit("array")).otherwise(F.lit("object")).alias("kind"),
    )
    is_object = F.col("kind") == "object"
    members = F.when(is_object, _members(F.col("value"))).otherwise(_items(F.col("value")))
    node_id = F.when(is_object, _node_id(F.col("members")))
    found = []
    while True:
        opened = level.withColumn("members", members).withColumn("id", node_id)
        rows = cut(
            opened.select("pos", "id", F.posexplode("members").alias("at", "m")).select(
                "id",
                "m.key",
                "m.value",
                "m.kind",
                F.concat("pos", F.array(F.col("at").cast("long"))).alias("pos"),
            )
        )
        found.append(rows.where("id IS NOT NULL AND kind <> 'null'"))
        level = rows.where("kind IN ('object', 'array')").select("pos", "value", "kind")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
