"""Flat entry templates from nested definitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import cells, vocab
from listwright.sources.storage import cut, dealt, fresh

# Holds what a reference of a definition leads to; read like the first block of allOf.
OPENED = "$open"
# Levels of blocks inside blocks that are opened in one pass; deeper definitions take further rounds.
_LEVELS = 4
_DEFINITION = (
    f"`{OPENED}` array<string>, "
    "type string, title string, description string, format string, const string, enum array<string>, "
    "required array<string>, properties map<string,string>, items string, allOf array<string>, "
    "`x-ui-first` boolean, `x-ui-after` string"
)
_TEXTS = ("type", "title", "description", "format", "const", "items", "x-ui-after")


def _parsed(text: Column) -> Column:
    return F.from_json(text, _DEFINITION)


def _blocks_of(d: Column) -> Column:
    """Texts of the blocks that a parsed definition is composed of."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(d[OPENED], none), F.coalesce(d["allOf"], none))


def _is_composed(d: Column) -> Column:
    return F.coalesce(d["allOf"].isNotNull() | d[OPENED].isNotNull(), F.lit(False))


def with_effective(df: DataFrame, text: str, out: str, root: bool = False) -> DataFrame:
    """Adds a definition with its composed blocks merged in: own values first, then block by block.

    Of a member that is described more than once the last description counts and earlier ones fill its
    gaps; in a ``root`` definition its own description counts before those of its blocks.

    The result is written once, with a mark at definitions of more than ``_LEVELS`` levels of blocks; only these
    are taken up again, a round per level. The steps are columns of their own so that no step is repeated.
    """
    blocks = _blocks(df, text)
    for _ in range(_LEVELS):
        blocks = blocks.withColumn("_blocks", F.flatten(F.transform("_blocks", _opened)))
    closed = F.coalesce(F.exists("_blocks", lambda b: b["closed"]), F.lit(False))
    made = fresh(_merged(blocks.withColumn("_closed", closed), out, root))
    if not made.agg(F.bool_or("_closed")).first()[0]:
        return made.drop("_closed")
    blocks = _blocks(made.where("_closed").drop("_closed", out), text)
    while not blocks.where(closed).isEmpty():
        blocks = cut(blocks.withColumn("_blocks", F.flatten(F.transform("_blocks", _opened))))
    return made.where("NOT _closed").drop("_closed").unionByName(_merged(blocks, out, root))


def _blocks(df: DataFrame, text: str) -> DataFrame:
    """Adds the parsed definition, and as its only block so far if it is composed at all."""
    parsed = df.withColumn("_own", _parsed(F.col(text)))
    return parsed.withColumn("_blocks", F.when(_is_composed(F.col("_own")), F.array(_marked(F.col("_own")))))


def _marked(d: Column) -> Column:
    """A block and whether blocks of its own are still to be opened."""
    return F.struct(d.alias("d"), _is_composed(d).alias("closed"))


def _opened(b: Column) -> Column:
    """A block and the blocks it is composed of, own values before those of inner blocks."""
    own = F.struct(b["d"].alias("d"), F.lit(False).alias("closed"))
    blocks = F.transform(F.transform(_blocks_of(b["d"]), _parsed), _marked)
    return F.when(b["closed"], F.concat(F.array(own), blocks)).otherwise(F.array(b))


def _merged(blocks: DataFrame, out: str, root: bool) -> DataFrame:
    """``out`` from the opened ``_blocks`` of the definition ``_own``, which it replaces."""
    parsed = blocks.withColumn("_defs", F.transform("_blocks", lambda b: b["d"])).drop("_blocks")
    strings = F.array().cast("array<string>")
    entry = "array<struct<key:string,value:string>>"

    def first(name: str) -> Column:
        values = F.transform("_defs", lambda d: d[name])
        return F.get(F.array_compact(values), F.lit(0))

    entries = F.flatten(F.transform("_defs", lambda d: F.coalesce(F.map_entries(d["properties"]), F.array().cast(entry))))

    def of_name(found: Column, key: Column) -> Column:
        same = F.filter(found, lambda e: (e["key"] == key) & e["value"].startswith("{"))
        later = F.reverse(F.transform(same, lambda e: e["value"]))
        if not root:
            return later
        own = F.col("_own.properties")[key]
        return F.when(own.startswith("{"), F.concat(F.array(own), F.slice(later, 1, F.size(later) - 1))).otherwise(later)

    def member(found: Column, e: Column) -> Column:
        """A member described more than once is composed of its descriptions."""
        whole = cells.once(
            of_name(found, e["key"]),
            lambda v: F.when(F.size(v) > 1, F.concat(F.lit('{"allOf":['), F.array_join(v, ","), F.lit("]}"))).otherwise(e["value"]),
        )
        return F.struct(e["key"].alias("key"), whole.alias("value"))

    def first_of_name(found: Column) -> Column:
        names = F.transform(found, lambda e: e["key"])
        firsts = cells.once(names, lambda n: F.filter(found, lambda e, i: F.array_position(n, e["key"]) == i + 1))
        return F.transform(firsts, lambda e: member(found, e))

    unique = cells.once(entries, first_of_name)
    required = F.array_distinct(F.flatten(F.transform("_defs", lambda d: F.coalesce(d["required"], strings))))
    empty = F.array().cast(entry)
    merged = F.struct(
        *[first(n).alias(n) for n in _TEXTS], first("x-ui-first").alias("x-ui-first"), unique.alias("properties"), required.alias("required")
    )
    alone = F.struct(
        *[F.col("_own")[n].alias(n) for n in (*_TEXTS, "x-ui-first")],
        F.coalesce(F.map_entries("_own.properties"), empty).alias("properties"),
        F.array_distinct(F.coalesce("_own.required", strings)).alias("required"),
    )
    return parsed.withColumn(out, F.when(_is_composed(F.col("_own")), merged).otherwise(alone)).drop("_own", "_defs")


def _is_leaf_type(kind: Column) -> Column:
    listed = F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
    return F.forall(listed, lambda t: t.isin("string", "number", "integer", "boolean", "null"))


def flatten_schema_paths(defs: DataFrame, def_col: str, json_col: str, max_depth: int | None = None) -> DataFrame:
    """``(def, path, key, type, title, format, const, required, parent_array, pos)``, one row per leaf.

    Objects are opened, lists of objects too (their leaves carry the list's path); null and
    untyped members are skipped. One pass per nesting level over all definitions at once.
    """
    start = dealt(defs.select(F.col(def_col).alias("def"), F.col(json_col).alias("json")), "def", "json")
    level = with_effective(start, "json", "e", root=True).select(
        "def", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent_array"),
        F.array().cast("array<int>").alias("pos"), "e",
    )
    is_object = (F.size("e.properties") > 0) & ~_is_leaf_type(F.col("e.type"))
    leaves, depth = [], 0
    while True:
        named = level.select(
            "def", "path", "parent_array", "pos", "e.required", F.posexplode("e.properties").alias("at", "m")
        ).select(
            "def", F.concat("path", F.lit("/"), "m.key").alias("path"), F.col("m.key").alias("key"),
            F.array_contains("required", F.col("m.key")).alias("is_required"), "parent_array",
            F.concat("pos", F.array("at")).alias("pos"), F.col("m.value").alias("source"),
        )
        members = with_effective(named, "source", "e").where("e.type IS NOT NULL AND e.type <> 'null'")
        with_items = ~is_object & F.col("e.items").isNotNull()
        # Only members that have items are parsed a level further.
        lists = with_effective(members.where(with_items).withColumn("_items", F.col("e.items")), "_items", "i").drop("_items")
        opens = F.size("i.properties") > 0
        plain = members.where(~is_object & ~with_items).unionByName(lists.where(~opens).drop("i"))
        leaves.append(
            plain.select(
                "def", "path", "key", F.col("e.type").alias("type"), F.coalesce("e.title", "key").alias("title"),
                F.col("e.description").alias("description"), F.col("e.format").alias("format"),
                F.col("e.const").alias("const"), F.coalesce("is_required", F.lit(False)).alias("required"),
                "parent_array", "pos", F.coalesce("e.x-ui-first", F.lit(False)).alias("ui_first"),
                F.col("e.x-ui-after").alias("ui_after"), "source",
            )
        )
        depth += 1
        level = members.where(is_object).select("def", "path", "parent_array", "pos", "e").unionByName(
            lists.where(opens).select("def", "path", F.col("path").alias("parent_array"), "pos", F.col("i").alias("e"))
        )
        if (max_depth is not None and depth >= max_depth) or level.isEmpty():
            return reduce(DataFrame.unionByName, leaves)


def merge_definitions(
    base: DataFrame, override: DataFrame, precedence: str = "override", required: str = "union"
) -> DataFrame:
    """``(def, path, key, value)`` rows of two definitions merged.

    One side wins per ``(path, key)`` and the other fills gaps. Names of required members
    (``key = 'required'``, one row per name) are united, or with ``inherit`` taken from the base
    only where the override names none.
    """
    on = ["def", "path", "key"]
    plain = F.col("key") != "required"
    b = base.where(plain).withColumnRenamed("value", "_b")
    o = override.where(plain).withColumnRenamed("value", "_o")
    order = ("_o", "_b") if precedence == "override" else ("_b", "_o")
    merged = b.join(o, on, "full").select(*on, F.coalesce(*order).alias("value"))
    base_names, own_names = base.where(~plain), override.where(~plain)
    if required == "inherit":
        base_names = base_names.join(own_names.select("def", "path").distinct(), ["def", "path"], "left_anti")
    names = base_names.select(*on, "value").unionByName(own_names.select(*on, "value")).distinct()
    return merged.unionByName(names)


def conditional_required_columns(columns: DataFrame, conditions: DataFrame, with_place: bool = False) -> DataFrame:
    """Columns after the conditional blocks.

    ``columns (def, path, title, ui_type, required, readonly_value)``, ``conditions (def, key,
    name, title, const, required)`` and, if they are known, ``block_pos`` (anything that orders),
    ``type``, ``format``, ``n_options``: a block on composite ``key`` (null for a plain member) that names member ``name``. Blocks count in
    the order of ``block_pos``. A named column becomes required, or read-only with the first value that
    a block fixes without requiring it; a missing one is added as its first block describes it. Bare
    markers (no name) and envelope members that carry only constraints are skipped. ``with_place`` adds
    the place of the first block that names a column.
    """
    for name, kind in (("block_pos", "long"), ("type", "string"), ("format", "string"), ("n_options", "int")):
        if name not in conditions.columns:
            conditions = conditions.withColumn(name, F.lit(None).cast(kind))
    envelope = F.col("key").isNull() & F.col("name").isin(*vocab.ENVELOPE_FIELDS)
    blocks = conditions.where(F.col("name").isNotNull() & ~envelope).select(
        "def",
        F.concat(F.coalesce(F.concat(F.lit("/"), "key"), F.lit("")), F.lit("/"), "name").alias("path"),
        "name", "title", "const", F.coalesce("required", F.lit(False)).alias("required"), "type", "format", "n_options", "block_pos",
        # Places should be unique. Blocks of one place, or without any, keep one fixed order: those that only
        # require come first, and then all that they say decides.
        F.struct("block_pos", F.col("const").isNotNull(), "const", "title", "type", "format", "required").alias("at"),
    )
    fixes = F.col("const").isNotNull() & ~F.col("required")
    per_path = blocks.groupBy("def", "path").agg(
        F.min_by(F.struct("name", "title", "const", "type", "format", "n_options"), "at").alias("_new"),
        F.min_by(F.when(fixes, F.col("const")), F.when(fixes, F.col("at"))).alias("_const"),
        F.bool_or("required").alias("_required"),
        F.min("block_pos").alias("block_pos"),
    )
    added = F.col("ui_type").isNull()
    value = F.coalesce("readonly_value", F.when(added, F.col("_new.const")), "_const")
    set_here = F.col("readonly_value").isNull() & value.isNotNull()
    described = cells.map_entry_type(F.lit(None), F.coalesce("_new.n_options", F.lit(0)), F.col("_new.type"), F.col("_new.format"))
    return columns.join(per_path, ["def", "path"], "full").select(
        "def",
        "path",
        F.coalesce("title", "_new.title", "_new.name").alias("title"),
        F.when(set_here, F.lit("readonly")).when(added, described).otherwise(F.col("ui_type")).alias("ui_type"),
        (F.coalesce("required", F.lit(False)) | F.coalesce("_required", F.lit(False))).alias("required"),
        value.alias("readonly_value"),
        *(["block_pos"] if with_place else []),
    )


def enum_of(text: Column, depth: int) -> Column:
    """First list of allowed values: own; else, block by block, the block's or one of its own blocks';
    else those of the blocks' members, one after the other, found in the same way to ``depth`` levels."""
    return F.when(text.contains('"enum"'), _options(_parsed(text), depth))


def count_options(text: Column) -> Column:
    """How many values a definition allows, itself or in its blocks; null if it names none."""
    return F.nullif(F.size(F.coalesce(enum_of(text, 0), F.array().cast("array<string>"))), F.lit(0))


def _member_levels(df: DataFrame, text: str) -> int:
    """How many levels of blocks' members have to be opened to reach all allowed values."""
    level, depth = df.select(F.col(text).alias("text")), 0
    while True:
        composed = F.col("text").contains('"enum"') & F.col("text").rlike(r'"(allOf|\$open)"')
        blocks = level.where(composed).select(_parsed(F.col("text")).alias("d")).where("d.enum IS NULL").select(
            F.explode(_blocks_of(F.col("d"))).alias("block")
        )
        level = cut(blocks.select(F.explode(_parsed(F.col("block"))["properties"]).alias("key", "text")).select("text").distinct())
        if level.isEmpty():
            return depth
        depth += 1


def _options(parsed: Column, depth: int) -> Column:
    """``depth`` levels of members are opened."""
    none = F.array().cast("array<string>")

    def blocks_of(d: Column) -> Column:
        return F.transform(_blocks_of(d), _parsed)

    def first(lists: Column) -> Column:
        return F.get(F.array_compact(lists), F.lit(0))

    def of_block(b: Column) -> Column:
        return F.coalesce(b["enum"], first(F.transform(blocks_of(b), lambda n: n["enum"])))

    def of_members(b: Column) -> Column:
        members = F.coalesce(F.map_values(b["properties"]), none)
        return F.flatten(F.transform(members, lambda m: F.coalesce(_options_of_member(m, depth), none)))

    def all_of(blocks: Column) -> Column:
        return F.coalesce(first(F.transform(blocks, of_block)), F.flatten(F.transform(blocks, of_members)))

    return cells.once(parsed, lambda d: F.coalesce(d["enum"], cells.once(blocks_of(d), all_of)))


def _options_of_member(text: Column, depth: int) -> Column:
    if depth:
        return _options(_parsed(text), depth - 1)
    return _parsed(text)["enum"]


def collect_enum_options(defs: DataFrame, def_col: str, json_col: str) -> DataFrame:
    """``(def, pos, option)`` of every definition that offers a choice."""
    return defs.select(F.col(def_col).alias("def"), F.posexplode(enum_of(F.col(json_col), _member_levels(defs, json_col))).alias("pos", "option"))


def template_columns(leaves: DataFrame) -> DataFrame:
    """Leaves -> template columns with entry type and read-only value."""
    options = enum_of(F.col("source"), _member_levels(leaves, "source"))
    # A list of types counts as a number when it names one.
    many = F.when(F.col("type").contains("["), F.from_json("type", "array<string>"))
    kind = F.when(F.array_contains(many, "number"), F.lit("number")).when(
        F.array_contains(many, "boolean"), F.lit("boolean")
    ).otherwise(F.col("type"))
    return leaves.select(
        "def", "path", "title", "description",
        cells.map_entry_type(
            F.col("const"), F.size(F.coalesce(options, F.array().cast("array<string>"))), kind, F.col("format")
        ).alias("ui_type"),
        "required", F.col("const").alias("readonly_value"), "parent_array", "pos", "ui_first", "ui_after",
    )


def dedupe_most_complete(df: DataFrame, by: Sequence[str], attrs: Sequence[str], pos: str) -> DataFrame:
    """Per key the row with most filled attributes, the first of equals."""
    filled = reduce(lambda a, b: a + b, [F.col(a).isNotNull().cast("int") for a in attrs])
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(filled, -F.col(pos)))
    return df.groupBy(*by).agg(best.alias("_r")).select(*by, "_r.*")


def theme_group_columns(columns: DataFrame) -> DataFrame:
    """``(theme, sheet, parent_path, path, pos)``: main sheet, or one per top-level list.

    ``columns (theme, path, title, parent_array, pos)``. A list's sheet is named by the column at
    its path, else by its key.
    """
    segments = F.filter(F.split("parent_array", "/"), lambda s: s != "")
    keyed = columns.withColumn("top", F.get(segments, F.lit(0)))
    titles = columns.groupBy("theme", cells.tail(F.col("path")).alias("top")).agg(
        F.min_by("title", "pos").alias("_title")
    )
    named = keyed.hint("merge").join(titles, ["theme", "top"], "left")
    sheet = F.when(F.col("top").isNull(), F.col("theme")).otherwise(
        F.coalesce(F.nullif("_title", F.lit("")), "top")
    )
    return named.select(
        "theme", cells.sanitize_name(sheet).alias("sheet"),
        F.when(F.col("top").isNotNull(), F.concat(F.lit("/"), "top")).alias("parent_path"), "path", "pos",
    )
