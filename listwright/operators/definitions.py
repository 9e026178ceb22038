"""Definitions as they are published: references between documents, and conditional blocks.

A reference names a document and a pointer into it. What references lead to is a graph over all documents
at once: every place that is referred to is a node, and the references inside it are its edges. Nodes that
lead back to themselves are found in that graph and stay closed; the others' texts are opened by doubling, as
in each round every text takes in what the texts it refers to have taken in so far.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import vocab
from listwright.operators.infer import transitive_closure
from listwright.operators.templates import OPENED, count_options, with_effective
from listwright.sources.storage import cut, dealt, small

# A reference and its value; inside a string the quotes would have backslashes before them.
_REF = r'(?<!\\)"\$ref"\s*:\s*"([^"\\]*)"'
# Where a pointer's numbers are places in a list.
_LISTS = ("allOf", "anyOf", "oneOf", "items")
_HERE = "\x01"  # cannot be in a JSON text


def _refs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_REF), F.lit(1))


def _name(document: Column) -> Column:
    """A document's name: the last part of its path or address."""
    return F.regexp_extract(document, "[^/]*$", 0)


def _node(ref: Column) -> Column:
    """The node that an absolute reference names; ``name#`` is the whole document."""
    pointer = F.when(ref.contains("#"), F.regexp_replace(F.substring_index(ref, "#", -1), "^/$", "")).otherwise(F.lit(""))
    return F.concat(_name(F.substring_index(ref, "#", 1)), F.lit("#"), pointer)


def _path(pointer: Column) -> Column:
    """A pointer as the path of ``get_json_object``."""
    parts = F.split(F.substring(pointer, 2, 1 << 30), "/")

    def step(part: Column, i: Column) -> Column:
        nth = part.rlike("^[0-9]+$") & F.coalesce(F.get(parts, i - 1).isin(*_LISTS), F.lit(False))
        plain = F.replace(F.replace(part, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        return F.when(nth, F.concat(F.lit("["), part, F.lit("]"))).otherwise(F.concat(F.lit("['"), plain, F.lit("']")))

    return F.when(pointer == "", F.lit("$")).otherwise(F.concat(F.lit("$"), F.array_join(F.transform(parts, step), "")))


def _absolute(defs: DataFrame, def_col: str, json_col: str) -> DataFrame:
    """``(_row, _name, _text, _given)``: a row number, the document's name, its text with all references naming
    their document, and the other columns as they were given."""
    defs = dealt(defs, def_col, json_col)
    name = _name(F.col(def_col).cast("string"))
    local = F.regexp_replace(F.col(json_col), r'(?<!\\)"\$ref"\s*:\s*"#', f'"\\$ref":"{_HERE}#')
    text = F.replace(local, F.lit(_HERE), name)
    given = F.struct(*[F.col(f"`{c}`") for c in defs.columns if c != json_col])
    return cut(defs.select(F.monotonically_increasing_id().alias("_row"), name.alias("_name"), text.alias("_text"), given.alias("_given")))


def _nodes(documents: DataFrame) -> DataFrame:
    """``(node, text, cyclic)`` of every place that is referred to; a missing one has no text."""
    asked = documents.select(F.explode(_refs(F.col("_text"))).alias("ref")).select(_node(F.col("ref")).alias("node")).distinct()
    split = asked.select("node", F.substring_index("node", "#", 1).alias("_name"), F.substring_index("node", "#", -1).alias("pointer"))
    # Of documents with one name the first by text counts; texts that nothing refers to are not sorted.
    wanted = documents.join(split.select("_name").distinct(), "_name", "left_semi")
    named = wanted.groupBy("_name").agg(F.min("_text").alias("_text"))
    found = split.join(named, "_name", "left")
    inside = F.call_function("get_json_object", F.col("_text"), _path(F.col("pointer")))
    nodes = cut(found.select("node", F.when(F.col("pointer") == "", F.col("_text")).otherwise(inside).alias("text")))
    edges = nodes.select(F.col("node").alias("src"), F.explode(_refs(F.col("text"))).alias("ref")).select(
        "src", _node(F.col("ref")).alias("dst")
    )
    cyclic = transitive_closure(edges).where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("cyclic"))
    return cut(nodes.join(cyclic, "node", "left").select("node", "text", F.coalesce("cyclic", F.lit(False)).alias("cyclic")))


def _opened(rows: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """``rows`` with every reference to one of ``nodes(node, text)`` replaced by a block that holds its
    text, and whether there was one in ``_changed``. ``key`` tells the rows apart."""
    refs = rows.select(key, F.posexplode(_refs(F.col(text))).alias("_at", "_ref")).withColumn("_to", _node(F.col("_ref")))
    known = nodes.select(F.col("node").alias("_to"), F.col("text").alias("_new"))
    part = F.coalesce(
        F.concat(F.lit(f'"{OPENED}":['), "_new", F.lit("]")), F.concat(F.lit('"$ref":"'), "_ref", F.lit('"'))
    )
    # A row's references come back together: they are parts of its text. Texts are packed well on disk and not
    # in memory, so the number of partitions is not left to their bytes.
    found = dealt(refs.join(known, "_to", "left").select(key, "_at", "_new", part.alias("_part")), key)
    parts = found.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_at", "_part"))).alias("_parts"),
        F.bool_or(F.col("_new").isNotNull()).alias("_changed"),
    )
    between = F.zip_with(
        F.split(F.col(text), _REF, -1), F.concat("_parts._part", F.array(F.lit(""))), lambda a, b: F.concat(a, b)
    )
    both = dealt(rows.drop("_changed"), key).hint("merge").join(parts, key, "left")
    whole = F.when(F.col("_changed"), F.array_join(between, "")).otherwise(F.col(text))
    return both.withColumns({text: whole, "_changed": F.coalesce("_changed", F.lit(False))}).drop("_parts")


def _open_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes that can be opened, their own references opened; about log2 of the longest chain rounds."""
    texts = cut(nodes.where("text IS NOT NULL AND NOT cyclic").select("node", "text"))
    while True:
        further = cut(_opened(texts, "node", "text", texts))
        if further.where("_changed").isEmpty():
            return texts
        texts = further.select("node", "text")


def resolve_references(defs: DataFrame, def_col: str, json_col: str) -> DataFrame:
    """``defs`` whose references are opened: in place of one stands a block with what it leads to, which the
    other operators on definitions read like a block of ``allOf`` that comes first, so a definition's own
    values count before it.

    A reference is ``document#pointer``, ``document`` or ``#pointer``; documents are found by the last part of
    ``def_col``. References without a target, into a circle or with a backslash stay as they are. Null
    texts stay null; other columns pass through, repeated rows stay.
    """
    documents = _absolute(defs, def_col, json_col)
    found = _opened(documents, "_row", "_text", _open_nodes(_nodes(documents)))
    return found.select(*[F.col("_text").alias(c) if c == json_col else F.col(f"_given.`{c}`").alias(c) for c in defs.columns])


def reference_problems(defs: DataFrame, def_col: str, json_col: str) -> DataFrame:
    """``(def, node, problem)`` of the references in each definition that stay closed: ``missing`` targets, and
    targets that lead back to themselves (``cyclic``)."""
    documents = _absolute(defs, def_col, json_col)
    used = documents.select(F.col(f"_given.`{def_col}`").alias("def"), F.explode(_refs(F.col("_text"))).alias("ref"))
    closed = _nodes(documents).where("text IS NULL OR cyclic")
    problem = F.when(F.col("text").isNull(), F.lit("missing")).otherwise(F.lit("cyclic"))
    # Never the references to every task: Spark takes them for few, by the bytes of the files they come from.
    used = used.select("def", _node(F.col("ref")).alias("node")).distinct().hint("merge")
    return used.join(small(closed), "node").select("def", "node", problem.alias("problem"))


def _condition_blocks(defs: DataFrame, def_col: str, json_col: str) -> DataFrame:
    """``(def, at, then)`` of all blocks with a condition, those inside others too; ``at`` orders them."""
    schema = f"`if` string, `then` string, `allOf` array<string>, `{OPENED}` array<string>"
    found, marks = [], F.col("text").contains('"if"')
    level = defs.select(F.col(def_col).alias("def"), F.array().cast("array<int>").alias("at"), F.col(json_col).alias("text"))
    level = level.where(marks).select("def", "at", F.from_json("text", schema).alias("d"))
    none = F.array().cast("array<string>")
    composed = F.col("d.allOf").isNotNull() | F.col(f"d.{OPENED}").isNotNull()
    while True:
        blocks = level.select(
            "def", "at", F.posexplode(F.concat(F.coalesce(F.col(f"d.{OPENED}"), none), F.coalesce("d.allOf", none))).alias("nth", "text")
        ).where(marks).select("def", F.concat("at", F.array("nth")).alias("at"), F.from_json("text", schema).alias("d"))
        blocks = cut(blocks.where(composed | F.col("d.if").isNotNull()))
        if blocks.isEmpty():
            return reduce(DataFrame.unionByName, found) if found else level.limit(0).select("def", "at", F.col("d.then").alias("then"))
        then = blocks.where("d.if IS NOT NULL AND d.then IS NOT NULL").select("def", "at", F.col("d.then").alias("then"))
        found.append(then)
        # Blocks inside the consequence come behind those beside it.
        inner = then.where(F.col("then").contains('"if"')).select(
            "def", F.concat("at", F.array(F.lit(1 << 30))).alias("at"), F.from_json("then", schema).alias("d")
        )
        level = blocks.where(composed).unionByName(inner)


def conditional_blocks(defs: DataFrame, def_col: str, json_col: str) -> DataFrame:
    """``(def, key, name, title, const, required, block_pos, type, format, n_options)``: what the conditional
    blocks of each definition say about its columns, as ``conditional_required_columns`` takes it.

    A member of a block's consequence that lists required names gives a row for each of these, described
    or not; another with members of its own gives a row for each member; a plain one gives one for itself
    (``key`` null). Empty markers, objects without content, and envelope members that carry only
    constraints give none. ``block_pos`` is one order of all rows of a definition: blocks as they
    stand, those inside a block after it, and within a block its members.
    """
    blocks = _condition_blocks(defs, def_col, json_col)
    members = blocks.select("def", "at", F.posexplode(F.from_json("then", "properties map<string,string>")["properties"]).alias("nth", "key", "text"))
    members = with_effective(members.where(F.regexp_replace("text", r"\s", "") != "{}"), "text", "e")
    has_members, named = F.size("e.properties") > 0, F.size("e.required") > 0
    bare = ~has_members & F.col("e.items").isNull()
    skipped = (bare & F.col("key").isin(*vocab.ENVELOPE_FIELDS)) | (bare & F.coalesce(F.col("e.type") == "object", F.lit(False)))
    described = lambda name: F.get(F.filter("e.properties", lambda m: m["key"] == name), F.lit(0))["value"]
    entry = lambda key, name, text, required: F.struct(key.alias("key"), name.alias("name"), text.alias("source"), F.lit(required).alias("required"))
    no_key = F.lit(None).cast("string")
    rows = (
        F.when(named, F.transform("e.required", lambda n: entry(F.col("key"), n, described(n), True)))
        .when(has_members, F.transform("e.properties", lambda m: entry(F.col("key"), m["key"], m["value"], False)))
        .otherwise(F.array(entry(no_key, F.col("key"), F.col("text"), False)))
    )
    each = members.where(~skipped).select("def", "at", "nth", F.posexplode(rows).alias("place", "r")).select("def", "at", "nth", "place", "r.*")
    known = with_effective(each, "source", "s")
    return known.select(
        "def", "key", "name", F.col("s.title").alias("title"), F.col("s.const").alias("const"), "required",
        F.concat("at", F.array(F.lit(-1), "nth", "place")).alias("block_pos"), F.col("s.type").alias("type"), F.col("s.format").alias("format"),
        F.coalesce(count_options(F.col("source")), F.lit(0)).alias("n_options"),
    )
