"""Chat formatting in a prefix tree: turns that conversations share from the start are emitted once.

A node of the tree is a turn with all turns before it, named by a chained digest. Conversations are
sorted by their digests, which is the depth-first order of the tree: each one emits the nodes that no
earlier one has. The emitted segments are one stream of tokens; a node knows where its segment begins,
the position of its first token in its conversation, and the intervals of the stream that its ancestors
take up, neighbours merged. Tokens attend to those intervals and to their own segment.

The template is ``### role: text</turn>\\n``. In texts and roles a backslash is doubled and the control
strings are written as ``\\h`` (###), ``\\t`` (</turn>) and, in roles, ``\\c`` (a colon), so that no
text can look like a mark, and reading is exact. The body of an assistant's turn is under the loss mask.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from listwright.llm.registry import query, table
from listwright.llm.tokens import PATH, encoder
from listwright.operators.ranking import sorted_numbers
from listwright.sources.storage import cut, scratch

BEGIN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
LEARNED_ROLE = "assistant"
# Conversations whose emitted tokens are summed in one window.
_STRETCH = 4096
# Tokens of the stream that are looked up by one key.
_REACH = 1024


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"\\|###|</turn>|:" if role else r"\\|###|</turn>", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part[len(BEGIN) :].partition(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


def _paths(batches):
    """Adds to each conversation the digests of its turns, each with all turns before it."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            paths = []
            for turns in part.column("turns").to_pylist():
                path, last = [], b""
                for turn in turns:
                    role, text = (turn["role"] or "").encode(), (turn["text"] or "").encode()
                    last = hashlib.blake2b(last + len(role).to_bytes(8, "big") + role + text, digest_size=16).digest()
                    path.append(last)
                paths.append(path)
            yield pa.RecordBatch.from_arrays(
                [part.column("conv_id"), part.column("turns"), pa.array(paths, pa.list_(pa.binary()))],
                ["conv_id", "turns", "path"],
            )


def _segments(tokenizer: str):
    """Ids of each node's turn, and which of them are under the loss mask."""

    def run(batches):
        encode = encoder(tokenizer).ids
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                roles = [r or "" for r in part.column("role").to_pylist()]
                texts = [escape(t or "") for t in part.column("text").to_pylist()]
                # Mark, body and end are encoded apart, so the mask falls between tokens.
                strings = [s for r, t in zip(roles, texts) for s in (BEGIN + escape(r, True) + MIDDLE, t, CLOSE)]
                raw = [s.encode() for s in strings]
                data = np.frombuffer(b"".join(raw), np.uint8)
                flat, offsets = encode(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
                first, to, end = offsets[0:-1:3], offsets[1::3], offsets[2::3]
                learned = np.array([r == LEARNED_ROLE for r in roles])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(n) for n in ("node", "parent", "depth", "rank")],
                        pa.array(offsets[3::3] - first),
                        pa.array(to - first),
                        pa.array(np.where(learned, end - first, to - first)),
                        pa.ListArray.from_arrays(pa.array(np.append(first, offsets[-1]).astype(np.int32)), pa.array(flat.astype(np.int32))),
                    ],
                    ["node", "parent", "depth", "rank", "n_tokens", "loss_from", "loss_to", "ids"],
                )

    return run


def _intervals(batches):
    """For each node that its conversation emits: its first position, and its ancestors' intervals."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 200):
            nodes, positions, lists = [], [], []
            for rank, path in zip(batch.column("rank").slice(begin, 200).to_pylist(), batch.column("path").slice(begin, 200).to_pylist()):
                position, spans = 0, []
                for step in sorted(path, key=lambda s: s["depth"]):
                    if step["owner"] == rank:
                        nodes.append(step["node"])
                        positions.append(position)
                        lists.append([{"begin": a, "end": b} for a, b in spans])
                    start, end = step["start"], step["start"] + step["n_tokens"]
                    if spans and spans[-1][1] == start:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((start, end))
                    position += step["n_tokens"]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(positions, pa.int64()), pa.array(lists, kind)], ["node", "position", "attends"]
            )


def format_tree(conversations: DataFrame, tokenizer: str = PATH) -> tuple[DataFrame, DataFrame]:
    """``(segments, leaves)`` of ``conversations(conv_id, turn, role, text)``.

    ``segments(node, parent, depth, start, n_tokens, position, attends, loss_from, loss_to, ids)`` has a
    row per distinct node: its tokens are ``start`` to ``start + n_tokens`` of the stream, have the
    positions ``position``, ``position + 1``, … and attend to the intervals ``attends`` and to their own
    segment. ``leaves(conv_id, node)`` names each conversation's last node.

    Turns are ordered by ``turn``, ties by role and text; a missing turn number comes first. Null roles
    and texts are empty. Rows without conv_id are one conversation. Other columns are ignored.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        "conv_id",
        F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    path = scratch(spark, "paths")
    schema = StructType([*whole.schema.fields, StructField("path", ArrayType(BinaryType()))])
    whole.mapInArrow(_paths, schema).write.parquet(path)
    whole = spark.read.parquet(path)
    leaves = whole.select("conv_id", F.element_at("path", -1).alias("node"))

    # Conversations with the same turns are one from here on.
    distinct = whole.groupBy(F.element_at("path", -1).alias("leaf")).agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "path")).alias("x")
    )
    ranked = sorted_numbers(
        distinct.select(F.col("x.conv_id").alias("conv_id"), F.col("x.path").alias("path")), [], ["path"], "rank", plain_rows=0
    )
    ranked = cut(ranked)
    steps = ranked.select("conv_id", "rank", "path", F.posexplode("path").alias("depth", "node"))
    parent = F.when(F.col("depth") > 0, F.get("path", F.col("depth") - 1))
    owned = steps.groupBy("node").agg(F.min(F.struct("rank", "depth", parent.alias("parent"), "conv_id")).alias("o")).select("node", "o.*")

    turns = whole.select("conv_id", F.posexplode(F.arrays_zip("path", "turns")).alias("depth", "z")).select(
        F.col("conv_id").alias("_conv"), F.col("z.path").alias("_node"), F.col("z.turns.role").alias("role"), F.col("z.turns.text").alias("text")
    )
    same = (F.col("node") == F.col("_node")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    texts = owned.join(turns, same).select("node", "parent", "depth", "rank", "role", "text")
    segments = cut(
        texts.mapInArrow(
            _segments(tokenizer),
            "node binary, parent binary, depth int, rank bigint, n_tokens bigint, loss_from bigint, loss_to bigint, ids array<int>",
        )
    )

    # Where each segment begins: sums over stretches of conversations, then within each stretch.
    sizes = segments.select("node", "depth", "rank", "n_tokens", F.floor(F.col("rank") / _STRETCH).alias("stretch"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    stretches = sizes.groupBy("stretch").agg(F.sum("n_tokens").alias("n")).select(
        "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at")
    )
    inside = Window.partitionBy("stretch").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(
        sizes.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(stretches, "stretch")
        .select("node", "n_tokens", F.col("rank").alias("owner"), (F.col("at") + F.col("within")).alias("start"))
    )
    placed = (
        steps.select("node", "rank", "depth")
        .join(starts, "node")
        .groupBy("rank")
        .agg(F.collect_list(F.struct("depth", "node", "owner", "start", "n_tokens")).alias("path"))
        .mapInArrow(_intervals, "node binary, position bigint, attends array<struct<begin:bigint,end:bigint>>")
    )
    out = segments.drop("rank", "n_tokens").join(starts.drop("owner"), "node").join(placed, "node")
    return cut(
        out.select("node", "parent", "depth", "start", "n_tokens", "position", "attends", "loss_from", "loss_to", "ids")
    ), leaves


def _read(tokenizer: str):
    def run(batches):
        decode = encoder(tokenizer).chunks.decode_bytes
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                out = []
                for parts in part.column("parts").to_pylist():
                    parts.sort(key=lambda s: s["start"])
                    formatted = decode([i for s in parts for i in s["ids"]]).decode()
                    turns = parse(formatted)
                    learned = "".join(
                        unescape(decode(s["ids"][s["loss_from"] : s["loss_to"]]).decode()) for s in parts if s["loss_to"] > s["loss_from"]
                    )
                    said = "".join(f"{role}\n{text}\n" for role, text in turns)
                    sums = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learned)]
                    out.append((len(turns), sums[0], len(learned), sums[1], len(formatted)))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), *[pa.array(c, pa.string() if k in (1, 3) else pa.int64()) for k, c in enumerate(columns)]],
                    ["node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                )

    return run


def read_back(segments: DataFrame, leaves: DataFrame, tokenizer: str = PATH) -> DataFrame:
    """What each conversation's last segment attends to, read as a conversation again.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``: counts are of code
    points; the digests are of role, newline, text, newline for each turn, and of all text under the mask.
    """
    own = F.array(F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("n_tokens")).alias("end")))
    ends = leaves.select("node").distinct().join(segments, "node")
    spans = ends.select("node", F.explode(F.concat("attends", own)).alias("s")).select("node", "s.begin", "s.end")
    reach = lambda a, b: F.explode(F.sequence(F.floor(a / _REACH), F.floor((b - 1) / _REACH)))
    wanted = spans.withColumn("at", reach(F.col("begin"), F.col("end")))
    # A segment is found by the stretch that it begins in.
    stored = segments.select(
        F.floor(F.col("start") / _REACH).alias("at"), "start", "loss_from", "loss_to", "ids"
    )
    gathered = (
        wanted.join(stored, "at")
        .where("start >= begin AND start < end")
        .groupBy("node")
        .agg(F.collect_list(F.struct("start", "loss_from", "loss_to", "ids")).alias("parts"))
        .mapInArrow(
            _read(tokenizer),
            "node binary, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
        )
    )
    return leaves.join(gathered, "node").drop("node")


@query("op1_chat_formatting")
def op1(spark, folder):
    """All conversations, and one whose texts hold the template's own control strings."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return read_back(*format_tree(given.unionByName(more)))
