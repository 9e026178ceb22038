"""CSV ingest: many files with differing headers, shape check and repair."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.functions import cells
from listwright.sources.storage import table_of


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _plain_path(c):
    """A file's path as written: no scheme, no URL encoding."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^[A-Za-z0-9+.-]+:/*", "/")


def _given_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(_path, _source)``: the given paths in full, and the names rows are tagged with."""
    jvm = spark.sparkContext._jvm
    rows = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        rows.append((re.sub("^[A-Za-z0-9+.-]+:/*", "/", files.makeQualified(path).toString()), _name(p)))
    return table_of(spark, rows, "_path string, _source string")


def _parent(c):
    return F.regexp_replace(c, "/[^/]*$", "")


# Files opened at once to look at their first lines.
_OPENED = 16


def _first_line(spark: SparkSession, path: str) -> str | None:
    """First line of a file, or of the first part by name in a folder that has one. No more than the file's
    beginning is read, by the file system that also Spark reads it with, unpacked if need be."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    given = jvm.org.apache.hadoop.fs.Path(path)
    files = given.getFileSystem(conf)
    parts = [given]
    if files.getFileStatus(given).isDirectory():
        inside = [s.getPath() for s in files.listStatus(given) if s.isFile()]
        parts = sorted((p for p in inside if p.getName()[0] not in "._"), key=lambda p: p.toString())
    for part in parts:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(part)
        stream = files.open(part)
        try:
            text = jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
            line = jvm.java.io.BufferedReader(text).readLine()
        finally:
            stream.close()
        if line is not None:
            return line
    return None


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """First line of every given path, which may be a file or a folder of parts; no Spark job and no more
    bytes for long files than for short ones. Empty files have none."""
    with ThreadPoolExecutor(_OPENED) as pool:
        found = pool.map(lambda p: _first_line(spark, p), paths)
        return {p: line for p, line in zip(paths, found) if line is not None}


def csv_union_with_source(
    spark: SparkSession, paths: Sequence[str], multi_line: bool = False
) -> DataFrame:
    """All rows of all files as text columns, empty cells null, tagged with ``__source``."""
    groups = defaultdict(list)
    given = _given_paths(spark, paths)
    for path, header in _headers(spark, paths).items():
        groups[header].append(path)
    frames = []
    for same_header in groups.values():
        raw = (
            spark.read.option("header", True)
            .option("escape", '"')
            .option("multiLine", multi_line)
            .csv(same_header)
        )
        cols = [F.nullif(cells.strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns]
        file = _plain_path(F.col("_metadata.file_path"))
        tagged = raw.select(*cols, file.alias("_path"), _parent(file).alias("_folder"))
        # A row's file is a given path, or lies in one.
        name = F.coalesce("_source", "_above", F.lit("unknown")).alias("__source")
        above = given.select(F.col("_path").alias("_folder"), F.col("_source").alias("_above"))
        tagged = tagged.join(given, "_path", "left").join(above, "_folder", "left")
        frames.append(tagged.select(*[F.col(f"`{c}`") for c in raw.columns], name))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_rows(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, line_no, line)`` of text files that Spark reads in blocks.

    Lines are numbered inside their block; the blocks' line counts give each block its start.
    """
    raw = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    local = F.row_number().over(Window.partitionBy("file", "block").orderBy("_id"))
    earlier = Window.partitionBy("file").orderBy("block")
    starts = (
        raw.groupBy("file", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("file", "block", (F.sum("n").over(earlier) - F.col("n")).alias("start"))
    )
    return (
        raw.withColumn("local", local)
        .join(starts, ["file", "block"])
        .select("file", (F.col("local") + F.col("start")).alias("line_no"), "line")
    )


def header_counts(lines: DataFrame) -> DataFrame:
    """Expected column count per file; files with an empty first line are not checked."""
    return lines.where((F.col("line_no") == 1) & (cells.strip("line") != "")).select(
        "file", cells.csv_columns("line").alias("expected")
    )


def _checked(lines: DataFrame, headers: DataFrame) -> DataFrame:
    body = lines.where((F.col("line_no") > 1) & (cells.strip("line") != ""))
    return body.withColumn("actual", cells.csv_columns("line")).join(headers, "file")


def csv_shape_check(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per line whose column count differs from its file's header."""
    gap = F.col("expected") - F.col("actual")
    return (
        _checked(lines, headers)
        .where(gap != 0)
        .select(
            "file",
            "line_no",
            "actual",
            "expected",
            F.when(gap > 0, F.lit("missing")).otherwise(F.lit("extra")).alias("type"),
            F.abs(gap).alias("by"),
        )
    )


def csv_shape_repair(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Every line, short ones padded with commas; long ones are left for a person."""
    joined = lines.join(headers, "file", "left")
    gap = F.col("expected") - cells.csv_columns("line")
    short = (F.col("line_no") > 1) & (cells.strip("line") != "") & (gap > 0)
    padded = F.when(short, F.concat("line", F.repeat(F.lit(","), F.greatest(gap, F.lit(0)).cast("int"))))
    return joined.select(
        "file", "line_no", F.coalesce(padded, "line").alias("line"), F.coalesce(short, F.lit(False)).alias("changed")
    )


def csv_issue_summary(issues: DataFrame, fixed: bool = True) -> DataFrame:
    """Issues, unresolved issues and whether the file changes, per file."""
    missing = F.col("type") == "missing"
    resolved = missing if fixed else F.lit(False)
    return issues.groupBy("file").agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_if(~resolved).alias("unresolved"),
        F.bool_or(resolved).alias("changed"),
    )


def csv_issue_totals(headers: DataFrame, summary: DataFrame) -> DataFrame:
    """Files scanned, issues, unresolved issues, files changed."""
    return (
        headers.select("file")
        .join(summary, "file", "left")
        .agg(
            F.count("file").alias("files"),
            F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"),
            F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"),
            F.count_if("changed").alias("changed"),
        )
    )


def has_unresolved(summary: DataFrame) -> bool:
    """True when a person must look at the files before they are used."""
    return not summary.where("unresolved > 0").limit(1).isEmpty()
