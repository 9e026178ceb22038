"""Triples as text lines, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import vocab

_HEAD = r"^<([^>]*)>\s+<([^>]*)>"
_OBJECT = r"^<[^>]*>\s+<[^>]*>\s+(.*?)\s*\.\s*\z"
_LITERAL = r'^"((?:[^"\\]|\\.)*)"'


def _unescape(c: Column) -> Column:
    """Escapes in a quoted literal are JSON string escapes."""
    options = {"allowUnescapedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    quoted = F.concat(F.lit('["'), c, F.lit('"]'))
    return F.when(c.contains("\\"), F.from_json(quoted, "array<string>", options)[0]).otherwise(c)


def _escape(c: Column) -> Column:
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def ntriples_parse(lines: DataFrame, col: str = "line") -> DataFrame:
    """Adds the parts of a triple to each line; ``indexed`` is false where it is no triple."""
    line = F.col(col)
    body = F.regexp_extract(line, _OBJECT, 1)
    literal = F.regexp_extract(body, _LITERAL, 1)
    tail = F.regexp_replace(body, _LITERAL, "")
    is_iri = body.startswith("<")
    is_literal = body.startswith('"')
    indexed = line.rlike(_HEAD)
    datatype = F.nullif(F.regexp_extract(tail, r"^\^\^<([^>]*)>", 1), F.lit(""))
    lang = F.nullif(F.regexp_extract(tail, r"^@([A-Za-z0-9-]+)", 1), F.lit(""))
    implied = F.when(lang.isNotNull(), F.lit(vocab.RDF_LANG_STRING)).otherwise(
        F.lit(vocab.XSD + "string")
    )
    value = (
        F.when(is_iri, F.regexp_extract(body, r"^<([^>]*)>", 1))
        .when(is_literal, _unescape(literal))
        .when(body != "", body)
    )
    kind = (
        F.when(is_iri, F.lit("iri"))
        .when(is_literal, F.lit("literal"))
        .when(body.startswith("_:"), F.lit("blank"))
    )
    return lines.select(
        "*",
        indexed.alias("indexed"),
        F.when(indexed, F.regexp_extract(line, _HEAD, 1)).alias("subject"),
        F.when(indexed, F.regexp_extract(line, _HEAD, 2)).alias("predicate"),
        value.alias("object"),
        kind.alias("object_kind"),
        F.when(is_literal, F.coalesce(datatype, implied)).alias("datatype"),
        F.when(is_literal, lang).alias("lang"),
    )


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """One line of text per triple."""
    iri = F.concat(F.lit("<"), F.col("object"), F.lit(">"))
    plain = F.col("datatype").isNull() | F.col("datatype").isin(
        vocab.XSD + "string", vocab.RDF_LANG_STRING
    )
    suffix = (
        F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang")))
        .when(plain, F.lit(""))
        .otherwise(F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">")))
    )
    literal = F.concat(F.lit('"'), _escape(F.col("object")), F.lit('"'), suffix)
    written = (
        F.when(F.col("object_kind") == "iri", iri)
        .when(F.col("object_kind") == "blank", F.col("object"))
        .otherwise(literal)
    )
    subject = F.concat(F.lit("<"), F.col("subject"), F.lit("> <"), F.col("predicate"), F.lit("> "))
    return triples.select(F.concat(subject, written, F.lit(" .")).alias("line"))


def ntriples_write(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.mode("overwrite").text(path)
