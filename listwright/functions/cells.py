"""Cell functions: Column in, Column out, all inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.functions import vocab

# White space as text editors and spreadsheets write it, not only the blank.
_SPACE = " \t\n\x0b\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(code) for code in range(0x2000, 0x200B)
)
_PLAIN_REF = r"^[a-zA-Z][a-zA-Z0-9]*:[a-zA-Z0-9_/.:-]+\z"
_ANY_REF = r"^[a-zA-Z][a-zA-Z0-9_-]*:[a-zA-Z0-9_/.:-]+\z"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_HEX = r"^0[xX]([0-9a-fA-F]+)\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(_SPACE))


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """Value of a fixed in-code table, null where the key is absent."""
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def is_http(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def looks_like_uri(c: Column | str) -> Column:
    t = strip(c)
    return F.coalesce(is_http(t) | t.rlike(_PLAIN_REF), F.lit(False))


def _looks_like_reference(t: Column) -> Column:
    return is_http(t) | t.rlike(_ANY_REF)


def split_multi_value(c: Column | str, key: str = "", strict_compat: bool = False) -> Column:
    """One cell -> array. A pipe always splits; a comma only between references.

    The strict form splits at the first comma only and takes no hyphen in a prefix.
    """
    t = strip(c)
    piped = F.transform(F.split(t, r"\|", -1), strip)
    whole = F.array(t)
    protected = ("definition",) if strict_compat else ("definition", "scopenote")
    if key.lower() in protected:
        by_comma = whole
    elif strict_compat:
        left = strip(F.substring_index(t, ",", 1))
        right = strip(F.substring(t, F.instr(t, ",") + 1, F.length(t)))
        both = t.contains(",") & looks_like_uri(left) & looks_like_uri(right)
        by_comma = F.when(both, F.array(left, right)).otherwise(whole)
    else:
        parts = F.transform(F.split(t, ",", -1), strip)
        all_refs = t.contains(",") & F.forall(parts, _looks_like_reference)
        by_comma = F.when(all_refs, parts).otherwise(whole)
    return F.when(t.isNull(), F.lit(None)).when(t.contains("|"), piped).otherwise(by_comma)


def split_refs(c: Column | str) -> Column:
    """Array of references, each item split at every comma; null when nothing is left."""

    def pieces(x: Column) -> Column:
        cut = F.filter(F.transform(F.split(x, ",", -1), strip), lambda p: p != "")
        return F.when(x.contains(","), cut).otherwise(F.array(x))

    present = F.filter(_col(c), lambda x: x.isNotNull())
    flat = F.flatten(F.transform(present, pieces))
    return F.when(F.size(flat) > 0, flat)


def curie_prefix(c: Column) -> Column:
    """Text before the first colon; null when there is none or it comes first."""
    return F.when(F.instr(c, ":") > 1, F.substring_index(c, ":", 1))


def after_first_colon(c: Column) -> Column:
    return F.substring(c, F.instr(c, ":") + 1, F.length(c))


def after_last_colon(c: Column) -> Column:
    last = F.substring_index(c, ":", -1)
    return F.when(last == "", c).otherwise(last)


def iri_short_name(c: Column | str) -> Column:
    c = _col(c)
    local = F.regexp_extract(c, r"([^#/]*)\z", 1)
    out = local
    for base, short in vocab.SHORT_NAMES:
        known = c.startswith(base + "#") | c.startswith(base + "/")
        out = F.when(known, F.concat(F.lit(short + ":"), local)).otherwise(out)
    return F.when(c.isNull() | (c == ""), F.lit("(unknown)")).otherwise(out)


def uri_fallback_label(c: Column | str) -> Column:
    c = _col(c)
    last = F.substring_index(c, "/", -1)
    decoded = F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))
    readable = F.when((last != "") & (last != c) & ~decoded.contains("�"), decoded)
    return F.when(c.startswith("http://TODO"), F.lit(vocab.UNKNOWN_LABEL)).otherwise(
        F.coalesce(readable, c)
    )


def parse_boolean(c: Column | str) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin("true", "1"), F.lit(True)).when(t.isin("false", "0"), F.lit(False))


def _hex_number(digits: Column) -> Column:
    """Hexadecimal digits of any number as a double; ``conv`` holds no more than 64 bits."""
    by_digit = F.aggregate(
        F.split(digits, ""), F.lit(0.0), lambda sum_, d: sum_ * 16 + F.conv(d, 16, 10).cast("double")
    )
    return F.when(F.length(digits) < 16, F.conv(digits, 16, 10).try_cast("double")).otherwise(by_digit)


def parse_number(c: Column | str) -> Column:
    """Finite number from text or from a typed literal ``{"_value": ...}``; else null."""
    c = _col(c)

    def read(t: Column) -> Column:
        number = F.regexp_extract(t, _NUMBER, 0).try_cast("double")
        from_hex = _hex_number(F.nullif(F.regexp_extract(t, _HEX, 1), F.lit("")))
        return F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(number, from_hex))

    def finite(x: Column) -> Column:
        return F.when(F.abs(x) < F.lit(float("inf")), x)

    literal = F.when(F.ltrim(c).startswith("{"), F.get_json_object(c, "$._value")).otherwise(c)
    return once(once(strip(literal), read), finite)


def normalize_condition_value(c: Column | str) -> Column:
    c = _col(c)
    t = strip(c)
    found = F.regexp_extract(c, r"#([^#/]+)\z", 1)
    segment = F.regexp_extract(c, r"/([^/?#]+)\s*\z", 1)
    colon = F.instr(c, ":")
    local = F.when(
        ~c.contains("://") & (colon > 1) & (colon < F.length(c)), after_first_colon(c)
    )
    part = F.coalesce(F.nullif(found, F.lit("")), F.nullif(segment, F.lit("")), local)
    return (
        F.when(F.lower(t).isin("true", "false"), F.lower(t))
        .when(part.isNotNull(), F.lower(strip(part)))
        .otherwise(t)
    )


def value_matches(stored: Column | str, expected: Column | str) -> Column:
    """A stored value meets an expected one, with or without prefix or fragment base."""
    s = F.lower(strip(stored))
    e = _col(expected)
    return (s == e) | s.endswith(F.concat(F.lit(":"), e)) | s.endswith(F.concat(F.lit("#"), e))


def tail(x: Column) -> Column:
    """All characters but the first."""
    return F.substring(x, F.lit(2), F.length(x))


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), tail(x))


def status_iri(c: Column | str, base: str = vocab.STATUS_BASE) -> Column:
    c = _col(c)
    words = F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda x: x != "")
    made = F.concat(F.lit(base), F.array_join(F.transform(words, _capital), ""))
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(is_http(c), c).otherwise(made)


def _fold_underscores(c: Column) -> Column:
    """``a_b`` -> ``aB``; an underscore before anything but a-z stays."""

    def fold(x: Column, i: Column) -> Column:
        return (
            F.when(i == 0, x)
            .when(x.rlike("^[a-z]"), _capital(x))
            .otherwise(F.concat(F.lit("_"), x))
        )

    return F.array_join(F.transform(F.split(F.lower(c), "_", -1), fold), "")


def property_name(c: Column | str) -> Column:
    return _fold_underscores(F.translate(after_last_colon(_col(c)), "-", "_"))


def label_name(c: Column | str) -> Column:
    return _fold_underscores(F.translate(_col(c), "-", "_"))


def relation_name(c: Column | str) -> Column:
    return after_last_colon(_col(c))


def slug(c: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(_col(c)), r"[^A-Za-z0-9_\s-]", "")
    return strip(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-"))


def kebab(c: Column | str) -> Column:
    upper = "".join(chr(x) for x in range(ord("A"), ord("Z") + 1))
    return F.translate(F.regexp_replace(_col(c), "([A-Z])", "-$1"), upper, upper.lower())


def sanitize_name(c: Column | str, n: int = 31) -> Column:
    kept = strip(F.regexp_replace(_col(c), "[^a-zA-Z0-9\\u00C0-\\u024F\\s_-]", ""))
    return F.regexp_replace(F.substring(kept, 1, n), r"^\z", "Sheet")


def map_data_type(type_c: Column, has_parts: Column) -> Column:
    return F.coalesce(
        lookup(type_c, vocab.RULE_TYPES),
        F.when(has_parts, F.lit("object")).otherwise(F.lit("string")),
    )


def data_type_unknown(type_c: Column, has_parts: Column, coded: Column) -> Column:
    """True where the type falls back to text without a coded list or reference to explain it."""
    return lookup(type_c, vocab.RULE_TYPES).isNull() & ~has_parts & ~coded


def dated_type(type_c: Column) -> Column:
    """Range IRI of any type that names a date or a time; else null."""
    return F.when(type_c.contains("dateTime"), F.lit(vocab.XSD + "dateTime")).when(
        type_c.contains("date"), F.lit(vocab.XSD + "date")
    )


def map_semantic_type(type_c: Column, rule_type: Column, coded: Column | None = None) -> Column:
    base = F.coalesce(
        lookup(type_c, vocab.RANGE_TYPES),
        lookup(rule_type, vocab.RANGE_BY_RULE_TYPE),
        F.lit(vocab.XSD + "string"),
    )
    dated = dated_type(type_c)
    applies = (rule_type == "string") & type_c.isNotNull()
    if coded is not None:
        applies = applies & ~coded
    return F.when(applies & dated.isNotNull(), dated).otherwise(base)


def map_entry_type(const: Column, n_options: Column, rule_type: Column, fmt: Column) -> Column:
    return (
        F.when(const.isNotNull(), F.lit("readonly"))
        .when(n_options > 0, F.lit("dropdown"))
        .when(rule_type == "number", F.lit("number"))
        .when(rule_type == "boolean", F.lit("text"))
        .when(fmt == "date-time", F.lit("datetime"))
        .when(fmt == "date", F.lit("date"))
        .otherwise(F.lit("text"))
    )


def is_placeholder(c: Column) -> Column:
    out = F.lit(False)
    for m in vocab.PLACEHOLDER_MARKERS:
        out = out | c.contains(m)
    return out


def is_excluded(c: Column, excluded: Sequence[str] = vocab.EXCLUDED_VOCABULARIES) -> Column:
    return F.coalesce(starts_with_any(c, excluded), F.lit(False))


def classify_reference(
    c: Column | str,
    external: Sequence[str] = (),
    excluded: Sequence[str] = vocab.EXCLUDED_VOCABULARIES,
) -> Column:
    """What a reference is; ``external`` are the starts of those that other organisations define."""
    c = _col(c)
    return (
        F.when(is_placeholder(c), F.lit("placeholder"))
        .when(starts_with_any(c, external), F.lit("external"))
        .when(starts_with_any(c, excluded), F.lit("excluded"))
        .otherwise(F.lit("local"))
    )


def first_alias(*cols: Column | str) -> Column:
    return F.coalesce(*[_col(c) for c in cols])


def local_name(c: Column | str) -> Column:
    """Lower-cased local name: last path segment of the fragment, else text after the last colon."""
    c = _col(c)
    fragment = F.get(F.split(c, "#", -1), F.lit(1))
    local = F.when(c.contains("#"), F.substring_index(fragment, "/", -1)).otherwise(
        F.substring_index(c, ":", -1)
    )
    return F.lower(F.nullif(local, F.lit("")))


def csv_columns(c: Column | str) -> Column:
    """Number of comma-separated columns, commas inside quotes not counted."""
    bare = F.regexp_replace(_col(c), r'"[^"]*("|\z)', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).cast("bigint")


def prefixed_relation_name(uri: Column, name: Column) -> Column:
    """Relation-derived name made unique by its vocabulary prefix."""
    base = F.when(
        uri.contains("#"),
        F.substring(uri, 1, F.length(uri) - F.length(F.substring_index(uri, "#", -1))),
    ).otherwise(uri)
    out = F.when(
        F.length(base) > 0, F.concat(F.regexp_replace(base, "[^a-zA-Z0-9#]", "-"), name)
    ).otherwise(name)
    for fragment, prefix in reversed(vocab.RELATION_PREFIXES):
        out = F.when(uri.contains(fragment), F.concat(F.lit(prefix + "-"), name)).otherwise(out)
    return out
