"""Line protocol: rendering, tag injection, and reading back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.maps import sorted_entries
from quarry.functions.parse import plain_float

CONTROL = r"[\x00-\x1F]"
TOKEN = r"(?:\\.|[^\\ ])+"
PART = r"(?:\\.|[^\\,= ])+"


def escape_key(s: Column) -> Column:
    """Keys, tag values and table names: controls become spaces; comma, equals sign and space get
    a backslash."""
    return F.when(s.rlike(r"[\x00-\x1F,= ]"), F.regexp_replace(F.regexp_replace(s, CONTROL, " "), r"([,= ])", r"\\$1")).otherwise(s)


def escape_text(s: Column) -> Column:
    """Contents of a quoted field."""
    t = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    t = F.replace(F.replace(t, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))
    return F.when(s.rlike(r'[\x00-\x1F"\\]'), F.regexp_replace(t, CONTROL, " ")).otherwise(s)


def field_text(value: Column, kind: str) -> Column:
    """A field value as written; null for a null, and for a float that is not finite."""
    if kind == "integer":
        return F.concat(value.cast("string"), F.lit("i"))
    if kind == "float":
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), plain_float(value))
    if kind == "boolean":
        return value.cast("string")
    return F.concat(F.lit('"'), escape_text(value), F.lit('"'))


def not_finite(x: Column) -> Column:
    """Whether a float that is there has no text."""
    return F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))


def tag_text(tags: Column | dict[str, Column]) -> Column:
    """``,key=value`` of each tag that has a value, in key order. Tags come as a map, or as a column
    for each key that there can be, which takes no sorting."""
    if isinstance(tags, dict):
        return F.concat(F.lit(""), *(F.coalesce(F.concat(F.lit(","), escape_key(F.lit(k)), F.lit("="), escape_key(v)), F.lit("")) for k, v in sorted(tags.items())))
    return F.array_join(F.transform(F.filter(sorted_entries(tags), lambda e: e["value"].isNotNull()), lambda e: F.concat(F.lit(","), escape_key(e["key"]), F.lit("="), escape_key(e["value"]))), "")


def encode_line(table: Column, tags: Column | dict[str, Column], fields: dict[str, tuple[Column, str]], ts_ns: Column) -> Column:
    """One line; null where the record has no table, no field, or a float that is not finite."""
    head = F.concat(escape_key(table), tag_text(tags))
    written = [F.when(c.isNotNull(), F.concat(escape_key(F.lit(k)), F.lit("="), field_text(c, kind))) for k, (c, kind) in fields.items()]
    bad = reduce(lambda a, b: a | b, [not_finite(c) for c, kind in fields.values() if kind == "float"], F.lit(False))
    some = F.concat_ws(",", *written)  # nulls are passed over
    line = F.concat(head, F.lit(" "), some, F.lit(" "), ts_ns.cast("string"))
    return F.when((F.length(table) > 0) & (F.length(some) > 0) & ~bad, line)


def unencodable(table: Column, fields: dict[str, tuple[Column, str]]) -> Column:
    """Why ``encode_line`` gives null: a reason, or null where it does not."""
    none = reduce(lambda a, b: a & b, [c.isNull() for c, _ in fields.values()], F.lit(True))
    bad = [F.when(not_finite(c), F.lit(f"unencodable: field '{k}' is not finite")) for k, (c, kind) in fields.items() if kind == "float"]
    return F.coalesce(F.when(F.coalesce(F.length(table), F.lit(0)) == 0, "unencodable: empty table"), F.when(none, "unencodable: no fields"), *bad)


def inject_tags(line: Column, tags: Column) -> Column:
    """The tags added behind the table and tags of a line, before its first space that is not
    escaped; a line without one stays as it is."""
    added = F.array_join(F.transform(sorted_entries(tags), lambda e: F.concat(F.lit(","), escape_key(e["key"]), F.lit("="), escape_key(e["value"]))), "")
    head = F.regexp_extract(line, f"^({TOKEN}) ", 1)
    return F.when(head == "", line).otherwise(F.concat(head, added, F.substring(line, F.length(head) + 1, F.length(line))))


def _unescape(s: Column) -> Column:
    return F.regexp_replace(s, r"\\([,= ])", "$1")


def parse_line(line: Column) -> Column:
    """struct(table, tags, fields, ts_ns) of a line; null where it is none. Field values keep their
    written form: ``42i``, ``"text"``, ``true``, ``1.5``."""
    shape = rf'^({TOKEN}) ((?:"(?:\\.|[^"\\])*"|[^" ])+)(?: (-?[0-9]+))?$'
    head, body, ts = (F.regexp_extract(line, shape, i) for i in (1, 2, 3))
    table = _unescape(F.regexp_extract(head, rf"^((?:\\.|[^\\,])+)", 1))
    pair = rf",({PART})=({PART})"
    tags = F.map_from_arrays(F.transform(F.regexp_extract_all(head, F.lit(pair), F.lit(1)), _unescape), F.transform(F.regexp_extract_all(head, F.lit(pair), F.lit(2)), _unescape))
    field = rf'({PART})=("(?:\\.|[^"\\])*"|[^", ]+)'
    fields = F.map_from_arrays(F.transform(F.regexp_extract_all(body, F.lit(field), F.lit(1)), _unescape), F.regexp_extract_all(body, F.lit(field), F.lit(2)))
    return F.when(line.rlike(shape), F.struct(table.alias("table"), tags.alias("tags"), fields.alias("fields"), ts.try_cast("bigint").alias("ts_ns")))


def field_value(text: Column) -> Column:
    """A written field value without its marks."""
    quoted = F.replace(F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(text.startswith('"'), quoted).when(text.rlike("^-?[0-9]+i$"), F.rtrim(text, F.lit("i"))).otherwise(text)
