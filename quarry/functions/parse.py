"""Lines to maps, and map values to declared types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.maps import STRING_MAP, last_wins, let

INTEGER = r"^\s*[+-]?[0-9]+\s*$"
FLOAT = r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"
TRUE = ["true", "True", "TRUE", "t", "T"]
FALSE = ["false", "False", "FALSE", "f", "F"]
RFC3339 = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]{1,18}))?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
#: Factor to nanoseconds of each integer time format.
UNIX = {"unix_s": 1_000_000_000, "unix_ms": 1_000_000, "unix_us": 1_000, "unix_ns": 1}


def decode_lossy(raw: Column) -> Column:
    """Bytes as text; each invalid sequence becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def is_blank(line: Column) -> Column:
    """Only white space, in the Unicode sense."""
    return ~line.rlike(r"(?U)\S")


def parse_json(line: Column) -> Column:
    """A JSON object as a map of texts, null for anything else. Values that are no strings keep
    their JSON text, a JSON null is a null value, and of equal keys the last counts."""
    strict = F.when(F.rtrim(line).endswith("}"), line)
    read = F.from_json(strict, STRING_MAP, {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    plain = lambda m: F.size(m) == F.size(F.array_distinct(F.map_keys(m)))
    return let(read, lambda m: F.when(plain(m), m).otherwise(last_wins(F.map_entries(m))))


def parse_plain(line: Column) -> Column:
    return F.create_map(F.lit("message"), line)


def has_key(m: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def value_text(m: Column, key: str) -> Column:
    """Text of a present value; a JSON null reads ``null``; null where the key is absent."""
    return F.when(has_key(m, key), F.coalesce(F.element_at(m, key), F.lit("null")))


class MapKeys:
    """What a record's map says of a key."""

    def __init__(self, m: Column):
        self.m, self.ok = m, m.isNotNull()

    def has(self, key: str) -> Column:
        return has_key(self.m, key)

    def text(self, key: str) -> Column:
        return value_text(self.m, key)

    def value(self, key: str) -> Column:
        """As ``text``, but a JSON null has no value."""
        return F.when(F.element_at(self.m, key).isNotNull(), self.text(key))


BAD = "__not_json"


def read_json(line: Column, keys: list[str]) -> Column:
    """struct(ok, v, m): the named keys of a JSON object, read once and without the others. Equal keys:
    the last counts. ``m`` is the whole map where the line has a null somewhere, which ``v``
    cannot tell from an absent key; else null."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in [*keys, BAD]])
    strict = F.when(F.rtrim(line).endswith("}") & F.ltrim(line, F.lit(" \t\r\n")).startswith("{"), line)
    v = F.from_json(strict, schema, {"allowSingleQuotes": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return F.struct(v.alias("v"), F.when(line.contains("null"), parse_json(line)).alias("m"))


def can_read(keys: list[str]) -> bool:
    """Whether the keys make a struct: no two differ in case alone."""
    return len({k.lower() for k in [*keys, BAD]}) == len(keys) + 1


class ReadKeys:
    """What ``read_json`` says of a key."""

    def __init__(self, read: Column):
        self.v, self.m = read["v"], read["m"]
        self.ok = self.v.isNotNull() & self.v.getField(BAD).isNull()

    def _null(self, key: str) -> Column:
        return self.m.isNotNull() & has_key(self.m, key)

    def has(self, key: str) -> Column:
        return self.v.getField(key).isNotNull() | self._null(key)

    def text(self, key: str) -> Column:
        return F.coalesce(self.v.getField(key), F.when(self._null(key), "null"))

    def value(self, key: str) -> Column:
        return self.v.getField(key)


def coerce(text: Column, kind: str) -> Column:
    """The value of a declared type, null where the text does not have it. A null text is absent."""
    if kind == "string":
        return text
    if kind == "integer":
        return F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint"))
    if kind == "float":
        return F.when(text.rlike(FLOAT), F.trim(text).try_cast("double"))
    if kind == "boolean":
        return F.when(F.trim(text).isin(TRUE), True).when(F.trim(text).isin(FALSE), False)
    raise ValueError(f"unknown field type {kind!r}")


def parse_ts_ns(text: Column, fmt: str) -> Column:
    """Nanoseconds since 1970, null for a text that the format does not allow. Spark's own
    timestamps stop at microseconds, so the fraction is read apart."""
    trimmed = F.trim(text)
    if fmt in UNIX:
        return F.when(text.rlike(INTEGER), F.try_multiply(trimmed.try_cast("bigint"), F.lit(UNIX[fmt])))
    if fmt == "rfc3339":
        part = lambda i: F.regexp_extract(trimmed, RFC3339, i)
        zone = F.when(F.upper(part(4)) == "Z", "+00:00").otherwise(part(4))
        seconds = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), zone), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
        fraction = F.rpad(F.substring(part(3), 1, 9), 9, "0").try_cast("bigint")
        return F.when(trimmed.rlike(RFC3339), F.try_add(F.unix_micros(seconds) * 1000, F.coalesce(fraction, F.lit(0))))
    raise ValueError(f"unknown timestamp format {fmt!r}")


def ingest_ns() -> Column:
    """One time for the whole query; stamping makes records unique."""
    return F.unix_micros(F.current_timestamp()) * 1000


def timestamp_ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def plain_float(x: Column) -> Column:
    """A finite double as the shortest decimal text without exponent and without ``.0``."""
    s = x.cast("string")

    def moved(parts: Column) -> Column:
        """Digits with the point where the exponent puts it."""
        digits, point, size = parts["digits"], parts["point"], F.length(parts["digits"])
        return (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= size, F.rpad(digits, F.greatest(point, size), F.lit("0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
        )

    def shifted(m: Column) -> Column:
        whole = F.length(F.split_part(m["mantissa"], F.lit("."), F.lit(1)))
        return let(F.struct(F.replace(m["mantissa"], F.lit("."), F.lit("")).alias("digits"), (whole + m["exponent"]).alias("point")), moved)

    unsigned = F.ltrim(s, F.lit("-"))
    mantissa = F.regexp_replace(F.split_part(unsigned, F.lit("E"), F.lit(1)), r"\.0$", "")
    large = let(F.struct(mantissa.alias("mantissa"), F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int").alias("exponent")), shifted)
    return F.when(s.contains("E"), F.concat(F.when(x < 0, "-").otherwise(""), large)).otherwise(F.regexp_replace(s, r"\.0$", ""))


def text_of(value: Column, kind: str) -> Column:
    """A typed value in the text form that predicates and hashes compare."""
    if kind == "float":
        return F.when(F.isnan(value), "NaN").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise(plain_float(value))
    return value.cast("string")
