"""OpenTelemetry log requests in their JSON form, one request in each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.maps import last_wins
from quarry.functions.parse import ingest_ns

SCALAR = "stringValue string, boolValue boolean, intValue string, doubleValue double, bytesValue string"
ANY = f"struct<stringValue: string, boolValue: boolean, intValue: string, doubleValue: double, bytesValue: string, arrayValue: struct<values: array<struct<{SCALAR}>>>, kvlistValue: struct<values: array<struct<key: string, value: struct<{SCALAR}>>>>>"
KEYS = f"array<struct<key: string, value: {ANY}>>"
ENTRIES = "array<struct<key: string, value: string>>"
REQUEST = f"""resourceLogs array<struct<resource: struct<attributes: {KEYS}>, scopeLogs: array<struct<
    scope: struct<name: string, version: string, attributes: {KEYS}>,
    logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, body: {ANY}, attributes: {KEYS}>>>>>>"""


def _scalar(v: Column) -> Column:
    number = F.regexp_replace(v["doubleValue"].cast("string"), r"\.0$", "")
    return F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], number, F.lower(F.hex(F.unbase64(v["bytesValue"]))))


def _json(v: Column) -> Column:
    """A scalar inside a list: texts in quotes, the others bare."""
    return F.when(v["stringValue"].isNotNull() | v["bytesValue"].isNotNull(), F.concat(F.lit('"'), F.replace(F.replace(_scalar(v), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(_scalar(v))


def any_text(v: Column) -> Column:
    """A value as text: lists and maps as JSON, bytes in hexadecimal."""
    items = F.concat(F.lit("["), F.array_join(F.transform(v["arrayValue"]["values"], _json), ","), F.lit("]"))
    pairs = F.transform(v["kvlistValue"]["values"], lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), _json(e["value"])))
    return F.coalesce(_scalar(v), items, F.concat(F.lit("{"), F.array_join(F.array_sort(pairs), ","), F.lit("}")))


def _entries(keys: Column) -> Column:
    """(key, value text) of attributes; those without a value are left out."""
    shown = F.transform(keys, lambda e: F.struct(F.coalesce(e["key"], F.lit("")).alias("key"), any_text(e["value"]).alias("value")))
    return F.coalesce(F.filter(shown, lambda e: e["value"].isNotNull()), F.array().cast(ENTRIES))


def _one(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))).otherwise(F.array().cast(ENTRIES))


def read_requests(requests: DataFrame, column: str = "value", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records as ``flatten`` gives them, and (keep, reason) of the rows that are no valid request: no
    JSON object, or one with a value of another type. A request that is rejected gives no record."""
    keep = keep or []
    read = F.struct(F.ltrim(column).startswith("{").alias("object"), F.from_json(column, f"{REQUEST}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("q"))
    # exploding a single element keeps the reading of a text from being repeated wherever it is named
    x = requests.select(*keep, F.explode(F.array(read)).alias("__r")).select(*keep, "__r.*")
    good = F.coalesce(F.col("q.__bad").isNull() & F.col("object"), F.lit(False))
    rejected = x.where(~good).select(*keep, F.lit("unparseable: not a log export request").alias("reason"))
    return _records(x.where(good), keep), rejected


def flatten(requests: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(keep, place, parsed, source_ts_ns), one row for each log record of the valid requests.
    Attributes are laid down from the resource over the scope to the record, so the nearest
    wins; then body and severity."""
    return read_requests(requests, column, keep)[0]


def _records(x: DataFrame, keep: list[str]) -> DataFrame:
    # attributes of a resource and of a scope become texts once, before their records part
    x = x.select(*keep, F.posexplode("q.resourceLogs").alias("i", "r"))
    x = x.select(*keep, "i", _entries(F.col("r.resource.attributes")).alias("ra"), F.col("r.scopeLogs").alias("r"))
    x = x.select(*keep, "i", "ra", F.posexplode("r").alias("j", "s"))
    above = F.concat("ra", _one("scope.name", F.nullif(F.col("s.scope.name"), F.lit(""))), _entries(F.col("s.scope.attributes")))
    x = x.select(*keep, "i", "j", above.alias("above"), F.col("s.logRecords").alias("s"))
    x = x.select(*keep, "i", "j", "above", F.posexplode("s").alias("k", "l"))
    severity = F.when(F.coalesce(F.col("l.severityNumber"), F.lit(0)) != 0, F.col("l.severityNumber").cast("string"))
    own = [_entries(F.col("l.attributes")), _one("body", any_text(F.col("l.body"))), _one("severity_text", F.nullif(F.col("l.severityText"), F.lit(""))), _one("severity_number", severity)]
    parsed = last_wins(F.concat("above", *own))
    return x.select(*keep, F.struct("i", "j", "k").alias("place"), parsed.alias("parsed"), timestamp(F.col("l.timeUnixNano"), F.col("l.observedTimeUnixNano")).alias("source_ts_ns"))


def timestamp(time: Column, observed: Column) -> Column:
    """The record's time, else when it was observed, else now."""
    real = lambda t: F.nullif(t.try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.coalesce(real(time), real(observed), ingest_ns())
