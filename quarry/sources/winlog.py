"""Windows events rendered as XML, one in each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.maps import last_wins, let, once
from quarry.functions.parse import ingest_ns, parse_ts_ns

#: Names of the header fields.
SYSTEM = ["EventID", "Level", "Task", "Opcode", "Keywords", "EventRecordID", "Channel", "Computer", "Version"]
#: What is read of an event, all elements of a name in their order. A text read beside an attribute loses
#: its white space, so the names and the texts of data are read apart.
HEADER = f"System array<struct<Provider array<struct<_Name string>>, TimeCreated array<struct<_SystemTime string>>, {', '.join(f'{k} array<string>' for k in SYSTEM)}>>, EventData array<struct<Data array<struct<_Name string>>>>"
TEXTS = "EventData array<struct<Data array<string>>>"
ENTRIES = "array<struct<key:string,value:string>>"


def _other_case() -> str:
    """What stands before a name, of an element or an attribute, that differs from one that is read only in case."""
    elements, attributes = "|".join(["System", "EventData", "Data", "Provider", "TimeCreated", *SYSTEM]), "Name|SystemTime"
    before = r"""<[^\s<>/]++(?:\s++[^\s<>=]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))*?\s++"""
    return rf"(</?+(?:[^\s<>/:]++:)?+(?!(?:{elements})[\s/>])(?=(?i:{elements})[\s/>])|{before}(?!(?:{attributes})[\s=])(?=(?i:{attributes})[\s=]))"


OTHER_CASE = _other_case()


def event(xml: Column, *schemas: str) -> Column:
    """What an event has of each schema, as the fields r0, r1, ...; null for what is not one well-formed event
    and nothing else. ``from_xml`` stops at the end of the first element, so it reads an element around the whole,
    and takes names in any case, so names in another case are made different ones, except in CDATA."""
    body = F.regexp_replace(xml, r"^<\?xml[^>]*>", "")
    renamed = F.transform(F.split(body, r"(?=<!\[CDATA\[)|(?<=]]>)"), lambda p: F.when(p.startswith("<![CDATA["), p).otherwise(F.regexp_replace(p, OTHER_CASE, "$1_")))
    row = F.concat(F.lit("<Row>"), F.when(xml.rlike(OTHER_CASE), F.array_join(renamed, "")).otherwise(body), F.lit("</Row>"))
    options = {"columnNameOfCorruptRecord": "__bad", "wildcardColName": "Others", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
    read = lambda text, schema: F.from_xml(text, f"Event array<struct<{schema}>>, Others array<string>, _VALUE array<string>, __bad string", options)
    alone = lambda r: r["__bad"].isNull() & r["Others"].isNull() & r["_VALUE"].isNull() & (F.size(r["Event"]) == 1)
    names = [f"r{i}" for i in range(len(schemas))]
    reads = let(row, lambda text: F.struct(*(read(text, s).alias(n) for n, s in zip(names, schemas))))
    one = let(reads, lambda r: F.when(alone(r["r0"]), F.struct(*(F.get(r[n]["Event"], F.lit(0)).alias(n) for n in names))))
    return F.when(xml.rlike(r"^\s*(<\?xml[^>]*>\s*)?<Event[\s>]"), one)


def is_event(xml: Column) -> Column:
    """Well-formed, with an event as its root."""
    return event(xml, "System string").isNotNull()


def parse_winlog(events: DataFrame, xml: str = "xml", declared: list[str] | None = None) -> DataFrame:
    """Adds ``parsed`` and ``source_ts_ns``. Named data have their names as keys, unnamed ones that
    are not empty Data0, Data1, ...; of equal names the last one counts; the whole text is under Xml.
    Events without any declared field are skipped; of what is no event ``parsed`` is null, and it is
    skipped with them. An event is read once for all its fields."""
    x = once(events, {"__event": event(F.col(xml), HEADER, TEXTS)})
    header, texts = F.col("__event")["r0"], F.col("__event")["r1"]
    present = lambda values: F.filter(values, lambda v: v.isNotNull())
    first = lambda values: F.get(present(values), F.lit(0))
    every = lambda lists: F.flatten(present(lists))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    base = [entry("Provider", first(every(header["System"]["Provider"])["_Name"]))]
    base += [entry(k, F.get(first(header["System"][k]), F.lit(0))) for k in SYSTEM]
    base.append(entry("Xml", F.col(xml)))
    data = F.arrays_zip(every(header["EventData"]["Data"])["_Name"].alias("key"), every(texts["EventData"]["Data"]).alias("value"))
    filled = F.filter(F.coalesce(data, F.array().cast(ENTRIES)), lambda e: e["value"] != "")
    number = lambda e, i: F.struct(F.concat(F.lit("Data"), i.cast("string")).alias("key"), e["value"].alias("value"))
    both = let(filled, lambda d: F.concat(F.filter(d, lambda e: e["key"].isNotNull()), F.transform(F.filter(d, lambda e: e["key"].isNull()), number)))
    parsed = F.when(header.isNotNull(), last_wins(F.concat(F.filter(F.array(*base), lambda e: e["value"] != ""), both)))
    created = first(every(header["System"]["TimeCreated"])["_SystemTime"])
    x = once(x, {"parsed": parsed, "source_ts_ns": let(created, lambda t: F.coalesce(parse_ts_ns(t, "rfc3339"), ingest_ns()))}).drop("__event")
    return x.where(F.exists(F.map_keys("parsed"), lambda k: k.isin(declared))) if declared else x
