"""Parsed maps to records: tags, typed fields, filters, samples, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashes import fnv1a_mod, identity
from quarry.functions.maps import empty_map, merge, named, once
from quarry.functions.parse import MapKeys, ReadKeys, can_read, coerce, ingest_ns, is_blank, parse_json, parse_ts_ns, read_json, text_of, value_text
from quarry.plans.spec import Filter, Redact, Sample, SourceSpec


def drop_blank(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines without their trailing line ends; lines of white space alone are neither read nor
    errors."""
    return lines.withColumn(column, F.rtrim(F.col(column), F.lit("\r\n"))).where(~is_blank(F.col(column)))


def tags_allowlist(parsed: Column, keys: list[str]) -> Column:
    """Only named keys; empty values are left out, a JSON null reads ``null``."""
    if not keys:
        return empty_map()
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), value_text(parsed, k).alias("value")) for k in keys))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull() & (e["value"] != "")))


def tags_static(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv)) if values else empty_map()


def record_tags(parsed: Column, spec: SourceSpec, stream: Column, pod: Column | None = None, labels: Column | None = None) -> Column:
    """stream < static < pod labels < allowlist < visibility < pod identity; the later wins."""
    layers = [F.create_map(F.lit("stream"), stream), tags_static(spec.tags_static), *([] if labels is None else [labels]), tags_allowlist(parsed, list(spec.tags))]
    if spec.visibility:
        layers.append(F.create_map(F.lit("_visibility"), F.lit(spec.visibility)))
    if pod is not None:
        layers.append(pod)
    return merge(*layers)


class TagMap:
    """Tags in a map column."""

    def __init__(self, column: str = "tags"):
        self.map, self.text = F.col(column), F.col(column)

    def get(self, name: str) -> Column | None:
        return F.element_at(self.map, name)


class TagColumns:
    """Tags whose keys are known before a record is read: one column ``t_<key>`` each, null where the
    record lacks the tag. ``text`` is what a line is rendered from; ``map`` is made where needed."""

    def __init__(self, keys: list[str]):
        self.text = {k: named(f"t_{k}") for k in sorted(keys)}

    @property
    def map(self) -> Column:
        made = F.create_map(*(x for k, c in self.text.items() for x in (F.lit(k), c)))
        return F.map_filter(made, lambda k, v: v.isNotNull())

    def get(self, name: str) -> Column | None:
        return self.text.get(name)


Tags = TagMap | TagColumns


def tag_keys(spec: SourceSpec) -> list[str] | None:
    """All tags that records of a source can have; None where the source's pods have labels of their own."""
    if spec.kubernetes:
        return None
    return sorted({"stream", *spec.tags_static, *spec.tags, *(["_visibility"] if spec.visibility else [])})


def tags_of(spec: SourceSpec) -> Tags:
    keys = tag_keys(spec)
    return TagMap() if keys is None else TagColumns(keys)


def tag_columns(keys: MapKeys | ReadKeys, spec: SourceSpec, stream: Column) -> dict[str, Column]:
    """The layers of ``record_tags`` for tags that are known by name."""
    out = {"stream": stream, **{k: F.lit(v) for k, v in spec.tags_static.items()}}
    for k in spec.tags:
        seen = F.nullif(keys.text(k), F.lit(""))
        out[k] = F.coalesce(seen, out[k]) if k in out else seen
    if spec.visibility:
        out["_visibility"] = F.lit(spec.visibility)
    return out


def read_lines_once(framed: DataFrame, spec: SourceSpec) -> DataFrame:
    """Adds ``read``: what the spec names of a line of JSON, by one reading. Names that differ in case
    alone cannot be read that way; then ``parsed`` is added, the whole line as a map."""
    keys = sorted({*spec.tags, *spec.fields, *([spec.timestamp_field] if spec.timestamp_field else [])})
    if can_read(keys):
        return once(framed, {"read": read_json(F.col("line"), keys)})
    return once(framed, {"parsed": parse_json(F.col("line"))})


def map_records(framed: DataFrame, spec: SourceSpec, parsed: str = "parsed", keep: list[str] | None = None) -> DataFrame:
    """table, tags, one ``f_<name>`` column for each declared field, source_ts_ns, and ``reason``
    where the record has to be quarantined: any field that does not coerce rejects it whole.
    Tags are one column each where their keys are known (``tags_of`` gives them), else a map.

    Lines come read (``read_lines_once``) or as a map column. All of it is computed once for each row."""
    keys = ReadKeys(F.col("read")) if "read" in framed.columns else MapKeys(F.col(parsed))
    reasons = [F.when(~keys.ok, "unparseable: not a JSON object")]
    if "source_ts_ns" in framed.columns:  # the source's own time counts
        ts = F.col("source_ts_ns")
        reasons.append(F.when(ts.isNull(), "bad timestamp: missing"))
    elif spec.timestamp_field:
        raw = keys.text(spec.timestamp_field)
        ts = parse_ts_ns(raw, spec.timestamp_format)
        reasons.append(F.when(ts.isNull(), F.concat(F.lit("bad timestamp: "), F.coalesce(raw, F.lit("missing")))))
    else:
        ts = ingest_ns()
    known = lambda c: F.col(c) if c in framed.columns else None
    stream = F.col("stream") if "stream" in framed.columns else F.lit(spec.name)
    columns = {"table": F.lit(spec.table), "__ts": ts}
    if tag_keys(spec) is None:
        columns["tags"] = record_tags(F.col(parsed), spec, stream, known("pod_tags"), known("label_tags"))
    else:
        columns |= {f"t_{k}": c for k, c in tag_columns(keys, spec, stream).items()}
    for name, kind in sorted(spec.fields.items()):
        # JSON null has no value of any type but text
        value = coerce(keys.value(name) if kind != "string" else keys.text(name), kind)
        columns[f"f_{name}"] = value
        reasons.append(F.when(keys.has(name) & value.isNull(), f"field '{name}' will not coerce to {kind}"))
    kept = keep if keep is not None else [c for c in framed.columns if c not in (parsed, "read", "source_ts_ns")]
    mapped = once(framed, {**columns, "reason": F.coalesce(*reasons)})
    return mapped.select(*(named(c) for c in kept), *(named(c).alias("source_ts_ns" if c == "__ts" else c) for c in columns), "reason")


def quarantine(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records, and the rejected with their reasons."""
    return mapped.where("reason is null").drop("reason"), mapped.where("reason is not null")


def field_equals(name: str, value: str, kinds: dict[str, str], tags: Tags | None = None) -> Column:
    """A tag or a field of that name whose text is the value."""
    tag = (tags or TagMap()).get(name)
    out = F.lit(False) if tag is None else F.coalesce(tag == value, F.lit(False))
    if name in kinds:
        out = out | F.coalesce(text_of(named(f"f_{name}"), kinds[name]) == value, F.lit(False))
    return out


def passes_filters(filters: list[Filter], kinds: dict[str, str], tags: Tags | None = None) -> Column:
    """Deny rules first: any match drops. If there are allow rules, one has to match."""
    deny = [field_equals(f.field, f.equals, kinds, tags) for f in filters if f.drop]
    allow = [field_equals(f.field, f.equals, kinds, tags) for f in filters if not f.drop]
    out = ~reduce(lambda a, b: a | b, deny, F.lit(False))
    return out & reduce(lambda a, b: a | b, allow) if allow else out


def passes_samples(samples: list[Sample], kinds: dict[str, str], ts: str = "source_ts_ns", tags: Tags | None = None) -> Column:
    """Every rule that applies keeps one of ``rate`` records, by a hash of the whole record, so that
    a replay keeps the same ones."""
    who = identity((tags or TagMap()).map, [(k, text_of(named(f"f_{k}"), kind)) for k, kind in sorted(kinds.items())])
    out = F.lit(True)
    for s in samples:
        if s.rate > 1:
            chosen = fnv1a_mod(who, F.col(ts), s.rate) == 0
            out = out & (chosen if s.field is None else ~field_equals(s.field, s.equals, kinds, tags) | chosen)
    return out


def redacted(rules: list[Redact], kinds: dict[str, str]) -> dict[str, Column]:
    """Text fields with all matches replaced, rule after rule; tags are left alone."""
    out: dict[str, Column] = {}
    for r in rules:
        if kinds.get(r.field) == "string":
            name = f"f_{r.field}"
            out[name] = F.regexp_replace(out.get(name, named(name)), f"(?U){r.pattern}", r.replacement)
    return out


def dropped_by(spec: SourceSpec) -> Column:
    """The stage that drops a record, null for one that is kept: filter, then sample."""
    tags = tags_of(spec)
    dropped = F.when(~passes_filters(list(spec.filters), spec.fields, tags), "filter")
    return F.coalesce(dropped, F.when(~passes_samples(list(spec.samples), spec.fields, tags=tags), "sample")) if spec.samples else dropped


def transform_records(records: DataFrame, spec: SourceSpec) -> tuple[DataFrame, DataFrame]:
    """Filter, sample on the values as they came, redact. Returns the kept records, and all records
    with the stage that dropped them (null for the kept)."""
    staged = records.withColumn("dropped", dropped_by(spec))
    kept = staged.where("dropped is null").drop("dropped")
    changes = redacted(list(spec.redactions), spec.fields)
    return (kept.withColumns(changes) if changes else kept), staged
