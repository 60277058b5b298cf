"""A declared source as one lazy plan: frame, parse, map, filter, sample, redact, stamp, encode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.maps import named, once
from quarry.functions.parse import parse_json, parse_plain
from quarry.operators import accounting, framing, records, sinks, stamping
from quarry.operators.enrich import join_pod_labels, parse_cri_path, pod_tags, stream_label
from quarry.plans.spec import SourceSpec
from quarry.sources import files, otlp, winlog


@dataclass
class Pipeline:
    """ok: stamped and encodable records; quarantined: (state_key, pos, line, reason); outcomes:
    one row for each line read, with the stage where it ended."""

    ok: DataFrame
    quarantined: DataFrame
    outcomes: DataFrame

    def counters(self) -> DataFrame:
        return accounting.counters(self.outcomes)


LINE = ["state_key", "pos", "line"]
REJECT = [*LINE, "reason"]
#: Columns that tell records of one position apart: the stream of a container, the place in a request.
WITHIN = ("channel", "place")


def frame(lines: DataFrame, spec: SourceSpec) -> tuple[DataFrame, DataFrame | None]:
    """(state_key, pos, line) with ``parsed`` or ``read``, source_ts_ns where the source has a time of its
    own, and the lines that the framing rejects. Entries of a journal and Windows events without any
    declared field are neither read nor errors."""
    declared = list(spec.fields)
    if spec.parser == "journal":
        entries = records.drop_blank(lines.select(*LINE))
        bad = entries.where(parse_json(F.col("line")).isNull())
        return files.read_journal(entries, declared), bad.withColumn("reason", F.lit("unparseable: not a journal entry"))
    if spec.parser == "winlog":
        events = records.drop_blank(lines.select(*LINE))
        good = winlog.parse_winlog(events, "line", declared).where(F.col("parsed").isNotNull())
        return good, events.where(~winlog.is_event(F.col("line"))).withColumn("reason", F.lit("unparseable: not an event"))
    if spec.parser == "otlp":
        good, bad = otlp.read_requests(records.drop_blank(lines.select(*LINE)).withColumn("request", F.col("line")), "request", LINE)
        return good, bad.select(*REJECT)
    if spec.parser in ("docker_json", "cri"):
        make = framing.reassemble_docker if spec.parser == "docker_json" else framing.reassemble_cri
        messages, bad = make(lines, spec.max_bytes)
        return framing.envelope(messages).withColumn("line", F.col("log")), bad.select(*REJECT)
    if spec.parser not in ("json", "plain"):
        raise ValueError(f"source {spec.name}: no framing for parser {spec.parser!r}")
    multiline = spec.multiline
    framed = framing.join_multiline(lines, multiline.starts_with, multiline.max_lines, multiline.max_bytes) if multiline else lines.select("state_key", "pos", "line")
    framed = records.drop_blank(framed)
    if spec.parser == "plain":
        return framed.withColumn("parsed", parse_plain(F.col("line"))), None
    if spec.kubernetes:  # labels come as maps
        return once(framed, {"parsed": parse_json(F.col("line"))}), None
    return records.read_lines_once(framed, spec), None


def pods(lines: DataFrame, spec: SourceSpec, labels: DataFrame | None) -> DataFrame:
    """(state_key, pod_tags, label_tags, __s) of each file: who wrote it, and the allowed labels of that
    pod, looked up once for each file and not for each line."""
    pod = parse_cri_path(F.col("path"))
    paths = lines.groupBy("state_key").agg(F.max("path").alias("path"))
    paths = paths.select("state_key", pod_tags(F.col("path")).alias("pod_tags"), stream_label(F.col("path"), F.col("state_key")).alias("__s"), pod["namespace"].alias("namespace"), pod["pod"].alias("pod"))
    if labels is not None:
        paths = join_pod_labels(paths, labels, list(spec.labels))
    return paths.drop("namespace", "pod")


def compose(lines: DataFrame, spec: SourceSpec, labels: DataFrame | None = None) -> Pipeline:
    """``lines``: (state_key, pos, line) and, for container paths, path; ``labels``: (namespace, pod,
    labels) for a source that names allowed pod labels. The order of stages is part
    of the meaning: what is rejected or dropped takes no place in a tick, samples are drawn
    from values before redaction, and a record that cannot be encoded has taken its place."""
    framed, bad_frames = frame(lines, spec)
    framed = framed.withColumn("stream", F.lit(spec.name))
    if spec.kubernetes:
        framed = framed.join(pods(lines, spec, labels), "state_key", "left").withColumn("stream", F.coalesce("__s", "stream")).drop("__s")
    within = [c for c in WITHIN if c in framed.columns]
    mapped = records.map_records(framed, spec, keep=[*LINE, *within])
    good, bad = records.quarantine(mapped)
    kept, _ = records.transform_records(good, spec)
    scope = ["state_key"]
    stamped = stamping.stamp(kept, spec.tick_ns, ["pos", *within], scope)
    fresh, spent = stamped.where("not exhausted"), stamped.where("exhausted")
    tags = records.tags_of(spec)
    ok, unencodable = sinks.encoded(fresh, spec.fields, tags.text)
    if isinstance(tags, records.TagColumns):
        ok = ok.withColumn("tags", tags.map).drop(*(f"t_{k}" for k in tags.text))
    quarantined = bad.select(*REJECT).unionByName(spent.select("state_key", "pos", "line", F.lit("stamp: no place left in the tick").alias("reason"))).unionByName(unencodable.select(*REJECT))
    if bad_frames is not None:
        quarantined = quarantined.unionByName(bad_frames)
    return Pipeline(ok, quarantined, outcomes(mapped, spec, bad_frames))


def outcomes(mapped: DataFrame, spec: SourceSpec, bad_frames: DataFrame | None) -> DataFrame:
    """(source, stage) of every line, in one pass over the mapped records: only what decides a stage
    goes through the stamping window. Lines that are rejected or dropped before it stand in
    ticks of their own, so they take no place and are not gathered."""
    within = [c for c in WITHIN if c in mapped.columns]
    gone = F.when(F.col("reason").isNotNull(), "quarantined").otherwise(records.dropped_by(spec))
    unencodable = sinks.unencodable_reason(spec.fields).isNotNull()
    x = mapped.select("state_key", "pos", *within, "source_ts_ns", gone.alias("gone"), unencodable.alias("unencodable"))
    x = x.withColumns({"live": F.col("gone").isNull(), "source_ts_ns": F.when(F.col("gone").isNull(), F.col("source_ts_ns")).otherwise(F.col("pos") * F.lit(spec.tick_ns))})
    x = stamping.stamp(x, spec.tick_ns, ["pos", *within], ["state_key", "live"])
    stage = F.coalesce("gone", F.when(F.col("exhausted") | F.col("unencodable"), "quarantined"), F.lit("shipped"))
    out = x.select(F.lit(spec.name).alias("source"), stage.alias("stage"))
    if bad_frames is not None:
        out = out.unionByName(bad_frames.select(F.lit(spec.name).alias("source"), F.lit("quarantined").alias("stage")))
    return out


def settle(lines: DataFrame, spec: SourceSpec, labels: DataFrame | None = None, resume: DataFrame | None = None) -> DataFrame:
    """One row for each line read, in one pass: source, parser, stage (shipped, quarantined, filter,
    sample), reason, and for what is shipped the stamped record with its line in ``lp``. ``resume``:
    (state_key, tick, next_seq) of the ticks that earlier batches have begun.

    This is ``compose`` for a sink that needs all of it; rejected and dropped lines go through the
    stamping window in ticks of their own, as in ``outcomes``."""
    framed, bad_frames = frame(lines, spec)
    framed = framed.withColumn("stream", F.lit(spec.name))
    if spec.kubernetes:
        framed = framed.join(pods(lines, spec, labels), "state_key", "left").withColumn("stream", F.coalesce("__s", "stream")).drop("__s")
    within = [c for c in WITHIN if c in framed.columns]
    told = [c for c in ("path", "truncated") if c in framed.columns]
    mapped = records.map_records(framed, spec, keep=[*LINE, *within, *told])
    gone = F.when(F.col("reason").isNotNull(), "quarantined").otherwise(records.dropped_by(spec))
    x = once(mapped, {"gone": gone}).withColumn("live", F.col("gone").isNull())
    x = x.withColumns({"source_ts_ns": F.when(F.col("live"), F.col("source_ts_ns")).otherwise(F.col("pos") * F.lit(spec.tick_ns)), **records.redacted(list(spec.redactions), spec.fields)})
    x = stamping.stamp(x, spec.tick_ns, ["pos", *within], ["state_key", "live"], None if resume is None else resume.withColumn("live", F.lit(True)))
    tags = records.tags_of(spec)
    why = F.when(F.col("exhausted"), "stamp: no place left in the tick").otherwise(sinks.unencodable_reason(spec.fields))
    reason = F.coalesce("reason", F.when(F.col("live"), why))
    x = x.withColumn("__why", reason).drop("reason", "exhausted")
    stage = F.coalesce("gone", F.when(F.col("__why").isNotNull(), "quarantined"), F.lit("shipped"))
    line = sinks.line_of(spec.fields, tags.text)
    kept = [c for c in x.columns if c not in ("gone", "live", "__why", "table", "tick", "seq", "ts_ns", "source_ts_ns", *(f"t_{k}" for k in (tags.text if isinstance(tags, records.TagColumns) else [])), "tags")]
    real = lambda c: F.when(F.col("live"), F.col(c)).alias(c)
    out = x.select(F.lit(spec.name).alias("source"), F.lit(spec.parser).alias("parser"), stage.alias("stage"), F.col("__why").alias("reason"), *(named(c) for c in kept), "table", tags.map.alias("tags"), real("tick"), real("seq"), real("ts_ns"), F.when(F.col("live"), line).alias("lp"))
    if bad_frames is not None:
        bad = bad_frames.select(F.lit(spec.name).alias("source"), F.lit(spec.parser).alias("parser"), F.lit("quarantined").alias("stage"), "reason", *LINE)
        out = out.unionByName(bad, allowMissingColumns=True)
    return out


def compose_all(sources: list[tuple[DataFrame, SourceSpec]], labels: DataFrame | None = None) -> Pipeline:
    """Several sources as one; columns that a source lacks are null."""
    from quarry.plans.spec import validate

    validate([s for _, s in sources])
    parts = [compose(lines, spec, labels) for lines, spec in sources]
    first, *rest = parts
    for p in rest:
        first = Pipeline(first.ok.unionByName(p.ok, allowMissingColumns=True), first.quarantined.unionByName(p.quarantined), first.outcomes.unionByName(p.outcomes))
    return first
