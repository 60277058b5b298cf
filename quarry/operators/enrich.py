"""Kubernetes metadata from container log paths and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.maps import empty_map

CRI_PATH = r"(?:^|/)([^_/]+)_([^_/]+)_([^_/]+)-([0-9a-fA-F]{64})\.log$"
#: Rows of a label table up to which it is broadcast.
BROADCAST_PODS = 200_000


def parse_cri_path(path: Column) -> Column:
    """struct(pod, namespace, container, container_id), null for any other path."""
    part = lambda i: F.regexp_extract(path, CRI_PATH, i)
    return F.when(path.rlike(CRI_PATH), F.struct(part(1).alias("pod"), part(2).alias("namespace"), part(3).alias("container"), part(4).alias("container_id")))


def stream_label(path: Column, state_key: Column) -> Column:
    """pod_namespace_container without the id; the state key where the path is none of a container."""
    p = parse_cri_path(path)
    return F.when(p.isNotNull(), F.concat_ws("_", p["pod"], p["namespace"], p["container"])).otherwise(state_key)


def pod_tags(path: Column) -> Column:
    p = parse_cri_path(path)
    return F.when(p.isNotNull(), F.create_map(F.lit("namespace"), p["namespace"], F.lit("pod"), p["pod"], F.lit("container"), p["container"])).otherwise(empty_map())


def read_pod_labels(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, pod, labels) of a JSON file {"namespace/pod": {label: value}}."""
    text = spark.read.text(path, wholetext=True)
    pods = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>", {"mode": "FAILFAST"})).alias("k", "labels"))
    return pods.select(F.split_part("k", F.lit("/"), F.lit(1)).alias("namespace"), F.split_part("k", F.lit("/"), F.lit(2)).alias("pod"), "labels")


def join_pod_labels(paths: DataFrame, labels: DataFrame, allowlist: list[str]) -> DataFrame:
    """``paths`` (distinct, with namespace and pod) and the allowed labels of each pod; none for a
    pod without any, or with an empty allowlist. A label table of checked size is broadcast, a
    larger one is joined by shuffle."""
    if not allowlist:
        return paths.withColumn("label_tags", empty_map())
    small = labels.limit(BROADCAST_PODS + 1).count() <= BROADCAST_PODS
    side = labels.select("namespace", "pod", F.map_filter("labels", lambda k, v: k.isin(allowlist)).alias("label_tags"))
    joined = paths.join(F.broadcast(side) if small else side, ["namespace", "pod"], "left")
    return joined.withColumn("label_tags", F.coalesce("label_tags", empty_map()))
