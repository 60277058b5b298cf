"""Container logs as they lie on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.framing import envelope, reassemble_cri, reassemble_docker
from quarry.sources.files import decoded, read_lines


def _read(make, spark: SparkSession, path: str, source: str, pattern: str, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    lines = decoded(read_lines(spark, path, source, pattern)).where("line <> ''").select("state_key", "pos", "line")
    messages, rejected = make(lines, max_bytes)
    return envelope(messages), rejected


def read_docker_json(spark: SparkSession, path: str, source: str = "docker", pattern: str = "*.log", max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Messages of ``json-file`` logs with their ``parsed`` map, and the rejected lines."""
    return _read(reassemble_docker, spark, path, source, pattern, max_bytes)


def read_cri(spark: SparkSession, path: str, source: str = "cri", pattern: str = "*.log", max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Messages of CRI text logs with their ``parsed`` map, and the rejected lines."""
    return _read(reassemble_cri, spark, path, source, pattern, max_bytes)
