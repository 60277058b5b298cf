"""Helpers that the operators of this subpackage share.

Words are maximal runs of bytes other than space and ``\\t \\n \\v \\f \\r``. Splitting the
UTF-8 bytes with ``bytes.split()`` gives exactly these runs, and ``bytes.lower()`` changes
A-Z alone.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word table holds before it is emptied.
MEMO_WORDS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent (a local test session), the machine's temporary folder
    serves and the setting is left as it was.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "quarry-checkpoints")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Rows of whole texts that travel to a worker at once.
BATCH_ROWS = 2_000


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's number of rows in an Arrow batch to ``BATCH_ROWS``; a lower one stays.

    Spark's 10,000 rows of texts are some 30 MB. A task holds two such batches in its worker, and
    as much and the buffers that grow to it in the executor beside the heap. The setting stays
    for the session, since the last plan of an operator is run by its caller; results do not
    depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def materialize(df: DataFrame, where: str, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as a table under ``where`` and reads it back: lineage is cut, and a lost
    executor costs nothing that was written."""
    spark = df.sparkSession
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{where}/{name}")
    return spark.read.schema(df.schema).parquet(f"{where}/{name}")


def load(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a form of it that no column of ``df`` has; Spark's names know no case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fold(doc_id, n: int):
    """crc32 of the id's decimal text modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row for each id and no nulls.

    Rows with a null id are left out, a null text counts as empty, and rows that share an
    id are one document with the least of their texts. The grouping runs only when a scan
    of the ids alone finds a repeated one.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null")
    repeated = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return out.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else out


class WordHashes(dict):
    """64-bit hash of a word, remembered while the worker lives."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


WORD_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : n + j])
    return h


def columns(batch: pa.RecordBatch, *names: str) -> list:
    """Python lists of the columns; strings come as UTF-8 bytes."""
    out = []
    for name in names:
        col = batch.column(batch.schema.get_field_index(name))
        if pa.types.is_string(col.type):
            col = col.cast(pa.binary())
        elif pa.types.is_large_string(col.type):
            col = col.cast(pa.large_binary())
        out.append(col.to_pylist())
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Numpy arrays as one compressed value; integers in the fewest bytes that hold them.

    An unsigned array in ascending order shrinks most when the caller passes its steps."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        if a.dtype.kind == "u" and len(a):
            top = int(a.max())
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        if a.dtype.itemsize == 8 and len(a) > 64:  # like bytes side by side compress better
            data, kind = a.view(np.uint8).reshape(-1, 8).T.tobytes(), a.dtype.char.upper() if a.dtype.kind == "f" else {"u": "p", "i": "q"}[a.dtype.kind]
        else:
            data, kind = a.tobytes(), {"f8": "d", "u1": "B", "u2": "H", "u4": "I", "u8": "L", "i8": "l", "i4": "i"}[a.dtype.str[1:]]
        head.append(struct.pack("<cI", kind.encode(), len(a)))
        body.append(data)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


_KINDS = {"d": "<f8", "D": "<f8", "B": "u1", "H": "<u2", "I": "<u4", "L": "<u8", "l": "<i8", "p": "<u8", "q": "<i8", "i": "<i4"}


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n, at = raw[0], 1 + 5 * raw[0]
    out = []
    for i in range(n):
        kind, size = struct.unpack_from("<cI", raw, 1 + 5 * i)
        kind = kind.decode()
        dtype = np.dtype(_KINDS[kind])
        data = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at)
        at += len(data)
        if kind in "Dpq":
            data = np.ascontiguousarray(data.reshape(8, size).T).reshape(-1)
        out.append(data.view(dtype))
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """The first value and then the differences."""
    out = ascending.copy()
    out[1:] -= ascending[:-1]
    return out


def sums(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences.astype(np.uint64), dtype=np.uint64)


def strings_of(array: pa.Array) -> list[str]:
    """``to_pylist`` of an array of strings, in one call instead of one for each value."""
    return array.to_numpy(zero_copy_only=False).tolist()


def table_of(schema: pa.Schema, rows: Iterator[tuple]) -> pa.RecordBatch:
    data = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(data or [[]] * len(schema), schema, strict=True)], schema=schema)


def heaviest(df: DataFrame, weight: str, key: str, k: int) -> DataFrame:
    """The k rows of greatest ``weight``; among equals the least keys. A histogram of at most 2,100
    rows over powers of 2**(1/16) tells which weights are in as a whole; only rows of the
    level where the k-th lies are put in order."""
    level = F.floor(F.log2(F.col(weight).cast("double")) * 16).cast("int")
    df = df.where(F.col(weight) > 0)
    room = k
    for row in sorted(df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):
        if row["n"] > room:
            return df.where(level > row["level"]).union(df.where(level == row["level"]).orderBy(F.desc(weight), key).limit(room))
        room -= row["n"]
    return df


def give_back() -> None:
    """Returns to the system what this process has freed; without this, a reused worker stays as
    large as the largest of its tasks, and the driver as what it has once collected."""
    WORD_HASHES.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do not have it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, and ``give_back`` when it has ended and its tables are gone: a worker
    that waits for its next task stays small meanwhile."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 4_000_000, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, cut further where a column of strings holds
    more than ``size`` bytes; one long text is a slice of its own."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            lengths = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)
            begin, held = 0, 0
            for i, n in enumerate(lengths.tolist()):
                if held and held + n > size:
                    yield part.slice(begin, i - begin)
                    begin, held = i, 0
                held += n
            yield part.slice(begin)


def text_chunks(batches: Iterator[pa.RecordBatch], size: int = 4_000_000, first: bool = True) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts (the first two columns) in runs of about ``size`` bytes of text; ``first``: at the
    beginning of a task."""
    if first:
        give_back()
    ids, texts, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held >= size:
                    yield ids, texts
                    ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
