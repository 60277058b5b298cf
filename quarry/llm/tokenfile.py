"""Token ids in shards of wavelet matrices.

Documents are put in ascending order of doc_id by a range partitioning; each task encodes
its share with the tokenizers library and writes shards. A shard is one row of the table of
files: for each bit of the ids, from the highest down, a plane of bits in the order to which
the planes above have sorted the ids (zeros before ones), with a directory of ranks. From
the planes alone a shard gives single ids, counts of an id and places of its occurrences,
and all ids in order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import gather
from quarry.llm.common import load, materialize, pack, shared_dir, slices, strings_of, unpack

RANK_BITS = 512
#: A multiple of the bytes of a run, so that no run lies in two blocks.
PLANE_BLOCK = 16_384
#: Shards whose starts (24 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_SHARDS = 500_000


class Plane:
    """Packed bits in blocks of PLANE_BLOCK bytes, each compressed by itself, so that a look at one
    bit opens one block."""

    def __init__(self, frames: list[bytes], size: int):
        self.frames, self.size = frames, size
        self._open: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint8))

    @classmethod
    def of(cls, packed: np.ndarray) -> Plane:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return cls([squeeze(packed[at : at + PLANE_BLOCK].tobytes()) for at in range(0, len(packed), PLANE_BLOCK)], len(packed))

    def bytes_at(self, begin: int, end: int) -> np.ndarray:
        """Bytes from ``begin`` to ``end`` of one block."""
        block = begin // PLANE_BLOCK
        if end <= begin:
            return np.zeros(0, np.uint8)
        if self._open[0] != block:
            self._open = block, np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[block]), np.uint8)
        return self._open[1][begin - block * PLANE_BLOCK : end - block * PLANE_BLOCK]

    def packed(self) -> np.ndarray:
        inflate = zstandard.ZstdDecompressor().decompress
        return np.frombuffer(b"".join(map(inflate, self.frames)), np.uint8)


class WaveletMatrix:
    """planes: the bits of each level, highest bit first; zeros: number of 0 bits in each; ranks: ones
    before each run of RANK_BITS bits of each."""

    def __init__(self, n: int, zeros: list[int], planes: list[Plane], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each run of RANK_BITS bits."""
        ones = np.bitwise_count(plane).astype(np.int64)
        step = RANK_BITS // 8
        return np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), step)))]) if len(ones) else np.zeros(1, np.int64)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = now & now.dtype.type(1 << level) != 0
            packed = np.packbits(bit)
            planes.append(Plane.of(packed))
            ranks.append(cls._directory(packed))
            low = now.compress(~bit)  # several times faster than a mask as index where bits change often
            zeros.append(len(low))
            now = np.concatenate([low, now.compress(bit)])
        return cls(len(ids), zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        """A head with the sizes of all blocks and the directories of ranks, then the blocks."""
        frames = [f for p in self.planes for f in p.frames]
        head = pack(np.array([self.n], np.int64), np.array(self.zeros, np.int64), np.array([len(f) for f in frames], np.uint64), *(r.astype(np.uint64) for r in self.ranks))
        return struct.pack("<I", len(head)) + head + b"".join(frames)

    @classmethod
    def from_bytes(cls, value: bytes) -> WaveletMatrix:
        (size,) = struct.unpack_from("<I", value)
        n, zeros, lengths, *ranks = unpack(value[4 : 4 + size])
        ends = 4 + size + np.cumsum(lengths.astype(np.int64))
        frames = [value[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
        each, whole = len(frames) // len(zeros), -(-int(n[0]) // 8)
        planes = [Plane(frames[i * each : (i + 1) * each], whole) for i in range(len(zeros))]
        return cls(int(n[0]), zeros.tolist(), planes, [r.astype(np.int64) for r in ranks])

    def _rank1(self, level: int, i: int) -> int:
        plane, run = self.planes[level], i // RANK_BITS
        first = run * RANK_BITS // 8
        held = plane.bytes_at(first, min(plane.size, i // 8 + 1))
        whole = i // 8 - first
        ones = int(self.ranks[level][run]) + int(np.bitwise_count(held[:whole]).sum())
        return ones + (int(held[whole] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane.bytes_at(i // 8, i // 8 + 1)[0]) >> (7 - i % 8) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _narrow(self, value: int, end: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        lo, hi = 0, end
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (len(self.planes) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, end: int) -> int:
        """Occurrences of ``value`` among the first ``end`` ids."""
        lo, hi = self._narrow(value, end)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        lo, hi = self._narrow(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = i >= self.zeros[level]
            want = i - self.zeros[level] if one else i
            low, high = 0, self.n  # first position with more than ``want`` bits of this kind up to it
            while low < high:
                mid = (low + high) // 2
                ones = self._rank1(level, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            i = low
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].packed(), count=self.n).view(bool)
            before = np.empty(self.n, kind)
            before[np.flatnonzero(~bit)] = now[: self.zeros[level]]
            before[np.flatnonzero(bit)] = now[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            now = before
        return now


#: Characters that Python calls white space, and two of the texts that may be joined: parts that a space
#: begins and no white space ends; parts of signs that every version of Unicode sorts alike into
#: letters, numbers, white space and others (without the space before them).
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_APART = rf"(?s)^ [^{_WHITE}](.*[^{_WHITE}])?$"
_PLAIN = r"^[!-~\x{a1}-\x{24f}]([\t\n\r!-~\x{a1}-\x{24f}]*[!-~\x{a1}-\x{24f}])?$"
#: Strings that a table of strings holds between slices, in bytes.
KNOWN_BYTES = 100_000_000
#: Strings whose ids are put in a row at once, since that takes a multiple of their memory.
GATHERED = 500_000


class Known:
    """Ids of strings, remembered up to ``bound`` strings; ``make`` gives ids and lengths of new ones. Arrow
    numbers the known strings and those of a slice in one call, so that known ones become no Python
    strings. When there are too many, the half that most slices asked for stays."""

    def __init__(self, bound: int, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.bound, self.make = bound, make
        self.names = pa.array([], pa.large_string())
        self.flat, self.starts, self.used = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def ids(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings in a row, and how many each has."""
        if not len(strings):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        own = strings.dictionary_encode()
        coded = pa.chunked_array([self.names, own.dictionary]).dictionary_encode().chunks[-1]
        new = coded.dictionary.slice(len(self.names))
        if len(new):
            flat, lengths = self.make(new)
            flat, starts, used = np.concatenate([self.flat, flat]), np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)]), np.concatenate([self.used, np.zeros(len(new), np.int32)])
            self.names, self.flat, self.starts, self.used = coded.dictionary, flat, starts, used  # together: a worker lives on after a task that failed
        rows, at = coded.indices.to_numpy(), own.indices.to_numpy()
        self.used[rows] += 1
        flat, lengths = gather(self.flat, self.starts, rows)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        ids = [gather(flat, starts, at[begin : begin + GATHERED])[0] for begin in range(0, len(at), GATHERED)]
        while len(self.names) > self.bound or self.names.nbytes > KNOWN_BYTES:
            self.shrink(min(len(self.names), self.bound) // 2)
        return np.concatenate(ids), lengths[at]

    def shrink(self, to: int) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[:to])
        self.names = self.names.take(pa.array(keep))
        self.flat, lengths = gather(self.flat, self.starts, keep)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.used = self.used[keep] // 2


def merged(first: np.ndarray, some: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of strings in their order, from those of the strings that ``first`` marks and of the others."""
    lengths = np.empty(len(first), np.int64)
    lengths[first], lengths[~first] = some[1], others[1]
    ids = np.empty(len(some[0]) + len(others[0]), np.uint32)
    at = np.repeat(first, lengths)
    ids[at], ids[~at] = some[0], others[0]
    return ids, lengths


class LibraryEncoder:
    """Ids as the tokenizers library gives them. Texts are cut into parts that no match of the pattern
    crosses. The library is asked once for each part, and where a part is plain, once for each
    match in it: most new parts are known words beside other signs. A text that holds the string
    of an added token goes to it as a whole. ``bound`` and ``words``: parts and matches that are
    remembered."""

    def __init__(self, name: str, bound: int = 700_000, words: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of each token: the alphabet of the vocabulary has one character for each byte.
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.parts, self.words = Known(bound, self._parts), Known(words, self._asked)

    def _ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(lengths.sum())), lengths

    def _lengths(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many of ``ids`` each of several strings has, from their sizes in bytes and those of the tokens."""
        return np.diff(np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes), side="right"), prepend=0)

    def _asked(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Strings that a space begins and no white space ends stay apart when they are joined, so the
        library gets many in one."""
        apart = pc.match_substring_regex(strings, _APART)
        some = strings.filter(apart)
        together = strings_of(some)
        ids, _ = self._ids(["".join(together[at : at + 200]) for at in range(0, len(together), 200)])
        return merged(apart.to_numpy(zero_copy_only=False), (ids, self._lengths(ids, pc.binary_length(some).to_numpy())), self._ids(strings_of(strings.filter(pc.invert(apart)))))

    def _parts(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Plain parts stay apart when they are joined, so the pattern cuts them as one text."""
        plain = pc.match_substring_regex(keys, _PLAIN)
        some, others = keys.filter(plain), strings_of(keys.filter(pc.invert(plain)))
        words = self.pattern.findall(" " + " ".join(strings_of(some))) if len(some) else []
        ids, _ = self.words.ids(pa.array(words, pa.large_string()))
        rest = self._asked(pa.array([k[1:] if k[:1] == " " else " " + k for k in others], pa.large_string()))
        return merged(plain.to_numpy(zero_copy_only=False), (ids, self._lengths(ids, pc.binary_length(some).to_numpy() + 1)), rest)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The key of a part that single spaces cut off is the part without its space; the key of any
        other is a space and the part."""
        texts = texts.cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        # a space after other white space does not always begin a match
        odd = pc.match_substring_regex(texts, f"[{_WHITE}] ").to_numpy(zero_copy_only=False)
        even, uneven = np.flatnonzero(~odd & ~whole), np.flatnonzero(odd & ~whole)
        lists = pc.split_pattern(texts.take(pa.array(even)), " ")
        keys, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.zeros(len(keys), bool)
        begins[np.cumsum(counts) - counts] = True
        begins = pa.array(begins)
        keys = pc.replace_with_mask(keys, begins, pa.array([" " + part for part in strings_of(keys.filter(begins))], pa.large_string()))
        found = [pa.array([" " + part for part in self.pattern.findall(texts[i].as_py())], pa.large_string()) for i in uneven.tolist()]
        ids, lengths = self.parts.ids(pa.concat_arrays([keys, *found]))
        counts = np.concatenate([counts, np.fromiter(map(len, found), np.int64, len(found))])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        begin, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        order = np.concatenate([even, uneven])
        begin[order], end[order] = ends[:-1], ends[1:]
        for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            yield np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) if whole[i] else ids[a:b]


@lru_cache(maxsize=1)
def encoder(name: str) -> LibraryEncoder:
    return LibraryEncoder(name)


def write_shards(docs: DataFrame, where: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, shard_ids: int = 4_000_000, name: str = "shards") -> DataFrame:
    """Writes the files and returns their table: part and seq (their order), doc_ids and lengths
    (the documents inside), n (ids), matrix. A document stays in one shard. Null texts are
    empty, rows with a null id come first, rows with equal ids next to each other in order of
    their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os_environ()
        part, seq = TaskContext.get().partitionId(), 0
        library = encoder(tokenizer)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []
        held, end = 0, np.array([end_id], np.uint32)

        def shard() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(ids))
            documents = pack(np.array([x is None for x in names], np.uint8), np.array([x or 0 for x in names], np.int64), np.array(lengths, np.uint64))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n": pa.array([held], pa.int64()), "documents": pa.array([documents], pa.binary()), "matrix": pa.array([matrix.to_bytes()], pa.binary())})

        for rows in slices(batches, 1, 20_000_000, 10_000):  # each slice numbers the known parts anew
            for doc_id, found in zip(rows.column(0).to_pylist(), library.encode(rows.column(1)), strict=True):
                names.append(doc_id)
                ids += [found, end]
                lengths.append(len(found) + 1)
                held += len(found) + 1
                if held >= shard_ids:
                    yield shard()
                    ids, names, lengths, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    shown = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shown.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "part int, seq int, n long, documents binary, matrix binary"), where, name)


def os_environ() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone. ``start``
    comes from running sums over the table of shards, which has one short row for each; up to
    ``BROADCAST_SHARDS`` of them the starts are broadcast, so that no matrix is shuffled."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", "n").withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    if shards.select("part").count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, documents, matrix in zip(*(batch.column(i) for i in range(3)), strict=True):
                missing, doc_ids, lengths = unpack(documents.as_py())
                lengths = lengths.astype(np.int64)
                ids = WaveletMatrix.from_bytes(matrix.as_py()).ids().astype("<u4")
                begin = np.cumsum(lengths) - lengths
                crcs = [zlib.crc32(ids[a : a + n]) for a, n in zip(begin.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64(), mask=missing.astype(bool)), "start": pa.array(begin + start.as_py()), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crcs, pa.int64())})

    return shards.join(starts, ["part", "seq"]).select("start", "documents", "matrix").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(shards: DataFrame, token: int, limit: int) -> DataFrame:
    """(part, seq, n_found, places): how often an id stands in each shard, and its first
    ``limit`` places there, by rank and select on the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                matrix = WaveletMatrix.from_bytes(value)
                found = matrix.rank(token, matrix.n)
                places = [matrix.select(token, k) for k in range(min(found, limit))]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_found": pa.array([found], pa.int64()), "places": pa.array([places], pa.list_(pa.int64()))})

    return shards.select("part", "seq", "matrix").mapInArrow(run, "part int, seq int, n_found long, places array<long>")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(load(spark, sf_dir), shared_dir(spark)))
