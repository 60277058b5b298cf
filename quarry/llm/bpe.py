"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut into parts that the pre-tokenizer never joins, mostly at single spaces. The
parts of the whole corpus are counted, and the most frequent ones, a fixed number, are encoded
together: each distinct pre-token once, as a row of byte symbols in one long array of its
shard. An inverted index leads from the rank of a token pair to the positions where it stands.
Merges are applied in rank order to all words at once; a merge touches the positions its
index entry names and their neighbours, whose new pairs enter the index. The ids are those
that the lowest-rank-first, leftmost-first rule gives for each word by itself.

The table of these parts is broadcast. The texts are then read once more and looked up; what
the table does not hold is remembered by each worker, and the replay runs over the new
pre-tokens of several slices of texts at once: it visits each rank that stands in them, and
these are hardly more in many words than in few. Texts never leave their partition, and memory
is that of a slice, of the places in the table of the slices that wait, and of tables of fixed size.

A null text is encoded as an empty one, which has no ids. Rows that repeat, null ids and
further columns need no special care: there is one result for each row; very long texts are
encoded whole, and an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import free_name, give_back, giving_back, heaviest, load, materialize, shared_dir, short_batches, slices, strings_of

NONE = np.int64(1) << 40
#: Of texts that are counted or encoded at once. What a worker needs beside its tables is about
#: 25 times as much.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 1_000
#: What slices hold together when their new parts are replayed: new parts, and parts and rows in all.
NEW_PARTS, WAITING_PARTS = 200_000, 4_000_000
#: Parts of one replay.
REPLAY_PARTS = 100_000
_SPACE_BEFORE_SPACE = re.compile(r"\s ")


def crosses(text: str) -> bool:
    """Whether a match of the pre-tokenizer pattern may cross a single space. A space between two
    characters that are no white space always starts a match of its own; not so one that stands
    after other white space."""
    return "  " in text or "\n " in text or "\t " in text or "\r " in text or ((not text.isascii() or "\x0b " in text or "\x0c " in text or any(c in text for c in "\x1c\x1d\x1e\x1f")) and _SPACE_BEFORE_SPACE.search(text) is not None)


def parts_of(texts: pa.Array, pattern: regex.Pattern, skip: list[bool] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The parts of texts (a part may stand twice), the place in that list of every part in order, and where the parts
    of each text begin (one more entry at the end). No match of the pattern crosses from one
    part to the next, so equal parts have equal ids. ``skip`` marks texts to leave without parts."""
    strings = strings_of(texts)
    odd = np.fromiter(map(crosses, strings), bool, len(strings))
    out = np.array(skip, bool) if skip is not None else np.zeros(len(strings), bool)
    plain = np.flatnonzero(~odd & ~out)
    lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
    values = lists.flatten()
    counts = np.zeros(len(strings), np.int64)
    counts[plain] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = values.dictionary_encode()
    names = strings_of(pc.binary_join_element_wise(pa.scalar(" ", values.type), coded.dictionary, pa.scalar("", values.type)))
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # the first part of a text has no space before it
    codes = _Codes()
    first = np.cumsum(counts[plain]) - counts[plain]
    at[first] = np.fromiter(map(codes.__getitem__, strings_of(values.take(pa.array(first)))), np.int64, len(first)) + len(names)
    found = [np.fromiter(map(codes.__getitem__, x := pattern.findall(strings[i])), np.int64, len(x)) + len(names) for i in np.flatnonzero(odd & ~out)]
    names += list(codes)
    if found:
        counts[odd & ~out] = [len(x) for x in found]
        begin = np.cumsum(counts) - counts
        whole = np.empty(int(counts.sum()), np.int64)
        whole[np.repeat(begin[plain] - first, counts[plain]) + np.arange(len(at))] = at
        for i, x in zip(np.flatnonzero(odd & ~out), found, strict=True):
            whole[begin[i] : begin[i] + len(x)] = x
        at = whole
    return names, at, np.concatenate([[0], np.cumsum(counts)])


class Merges:
    """Ranks of a vocabulary in the forms that the replay uses."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = size
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.lengths = np.array([len(t) for t in self.tokens], np.int32)
        self.of_bytes = self.rank_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))  # of each two bytes
        #: Ranks whose token can at once stand in a pair of lower rank.
        left, right = self.keys // size, self.keys % size
        self.turning = set(left[self.values < left].tolist()) | set(right[self.values < right].tolist())

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the vocabulary lacks it."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's begin (one more entry at the end)."""
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.byte_ids[text]
        word = np.repeat(np.arange(len(words)), lengths)
        after = np.arange(1, n + 1)
        after[ends[lengths > 0] - 1] = n  # n: no neighbour
        before = np.arange(-1, n - 1)
        before[(ends - lengths)[lengths > 0]] = -1
        alive = np.ones(n + 1, bool)
        alive[n] = False
        pending: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def note(ranks: np.ndarray, at: np.ndarray) -> None:
            known = ranks < NONE
            ranks, at = ranks[known], at[known]
            if not len(ranks):
                return
            by = np.argsort(ranks.astype(np.uint16) if self.size <= 1 << 16 else ranks, kind="stable")
            ranks, at = ranks[by], at[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, p in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r in pending:
                    pending[r].append(p)
                else:
                    pending[r] = [p]
                    heapq.heappush(order, r)

        first = np.flatnonzero(after < n)
        note(self.of_bytes[text[first].astype(np.int64) * 256 + text[first + 1]], first)
        while order:
            rank = heapq.heappop(order)
            found = pending.pop(rank)
            at = distinct(np.concatenate(found))
            at = at[alive[at]]
            right = after[at]
            there = right < n
            at, right = at[there], right[there]
            # where the rank once stood, its bytes stand; two tokens over just these make it still
            fits = self.lengths[symbol[at]] + self.lengths[symbol[right]] == self.lengths[rank]
            at = at[fits]
            if not len(at):
                continue
            if rank in self.turning:  # a lower rank may come up: one position of each word at a time
                leftmost = np.concatenate([[True], word[at][1:] != word[at][:-1]])
                if not leftmost.all():
                    pending[rank] = [at[~leftmost]]
                    heapq.heappush(order, rank)
                at = at[leftmost]
            elif (chained := after[at[:-1]] == at[1:]).any():  # overlapping pairs: every second from the left
                begins = np.concatenate([[True], ~chained])
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            gone = after[at]
            alive[gone] = False
            symbol[at] = rank
            beyond = after[gone]
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            left = before[at]
            touched = distinct(np.concatenate([left[left >= 0], at[inner]]))
            note(self.rank_of(symbol[touched], symbol[after[touched]]), touched)
        kept = np.flatnonzero(alive[:n])
        counts = np.bincount(word[kept], minlength=len(words))
        return symbol[kept], np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def gather(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array one after another, and their lengths."""
    begin = starts[rows]
    lengths = starts[rows + 1] - begin
    total = int(lengths.sum())
    if not total:
        return flat[:0], lengths
    shift = begin - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(total)], lengths


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


@lru_cache(maxsize=2)
def merges(name: str) -> Merges:
    return Merges(public_tokenizers.path(name))


class _Codes(dict):
    def __missing__(self, unit: str) -> int:
        self[unit] = code = len(self)
        return code


class Memo:
    """Ids of strings, remembered up to a bound. When it is full, the half that most slices asked
    for stays; the first ``pinned`` strings always stay."""

    def __init__(self, bound: int, known: tuple[list[str], np.ndarray, np.ndarray] | None = None):
        names, flat, starts = known or ([], np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self.codes = dict(zip(names, range(len(names)), strict=True))
        self.flat, self.starts = flat, starts
        self.pinned, self.bound = len(names), len(names) + bound
        self.used = np.zeros(len(names), np.int32)

    def shrink(self) -> None:
        order = np.argsort(-self.used[self.pinned :], kind="stable")[: (self.bound - self.pinned) // 2]
        keep = np.concatenate([np.arange(self.pinned), np.sort(order) + self.pinned])
        names = list(self.codes)
        self.flat, lengths = gather(self.flat, self.starts, keep)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.codes = dict(zip((names[i] for i in keep.tolist()), range(len(keep)), strict=True))
        self.used = self.used[keep] // 2

    def look_up(self, strings: list[str], bounded: bool = False) -> np.ndarray:
        """Rows of strings; new ones have theirs in (flat, starts) after ``fill``. ``bounded``: other strings
        make room for them now."""
        at = np.fromiter(map(self.codes.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(at < 0)
        if bounded and len(new) and len(self.codes) + len({strings[i] for i in new.tolist()}) > self.bound:
            self.shrink()
            return self.look_up(strings)
        if len(new):
            again = [strings[i] for i in new.tolist()]
            fresh = dict.fromkeys(again)
            self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh)), strict=True))
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int32)])
            at[new] = np.fromiter(map(self.codes.__getitem__, again), np.int64, len(again))
        self.used[at] += 1
        return at

    def waiting(self) -> int:
        """Number of strings that have no ids yet."""
        return len(self.codes) + 1 - len(self.starts)

    def fill(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], at_once: int = REPLAY_PARTS) -> None:
        """``make`` gives ids and lengths of the strings that wait for them, ``at_once`` together at most."""
        names = list(islice(self.codes, len(self.starts) - 1, None))
        made = [make(names[i : i + at_once]) for i in range(0, len(names), at_once)]
        self.flat = np.concatenate([self.flat, *(ids.astype(np.uint32) for ids, _ in made)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *(x for _, x in made)]))])

    def find(self, strings: list[str], make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Rows of (flat, starts) of strings; ``make`` gives ids and lengths of new ones."""
        at = self.look_up(strings, bounded=True)
        if self.waiting():
            self.fill(make)
        return at


class Encoder:
    """Ids of texts by their parts. A part is looked up; ``encode_parts`` gives the ids and lengths of
    new ones."""

    def __init__(self, pattern: str, encode_parts: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bound: int, known=None):
        self.pattern = regex.compile(pattern)
        self.encode_parts = encode_parts
        self.parts = Memo(bound, known)

    def ragged(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the named parts in a row, and where each begins."""
        rows = self.parts.find(names, self.encode_parts)
        flat, lengths = gather(self.parts.flat, self.parts.starts, rows)
        return flat, np.concatenate([[0], np.cumsum(lengths)])

    def encode(self, texts: pa.Array, skip: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more entry at the end)."""
        names, at, begin = parts_of(texts, self.pattern, skip)
        ids, lengths = gather(*self.ragged(names), at)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[begin]

    def encode_all(self, slices: Iterator[tuple[list, pa.Array]]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """What stands beside the texts of each slice, and ``encode`` of these. Slices wait until they have
        ``NEW_PARTS`` new parts together, which are then encoded at once."""
        held, size = [], 0
        for beside, texts in slices:
            names, at, begin = parts_of(texts, self.pattern)
            held.append((beside, self.parts.look_up(names).astype(np.int32)[at], begin))
            size += len(at) + len(texts)
            if self.parts.waiting() > NEW_PARTS or size > WAITING_PARTS:
                yield from self._settled(held)
                held, size = [], 0
        yield from self._settled(held)

    def _settled(self, held: list[tuple[list, np.ndarray, np.ndarray]]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        if self.parts.waiting():
            self.parts.fill(self.encode_parts)
        for beside, at, begin in held:
            ids, lengths = gather(self.parts.flat, self.parts.starts, at)
            yield beside, ids, np.concatenate([[0], np.cumsum(lengths)])[begin]
        if len(self.parts.codes) > self.parts.bound:
            self.parts.shrink()


def replayed(vocabulary: Merges, pattern: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of parts by one replay over their distinct pre-tokens."""
    compiled = regex.compile(pattern)

    def encode_parts(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = _Codes(), np.zeros(len(parts), np.int64)
        # between two characters that are no white space, a space starts a match: such parts are matched as one text
        plain = np.fromiter((len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace() for p in parts), bool, len(parts))
        joined = list(compress(parts, plain))
        found = compiled.findall("".join(joined))
        ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        counts[plain] = np.diff(np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), ends, "right"), prepend=0)
        others = [compiled.findall(p) for p in compress(parts, ~plain)]
        counts[~plain] = np.fromiter(map(len, others), np.int64, len(others))
        row = np.empty(int(counts.sum()), np.int64)
        of_plain = np.repeat(plain, counts)
        row[of_plain] = np.fromiter(map(codes.__getitem__, found), np.int64, len(found))
        row[~of_plain] = np.fromiter(map(codes.__getitem__, chain.from_iterable(others)), np.int64, int(counts[~plain].sum()))
        ids, starts = vocabulary.replay([p.encode("utf-8", "surrogatepass") for p in codes])
        flat, lengths = gather(ids.astype(np.uint32), starts, row)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(ends)

    return encode_parts


def count_parts(docs: DataFrame, pattern: str, text_col: str) -> DataFrame:
    """(part, n) over all texts; summed within a task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, held = regex.compile(pattern), {}
        for batch in slices(batches, 0, SLICE_BYTES, SLICE_ROWS):
            names, at, _ = parts_of(pc.fill_null(batch.column(0), ""), compiled)
            for name, n in zip(names, np.bincount(at, minlength=len(names)).tolist(), strict=True):
                held[name] = held.get(name, 0) + n
            if len(held) > 100_000:
                yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
                held = {}
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    return docs.select(text_col).mapInArrow(giving_back(run), "part string, n long").where("n > 0").groupBy("part").agg(F.sum("n").alias("n"))


def corpus_table(docs: DataFrame, vocabulary: str, pattern: str, text_col: str, table_parts: int, shard_parts: int = 50_000) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ``table_parts`` most frequent parts of a corpus with their ids: (parts, ids in a row, where
    each begins). Shards of parts are replayed, each in one array."""
    where = shared_dir(docs.sparkSession)
    counted = materialize(count_parts(docs, pattern, text_col), where, "parts")
    shards = max(1, -(-min(table_parts, counted.count()) // shard_parts))

    def replay(table: pa.Table) -> pa.Table:
        give_back()
        parts = table.column("part").to_pylist()
        ids, lengths = replayed(merges(vocabulary), pattern)(parts)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        return pa.table({"part": pa.array(parts, pa.string()), "ids": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))})

    kept = heaviest(counted.where(F.length("part") <= 64), "n", "part", table_parts).select("part", F.pmod(F.xxhash64("part"), F.lit(shards)).cast("int").alias("shard"))
    made = materialize(kept.groupBy("shard").applyInArrow(replay, "part string, ids array<int>"), where, "table").toArrow().combine_chunks()
    ids = made.column("ids").combine_chunks() if made.num_rows else pa.array([], pa.list_(pa.int32()))
    lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    return made.column("part").combine_chunks() if made.num_rows else pa.array([], pa.string()), ids.flatten().to_numpy().astype(np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def with_ids(docs: DataFrame, fn, schema: str, columns: list[str], vocabulary: str, pattern: str, text_col: str = "text", table_parts: int = 1 << 17) -> DataFrame:
    """Encodes ``text_col`` slice by slice; ``fn(vocabulary, ids)`` gives the values of a row."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(corpus_table(docs, vocabulary, pattern, text_col, table_parts))
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = merges(vocabulary)
        parts, flat, starts = shared.value
        encoder = Encoder(pattern, replayed(words, pattern), 100_000, (parts.to_pylist(), flat, starts))
        cut = slices(batches, len(columns), SLICE_BYTES, SLICE_ROWS)
        for beside, ids, begin in encoder.encode_all((batch.columns[: len(columns)], batch.column(len(columns))) for batch in cut):
            made = list(zip(*(fn(words, ids[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)), strict=True)) or [()] * len(fn.columns)
            yield pa.RecordBatch.from_arrays([*beside, *(pa.array(x, kind) for x, (_, kind) in zip(made, fn.columns, strict=True))], names=[*columns, *(name for name, _ in fn.columns)])

    kept = docs.select(*[F.col(c) for c in columns], F.coalesce(F.col(text_col), F.lit("")).alias(free_name(docs, "whole_text")))
    return kept.mapInArrow(giving_back(run), schema)


class _Ids:
    columns = [("ids", pa.list_(pa.int32()))]

    def __call__(self, words: Merges, ids: np.ndarray):
        return (ids.astype(np.int32),)


class _Digests:
    columns = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def __call__(self, words: Merges, ids: np.ndarray):
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(words.decode(ids)).hexdigest()


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) for each row of ``docs``; ``ids`` is empty for a null or empty text."""
    return with_ids(docs, _Ids(), "doc_id long, ids array<int>", ["doc_id"], vocabulary, pattern)


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, bytes): the exact inverse of ``encode``. Null ids give a null value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = merges(vocabulary)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if r is None else words.decode(np.array(r, np.int64)) for r in rows], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Number of ids, SHA-256 of the ids as little-endian 32-bit integers, and SHA-256 of the
    bytes decoded from them, for each row of ``docs``."""
    return with_ids(docs, _Digests(), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"], vocabulary, pattern)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document."""
    return with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _IdsAndDigest(), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", ["doc_id"], "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN)


class _IdsAndDigest:
    columns = [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())]

    def __call__(self, words: Merges, ids: np.ndarray):
        return len(ids), ids.astype(np.int32), hashlib.sha256(words.decode(ids)).hexdigest()
