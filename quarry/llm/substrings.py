"""Removal of repeated passages with sharded phrase automata.

A passage repeats where ``window`` consecutive words stand in two documents. Three passes:

1. Anchors. Each window names the least hash among its short word runs; equal windows name
   equal anchors, and neighbouring windows mostly the same one. Anchors that two documents
   share set bits in a filter of fixed size, each bucket of hashes in its own slice. The
   filter is the only thing broadcast; its size is a parameter and does not grow with the
   input. Bits set by chance cost some more work below, never a wrong result.
2. Automata. The words around each anchor in the filter go to the shard of the anchor, equal
   ones of a chunk of documents once. A shard confirms by their words the phrases that two
   documents share, compiles them into an Aho-Corasick automaton whose values are the
   smallest ids, spelled so that paths are short and branches few, and streams all its
   segments through it. So every occurrence in every document is found, and each document
   meets only the automata that can match it.
3. Removal. Found windows are brought to their documents by id.

Work grows with the text and with the repeated part of it; a passage shared by very many
documents costs one segment for each chunk and one entry for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import keyed_texts, load, mix, pack, power_of_two, shared_dir, materialize, shingle_hashes, shuffle_partitions, steps, sums, text_chunks, unpack, word_hashes
from quarry.llm.sieve import Sieve

RUN = 5
#: Different anchors whose segments meet in one shard; there are as many shards as this takes.
SHARD_ANCHORS = 1 << 16
#: Different words (or digits) that one automaton can tell apart: one character each, surrogates
#: left out, and one for all words outside its phrases.
CHARACTERS = 0x10FFFF - 0x800 - 1
#: Digits in which an automaton spells a run of words.
DIGITS = 2
HIT = np.dtype([("word", np.int64), ("doc", np.int64)])


class Numbers(dict):
    """Numbers of values in the order in which they first come."""

    def __missing__(self, value: bytes) -> int:
        self[value] = n = len(self)
        return n

    def of(self, values: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, values), np.int64, len(values))


def anchors(words: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, last window) of each run of windows with one anchor.
    ``doc`` numbers the document of each word; windows do not cross documents."""
    run = min(RUN, window)
    if window - run > 15:
        raise ValueError(f"windows have at most {RUN + 15} words: places within one are kept in four bits")
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the low four bits carry the position, so that one minimum gives the hash and the place
    low = np.uint64(15)
    least = (shingle_hashes(words, run) & ~low) | (np.arange(len(words) - run + 1, dtype=np.uint64) & low)
    width = 1
    while width < (span := window - run + 1):
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = least[at]
    where = at + (((least & low).astype(np.int64) - at) & 15)
    best = least & ~low
    new = np.concatenate([[True], (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return best[first], at[first], at[last]


def _words_of(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    hashes = np.concatenate([word_hashes(w) for w in split]) if split else np.zeros(0, np.uint64)
    return split, hashes, np.repeat(np.arange(len(split)), counts)


def shared_anchors(texts: DataFrame, window: int, filter_bits: int) -> tuple[Sieve, int]:
    """The filter of the anchors that stand in two documents or more, and how many different
    anchors of the texts it lets through, those set by chance included."""
    slices = power_of_two(2 * shuffle_partitions(texts.sparkSession))
    out = Sieve(slices, max(1024, filter_bits // slices))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in text_chunks(batches):
            _, words, doc = _words_of(rows)
            hashes, first, _ = anchors(words, doc, window)
            if not len(hashes):
                continue
            owner = doc[first]
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            start = np.flatnonzero(new)
            several = np.maximum.reduceat(owner, start) != owner[start]
            hashes = hashes[start]
            part = out.slice_of(hashes)
            cuts = np.flatnonzero(np.diff(part)) + 1
            ids = part[np.concatenate([[0], cuts])]
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array(ids, pa.int32()), "found": pa.array([pack(steps(h), np.packbits(s)) for h, s in zip(np.split(hashes, cuts), np.split(several, cuts), strict=True)], pa.binary())}
            )

    def merge(table: pa.Table) -> pa.Table:
        hashes, several = [], []
        for value in table.column("found").to_pylist():
            h, s = unpack(value)
            hashes.append(sums(h))
            several.append(np.unpackbits(s, count=len(h)).astype(bool))
        every, known = np.concatenate(hashes), np.concatenate(several)
        values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        counts[inverse[known]] += 1
        twice = values[counts > 1]
        bits = out.slice_bits(twice)
        return pa.table({"slice": pa.array(table.column("slice").to_pylist()[:1], pa.int32()), "bits": pa.array([bits], pa.binary()), "passing": pa.array([out.passing(bits, values)], pa.int64())})

    found = texts.mapInArrow(emit, "slice int, found binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary, passing long")
    passing = 0
    for row in found.toLocalIterator():
        out.data[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
        passing += row["passing"]
    return out, passing


def segments(texts: DataFrame, shared: Sieve, window: int, shards: int) -> DataFrame:
    """(shard, packed): for each chunk of documents and shard the different word sequences around
    anchors, and where they stand."""
    spread = texts.sparkSession.sparkContext.broadcast(shared)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in text_chunks(batches):
            split, words, doc = _words_of(rows)
            hashes, first, last = anchors(words, doc, window)
            keep = spread.value.has(hashes)
            hashes, first, last = hashes[keep], first[keep], last[keep]
            if not len(hashes):
                continue
            owner = doc[first]
            begin = np.searchsorted(doc, np.arange(len(rows)))
            first, last = first - begin[owner], last - begin[owner]
            shard = (mix(hashes) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            packed, names = [], []
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                seen: dict[bytes, int] = {}
                which = np.zeros(len(part), np.uint64)
                for i, j in enumerate(part.tolist()):
                    which[i] = seen.setdefault(b" ".join(split[owner[j]][first[j] : last[j] + window]), len(seen))
                owners, local = np.unique(owner[part], return_inverse=True)
                blob = np.frombuffer(b"\n".join(seen), np.uint8)
                packed.append(pack(np.array([ids[o] for o in owners], np.int64), local.astype(np.uint64), first[part].astype(np.uint64), which, blob))
                names.append(int(shard[part[0]]))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(names, pa.int32()), "packed": pa.array(packed, pa.binary())})

    return texts.mapInArrow(emit, "shard int, packed binary")


def runs(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, first word) of each run of ``size`` words within one sequence, in order; ``starts``:
    where each sequence begins (and an end)."""
    counts = np.maximum(np.diff(starts) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))


def alike(flat: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the runs of ``size`` words from ``at`` with equal ones side by side, and which
    of them differ from the one before; hashes find equal runs, their words confirm them."""
    hashes = shingle_hashes(mix(flat.astype(np.uint64)), size)[at]
    order = np.argsort(hashes, kind="stable")
    words = flat[at[order][:, None] + np.arange(size)]
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (words[1:] != words[:-1]).any(axis=1)])
    if (np.diff(hashes[order]) == 0).sum() != (~new).sum():  # equal hashes, other words: order by the words
        order = np.lexsort(flat[at[:, None] + np.arange(size)].T)
        words = flat[at[order][:, None] + np.arange(size)]
        new = np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])
    return order, new


def shared_phrases(flat: np.ndarray, starts: np.ndarray, least: np.ndarray, most: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, smallest id) of each phrase that two documents share, once, and the sequence
    numbers that hold one. ``flat``: words of all sequences, ``starts`` where each begins (and an
    end), ``least`` and ``most`` the smallest and largest id that has each sequence."""
    owner, at = runs(starts, window)
    if not len(at):
        return at, at, at
    order, new = alike(flat, at, window)
    begin = np.flatnonzero(new)
    low = np.minimum.reduceat(least[owner[order]], begin)
    shared = low < np.maximum.reduceat(most[owner[order]], begin)
    holds = np.repeat(shared, np.diff(np.concatenate([begin, [len(order)]])))
    return at[order][begin[shared]], low[shared], np.unique(owner[order][holds])


def spelled(flat: np.ndarray, starts: np.ndarray, held: np.ndarray, firsts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The sequences ``held`` as one line of numbers, the word where a phrase begins that begins at
    each (-1: none does), where the phrases that begin at the words ``firsts`` begin in the line,
    and how many numbers a phrase takes.

    A node of an automaton looks through its branches one by one, and each phrase adds a path, so
    phrases are spelled with few letters and letters in few digits. A letter stands for a run of
    about RUN words, equal ones for equal runs; those of a phrase meet or overlap and cover it.
    Each sequence is read in steps from all of the first words of a step, so that the letters of
    any phrase are neighbours. A digit tells its place in the letter; letters that no phrase has
    are -1, as is what parts the readings."""
    count = min(window, max(2, -(-window // RUN)))
    step = window // count
    size = window - (count - 1) * step
    owner, at = runs(starts, size)
    keep = np.isin(owner, held)
    at, owner = at[keep], np.searchsorted(held, owner[keep])
    order, new = alike(flat, at, size)
    letters = np.empty(len(at), np.int64)
    letters[order] = np.cumsum(new) - 1
    counts = np.diff(starts)[held] - size + 1
    base = np.cumsum(counts + step) - counts - step
    place = at - starts[held][owner]
    phase = place % step
    place = base[owner] + phase * (counts[owner] // step + 1) + np.minimum(phase, counts[owner] % step) + place // step
    line, home = np.full(int((counts + step).sum()), -1), np.full(int((counts + step).sum()), -1)
    line[place], home[place] = letters, at
    begin = place[np.searchsorted(at, firsts)]
    used = np.zeros(len(letters) + 1, bool)
    used[line[begin[:, None] + np.arange(count)]] = True
    line = np.where(used, np.cumsum(used) - 1, -1)[line]
    radix = max(2, int(np.ceil(used.sum() ** (1 / DIGITS))))
    digits = np.stack([np.where(line < 0, -1, line // radix**i % radix + i * radix) for i in range(DIGITS)], axis=1).ravel()
    return digits, np.where(np.arange(len(digits)) % DIGITS == 0, np.repeat(home, DIGITS), -1), begin * DIGITS, count * DIGITS


def automaton(text: str, firsts: np.ndarray, lows: np.ndarray, window: int) -> ahocorasick.Automaton:
    """Phrases as keys, one character for each word (or letter), with the smallest id that holds each."""
    out = ahocorasick.Automaton()
    for at, low in zip(firsts.tolist(), lows.tolist(), strict=True):
        out.add_word(text[at : at + window], low)
    out.make_automaton()
    return out


def as_text(words: np.ndarray, used: np.ndarray) -> str:
    """A character for each word of ``used`` (ascending, at most CHARACTERS), one for all others;
    surrogates are stepped over."""
    at = np.searchsorted(used, words)
    codes = np.where(np.append(used, -1)[at] == words, at + 2, 1)
    codes = codes + np.where(codes >= 0xD800, 0x800, 0)
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def phrase_batches(flat: np.ndarray, firsts: np.ndarray, window: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Runs of phrases whose words one automaton can tell apart, and these words: most often one
    run of all phrases."""
    used = np.unique(flat[firsts[:, None] + np.arange(window)])
    if len(used) <= CHARACTERS:
        yield slice(0, len(firsts)), used
        return
    size = max(1, CHARACTERS // window)
    for i in range(0, len(firsts), size):
        yield slice(i, i + size), np.unique(flat[firsts[i : i + size, None] + np.arange(window)])


def locate(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, starts): first words of the windows to remove, for each shard and document."""

    def search(table: pa.Table) -> pa.Table:
        vocabulary, number = Numbers(), Numbers()
        words, lengths, places = [], [], []
        for value in table.column("packed").to_pylist():
            ids, local, first, which, blob = unpack(value)
            sequences = blob.tobytes().split(b"\n")
            known = len(number)
            here = number.of(sequences)
            if len(number) > known:
                new = [s for s, n in zip(sequences, here.tolist(), strict=True) if n >= known]
                lengths.append(np.fromiter((s.count(b" ") + 1 for s in new), np.int64, len(new)))
                words.append(vocabulary.of(b" ".join(new).split(b" ")))
            places.append((here[which.astype(np.int64)], ids[local.astype(np.int64)], first.astype(np.int64)))
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        least, most = np.full(len(number), 2**63 - 1), np.full(len(number), -(2**63))
        for which, owner, _ in places:
            np.minimum.at(least, which, owner)
            np.maximum.at(most, which, owner)
        numbers = np.concatenate(words)
        firsts, lows, holding = shared_phrases(numbers, bounds, least, most, window)
        hits = [np.zeros(0, HIT)]
        if len(firsts):
            line, home, begin, length = spelled(numbers, bounds, holding, firsts, window)
            for run, used in phrase_batches(line, begin, length):
                text = as_text(line, used)
                hits.append(np.fromiter(automaton(text, begin[run], lows[run], length).iter(text), HIT))
                hits[-1]["word"] = home[hits[-1]["word"] - length + 1]
        flat = np.concatenate(hits)
        flat = flat[np.argsort(flat["word"])]
        holder = np.searchsorted(bounds, flat["word"], side="right") - 1
        begin, lowest = flat["word"] - bounds[holder], flat["doc"]
        counts = np.bincount(holder, minlength=len(number))
        offsets = np.cumsum(counts) - counts
        docs, starts = [], []
        for which, owner, first in places:
            n = counts[which]
            total = int(n.sum())
            row = np.repeat(np.arange(len(which)), n)
            hit = np.repeat(offsets[which] - (np.cumsum(n) - n), n) + np.arange(total)
            gone = lowest[hit] < owner[row]
            docs.append(owner[row][gone])
            starts.append(first[row][gone] + begin[hit[gone]])
        docs, starts = np.concatenate(docs), np.concatenate(starts)
        order = np.lexsort((starts, docs))
        docs, starts = docs[order], starts[order]
        new = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(docs)]]), pa.int32()), pa.array(starts, pa.int32()))
        return pa.table({"doc_id": pa.array(docs[new], pa.int64()), "starts": lists})

    return found.groupBy("shard").applyInArrow(search, "doc_id long, starts array<int>")


def removals(texts: DataFrame, window: int, filter_bits: int = 1 << 27) -> DataFrame:
    """(doc_id, starts): for each document with windows that start in a smaller one, their first
    words. ``texts`` has unique ids and no nulls."""
    shared, passing = shared_anchors(texts, window, filter_bits)
    shards = max(4 * shuffle_partitions(texts.sparkSession), -(-passing // SHARD_ANCHORS))
    found = locate(segments(texts, shared, window, shards), window)
    return found.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each id.

    Rows without an id are left out, a null text is empty, and rows that share an id count as
    one document with the least text. A text of fewer words than the window keeps them all. A window
    has at most 20 words."""
    if window > RUN + 15:
        raise ValueError(f"windows have at most {RUN + 15} words")
    spark = docs.sparkSession
    texts = keyed_texts(docs)
    gone = materialize(removals(texts, window), shared_dir(spark), "removals")
    joined = texts.join(gone, "doc_id", "left").select("doc_id", "text", "starts")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, starts in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                words = text.split()
                n, dropped = len(words), 0
                if starts.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stay = np.cumsum(edge[:n]) == 0
                    dropped = n - int(stay.sum())
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                rows.append((doc_id, n, dropped, hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(load(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
     g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM s),
     m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM g),
     r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE first < doc_id),
     c AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM r GROUP BY doc_id),
     e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
     k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM e ANTI JOIN r ON e.doc_id = r.doc_id AND e.p = r.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
