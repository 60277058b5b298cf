"""N-gram Jaccard join: rare-first prefix filtering, and the components that its links form.

1. Sets. A text's set is that of the 64-bit hashes of its shingles. Texts with one set are a
   class; its smallest id stands for it below.
2. Order. Each shingle is counted exactly, at any size: chunks of documents send their shingles,
   packed and in order, to ranges of hashes; a range counts and answers each chunk with those
   that come up more than once. The count and then the hash order the shingles of a set, rare
   ones first. Only 48 bits of a hash travel; where two shingles share them, they share a
   count and a group, which costs a comparison and never loses one.
3. Prefixes. Two sets of Jaccard similarity t or more share a shingle among the first
   n - ceil(t n) + 1 of each. Shingles that come up once are the rarest and fill the prefix of
   most documents, which end here.
4. Pairs. Small groups of one prefix shingle give all pairs that pass the length and positional
   filters. A larger group names a pivot in each round; the pivot meets the members of other
   components that pass the filters, so that m copies of one text take m pairs. The positional
   filter knows that shingles which come up once are in no other set.
5. Verification. Pairs that several groups give are verified once. The suffix filter compares
   counts of 64 ranges of hashes; only pairs that pass it bring their sets together.
6. The rest. Large groups that still hold several components are mostly copies that differ by
   a little too much. Each member is reduced to its difference from the group's pivot, a few
   shingles instead of all, and blocks of differences are compared inside a task; all groups
   with one pivot are one. Only links between components leave a task, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import free_name, give_back, giving_back, keyed_texts, load, materialize, mix, pack, shared_dir, shingle_hashes, short_batches, shuffle_partitions, steps, sums, text_chunks, unpack, word_hashes
from quarry.llm.sieve import sieve_of

#: Bits of a shingle hash that travel to the counts.
BITS = np.uint64(48)
#: Bytes of text whose shingles are counted in one range of hashes.
RANGE_BYTES = 8_000_000
#: Groups up to this size give all their pairs at once.
SMALL = 4
#: Members of a salt of a large group.
SALT = 512
#: Members of a block, and shingles that their differences may hold.
BLOCK = 2_048
BLOCK_SHINGLES = 1_000_000


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Ascending hashes of the distinct k-word shingles; fewer words make one shingle, none an
    empty set."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    found = np.sort(shingle_hashes(hashes, min(k, len(words))))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _ranges(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(shuffle_partitions(texts.sparkSession), -(-size // RANGE_BYTES))


def sets_and_prefixes(texts: DataFrame, k: int, percent: int, where: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key) of each text, key naming the set; and (token, doc_id, n, pos, rank): the
    prefix shingles that come up more than once, with their position in the order of the set
    and among those of them that come up more than once. Equal sets of one chunk are counted
    once."""
    ranges = _ranges(texts)
    width = np.uint64(-(-(1 << int(BITS)) // ranges))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in text_chunks(batches):
            sets = [shingle_set(t, k) for t in rows]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            n = np.array([len(s) for s in sets])
            first = {}
            once = np.array([first.setdefault(key, i) == i for i, key in enumerate(keys)])
            tokens = np.concatenate([s for s, one in zip(sets, once, strict=True) if one]) >> (np.uint64(64) - BITS)
            owner = np.repeat(np.flatnonzero(once), n[once])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            part = tokens // width
            begin = np.flatnonzero(np.concatenate([[len(part) > 0], part[1:] != part[:-1]]))
            full, ends = part[begin], np.append(begin[1:], len(part))
            packed = [pack(np.array(ids, np.int64), n.astype(np.uint64), np.frombuffer(b"".join(keys), np.uint8))]
            packed += [pack(steps(tokens[a:b] - i * width), owner[a:b].astype(np.uint64)) for i, a, b in zip(full, begin, ends, strict=True)]
            # what the chunk keeps of its documents goes along to where the answers meet
            spread = ranges + int(mix(np.array([ids[0]], np.int64).view(np.uint64))[0] % np.uint64(ranges))
            yield pa.RecordBatch.from_pydict({"part": pa.array([spread, *full.tolist()], pa.int32()), "chunk": pa.array([ids[0]] * len(packed), pa.int64()), "packed": pa.array(packed, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        give_back()
        part = table.column("part")[0].as_py()
        if part >= ranges:
            return table.select(["chunk", "packed"]).append_column("own", pa.array([True] * table.num_rows))
        found = [unpack(v) for v in table.column("packed").to_pylist()]
        tokens = [sums(t) + np.uint64(part) * width for t, _ in found]
        together = np.sort(np.concatenate(tokens))
        again = np.concatenate([[False], together[1:] == together[:-1]])
        kinds = np.flatnonzero(~again)
        times = np.diff(np.append(kinds, len(together)))
        kinds, times = together[kinds[times > 1]], times[times > 1]
        if not len(kinds):
            return pa.table({"chunk": pa.array([], pa.int64()), "packed": pa.array([], pa.binary()), "own": pa.array([], pa.bool_())})
        chunks, packed = [], []
        for chunk, mine, (_, owner) in zip(table.column("chunk").to_pylist(), tokens, found, strict=True):
            at = np.searchsorted(kinds, mine)
            at[at == len(kinds)] = 0
            several = kinds[at] == mine
            if several.any():
                chunks.append(chunk)
                packed.append(pack(steps(mine[several]), owner[several], times[at[several]].astype(np.uint64)))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "packed": pa.array(packed, pa.binary()), "own": pa.array([False] * len(chunks))})

    schema = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("rank", pa.int64()), ("key", pa.binary())])

    def settle(table: pa.Table) -> pa.Table:
        give_back()
        own = table.column("own").to_pylist()
        values = table.column("packed").to_pylist()
        ids, n, keys = unpack(values[own.index(True)])
        n = n.astype(np.int64)
        m = len(ids)
        names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), m, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
        docs = pa.table([pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(ids), pa.array(n), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), names], schema=schema)
        answers = [unpack(v) for v, mine in zip(values, own, strict=True) if not mine]
        if not answers:
            return docs
        tokens = np.concatenate([sums(t) for t, _, _ in answers])
        owner = np.concatenate([o for _, o, _ in answers]).astype(np.int64)
        times = np.concatenate([c for _, _, c in answers]).astype(np.int64)
        order = np.lexsort((tokens, times, owner))
        tokens, owner = tokens[order], owner[order]
        several = np.bincount(owner, minlength=m)
        rank = np.arange(len(owner)) - (np.cumsum(several) - several)[owner]
        pos = rank + (n - several)[owner]
        early = pos < prefix_length(n, percent)[owner]
        tokens, owner, pos, rank = tokens[early], owner[early], pos[early], rank[early]
        m = len(owner)
        return pa.concat_tables([docs, pa.table([pa.array(np.ones(m, np.int32)), pa.array(tokens.view(np.int64)), pa.array(ids[owner]), pa.array(n[owner]), pa.array(pos), pa.array(rank), pa.nulls(m, pa.binary())], schema=schema)])

    answers = texts.select("doc_id", "text").mapInArrow(giving_back(send), "part int, chunk long, packed binary").groupBy("part").applyInArrow(count, "chunk long, packed binary, own boolean")
    made = materialize(answers.groupBy("chunk").applyInArrow(settle, "kind int, token long, doc_id long, n long, pos long, rank long, key binary"), where, "sets", ["kind"])
    return made.where("kind = 0").select("doc_id", "n", "key"), made.where("kind = 1").select("token", "doc_id", "n", "pos", "rank")


def may_link(x: Column, y: Column, percent: int) -> Column:
    """Length filter and positional filter of two members (n, pos, rank) of one group: they share at
    most its shingle and what follows it, and before it what other sets have as well."""
    n, m = x["n"], y["n"]
    length = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    needed = F.ceil(percent * (n + m) / F.lit(100 + percent))
    return length & (F.least(n - x["pos"], m - y["pos"]) + F.least(x["rank"], y["rank"]) >= needed)


def components(links: DataFrame, where: str, name: str) -> DataFrame:
    """(id, comp): the smallest id that each linked id can reach. Labels are passed along links and
    then followed, so that they need few rounds; each round is written out."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, where, f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), where, f"{name}-0")
    turn = 0
    while True:
        turn += 1
        heard = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("heard"))
        lower = labels.join(heard, "id").select("id", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        beyond = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        after = lower.join(beyond, "comp", "left").select("id", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp"))
        after = materialize(after, where, f"{name}-{turn}")
        labels = after.select("id", "comp")
        if not after.where("comp <> was").limit(1).count():
            return labels


def range_counts(s: np.ndarray) -> np.ndarray:
    """How many hashes of an ascending set lie in each of 64 ranges."""
    edges = np.arange(1, 64, dtype=np.uint64) << np.uint64(58)
    return np.diff(np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])).astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. First the counts of ranges bound what two sets can share
    (the suffix filter); the sets themselves follow for pairs that pass."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, 64).astype(np.int64) for i in (2, 3))
            most = np.minimum(x, y).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * most >= percent * (x.sum(axis=1) + y.sum(axis=1))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            good = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    def beside(rows: DataFrame, column: str) -> DataFrame:
        x = sets.select(F.col("rid").alias("a"), F.col(column).alias("x"))
        y = sets.select(F.col("rid").alias("b"), F.col(column).alias("y"))
        return rows.join(y, "b").join(x, "a").select("a", "b", "x", "y")

    return beside(beside(pairs, "counts").mapInArrow(bound, "a long, b long"), "hashes").mapInArrow(giving_back(compare), "a long, b long")


def sets_of(texts: DataFrame, wanted: DataFrame, k: int, where: str) -> DataFrame:
    """(rid, counts, hashes) of the wanted documents, and of a few more. A sieve of fixed size
    chooses them where the texts are read, so that no text is shuffled."""
    chosen = texts.sparkSession.sparkContext.broadcast(sieve_of(wanted, "rid"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            part = batch.filter(pa.array(chosen.value.has(mix(ids.view(np.uint64)))))
            for some, rows in text_chunks(iter([part]), 2_000_000, False):
                sets = [shingle_set(t, k) for t in rows]
                yield pa.RecordBatch.from_pydict({"rid": pa.array(some, pa.int64()), "counts": pa.array([range_counts(s).tobytes() for s in sets], pa.binary()), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})

    out = materialize(texts.select("doc_id", "text").mapInArrow(giving_back(keep), "rid long, counts binary, hashes binary"), where, "hashed")
    chosen.destroy()
    give_back()
    return out


def near_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of members of one group that pass the filters. ``members``: token, rid, n, pos,
    rank, m (the size of the group).

    Sizes fall into bands so wide that only equal and neighbouring bands can link; a large
    group is split by salts on one side, to each of which the other side goes."""
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    salts = F.ceil(F.col("m") / SALT).cast("int")
    one = F.struct("rid", "n", "pos", "rank", band.alias("band"))
    x = members.select("token", band.alias("band"), F.pmod(F.xxhash64("rid"), salts).cast("int").alias("salt"), one.alias("x"))
    y = members.select("token", F.explode(F.array(band, band + 1)).alias("band"), salts.alias("salts"), one.alias("y"))
    y = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    met = x.join(y, ["token", "band", "salt"]).where(((F.col("y.band") != F.col("band")) | (F.col("x.rid") < F.col("y.rid"))) & may_link(F.col("x"), F.col("y"), percent))
    return met.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b"))


def block_links(members: DataFrame, sets: DataFrame, percent: int, where: str) -> DataFrame:
    """(a, b): links between members of different components that have one pivot. ``members``:
    pivot, rid, comp. Two sets share what their differences from the pivot share, and half of
    what their sizes exceed the sizes of these."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(v, np.uint64) for v in batch.column(3).to_pylist()]
            delta = [np.setxor1d(x, np.frombuffer(v, np.uint64), assume_unique=True).tobytes() for x, v in zip(own, batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in own], pa.int64()), pa.array(delta, pa.binary())], names=["pivot", "rid", "comp", "n", "delta"])

    # the pivot's set travels with each member, since all members in one place would be too many
    beside = members.join(sets.select(F.col("rid").alias("pivot"), F.col("hashes").alias("y")), "pivot").join(sets.select("rid", "hashes"), "rid")
    deltas = materialize(beside.select("pivot", "rid", "comp", "hashes", "y").mapInArrow(giving_back(differ), "pivot long, rid long, comp long, n long, delta binary"), where, "differences")
    sized = deltas.groupBy("pivot").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("delta")) / (8 * BLOCK_SHINGLES))).cast("int").alias("blocks"))
    placed = deltas.join(sized, "pivot").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"))))
    rows = placed.select("pivot", pair.alias("p"), "rid", "comp", "n", "block", "delta").select("pivot", "p.i", "p.j", "rid", "comp", "n", "block", "delta")

    def run(table: pa.Table) -> pa.Table:
        rid, comp, n, block = (table.column(c).to_numpy() for c in ("rid", "comp", "n", "block"))
        deltas = [np.frombuffer(v, np.uint64) for v in table.column("delta").to_pylist()]
        size = np.array([len(d) for d in deltas])
        row = np.repeat(np.arange(len(size)), size)
        _, inverse, times = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
        several = times > 1
        keep = several[inverse]
        row, col = row[keep], (np.cumsum(several) - 1)[inverse[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        shared = np.zeros((len(left), len(right)), np.float32)
        for begin in range(0, int(several.sum()), 1024):
            at = slice(*np.searchsorted(col, [begin, begin + 1024]))
            dense = np.zeros((len(n), 1024), np.float32)
            dense[row[at], col[at] - begin] = 1
            shared += dense[left] @ dense[right].T
        both = n[left][:, None] + n[right][None, :]
        shared = shared.astype(np.int64) + (both - size[left][:, None] - size[right][None, :]) // 2
        a, b = np.nonzero((100 * shared >= percent * (both - shared)) & (comp[left][:, None] != comp[right][None, :]))
        a, b = left[a], right[b]
        between = np.stack([np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])], axis=1)
        one = np.unique(between, axis=0, return_index=True)[1] if len(between) else np.zeros(0, np.int64)
        a, b = rid[a[one]], rid[b[one]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return rows.groupBy("pivot", "i", "j").applyInArrow(run, "a long, b long")


class Join:
    """What both forms of the join start from: sets, classes, groups and the sets of their members."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.where, self.percent = shared_dir(docs.sparkSession), percent
        short_batches(docs.sparkSession)
        texts = keyed_texts(docs)
        sets, entries = sets_and_prefixes(texts, k, percent, self.where)
        self.sets = sets
        self.classes = materialize(sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rid"), F.count(F.lit(1)).alias("size")), self.where, "classes")
        rid = sets.join(self.classes, "key").select("doc_id", "rid")
        named = entries.join(rid, "doc_id").select("token", "rid", "n", "pos", "rank").distinct()
        named = materialize(named, self.where, "named")
        size = named.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        self.group = materialize(named.join(size, "token"), self.where, "groups")
        self.hashed = sets_of(texts, self.group.select("rid").distinct(), k, self.where)

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        return materialize(verify(pairs, self.hashed, self.percent), self.where, name)


def similar(docs: DataFrame, k: int = 3, percent: int = 90, rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each id.

    Texts link when 100 * |intersection| >= percent * |union| of their sets. Rows without an
    id are left out, a null text is empty, rows that share an id are one document with the
    least text, and texts without words link with nothing. Very long texts are sets like
    others. An empty table gives no row."""
    join = Join(docs, k, percent)
    where = join.where
    members = join.group.withColumn("comp", F.col("rid"))
    links = checked = None
    rounds = max(1, rounds)
    for turn in range(rounds + 1):
        if turn:
            members = members.drop("comp").join(components(links, where, f"components-{turn}").withColumnRenamed("id", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
            members = materialize(members, where, f"members-{turn}")
        # a group goes on while it holds two components
        pivot = F.min(F.struct(F.xxhash64("rid", F.lit(turn)).alias("h"), "rid", "n", "pos", "rank", "comp"))
        pivots = members.groupBy("token").agg(pivot.alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "p")
        now = members.join(materialize(pivots, where, f"pivots-{turn}"), "token")
        many = now.where(F.col("m") > SMALL)
        if turn == rounds:
            found = block_links(many.select(F.col("p.rid").alias("pivot"), "rid", "comp").distinct(), join.hashed, percent, where)
            links = links.union(materialize(found, where, "links-rest"))
            break
        met = many.where((F.col("comp") != F.col("p.comp")) & may_link(F.struct("n", "pos", "rank"), F.col("p"), percent))
        pairs = met.select(F.least("rid", "p.rid").alias("a"), F.greatest("rid", "p.rid").alias("b"))
        if not turn:
            pairs = pairs.union(near_pairs(now.where(F.col("m") <= SMALL), percent))
        # the pivot has met all members of its group
        members = many.where(F.col("rid") != F.col("p.rid")).drop("p")
        pairs = pairs.distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = materialize(pairs, where, f"pairs-{turn}")
        checked = pairs if checked is None else checked.union(pairs)
        found = join.links(pairs, f"links-{turn}")
        links = found if links is None else links.union(found)
    final = components(links, where, "components").select(F.col("id").alias("rid"), "comp")
    members = join.sets.join(join.classes.select("key", "rid"), "key", "left").join(final, "rid", "left")
    # two texts without words have no class: each is its own component
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rid", "doc_id").alias("component_id"))


def link_tables(docs: DataFrame, k: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) of every two linked classes, a < b; and (doc_id, class_id, n_links,
    component_id) of each id. Texts of one class link with each other too.

    Every pair of classes that passes the prefix, length and positional filters is verified
    once, so work grows with the pairs of a group, as the links themselves do; ``similar``
    gives the components without them."""
    join = Join(docs, k, percent)
    pairs = materialize(near_pairs(join.group, percent).distinct(), join.where, "pairs")
    links = join.links(pairs, "links")
    size = join.classes.select(F.col("rid").alias("b"), "size")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(size, "b").groupBy(F.col("a").alias("rid")).agg(F.sum("size").alias("others"))
    final = components(links, join.where, "components").select(F.col("id").alias("rid"), "comp")
    members = join.sets.join(join.classes, "key", "left").join(others, "rid", "left").join(final, "rid", "left")
    return links, members.select("doc_id", F.coalesce("rid", "doc_id").alias("class_id"), (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("comp", "rid", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(load(spark, sf_dir))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one of
    the smallest id. Of rows that share an id the one with the least text stays; rows without
    an id stay. Null, empty and very long texts are as in ``similar``."""
    groups = similar(docs, k=5, percent=80)
    mark, rank = free_name(docs, "kept_id"), free_name(docs, "rank_of_id")
    first = groups.where("component_id = doc_id").select(F.col("doc_id").alias(mark))
    kept = docs.join(first, docs["doc_id"].cast("long") == first[mark], "left_semi")
    repeated = kept.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeated:
        best = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text"))))
        kept = kept.withColumn(rank, best).where(F.col(rank) == 1).drop(rank)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null").select(*docs.columns))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
     l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
     e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
     r(doc_id, c) AS (SELECT x, x FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(m.c, d.doc_id) AS BIGINT) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
