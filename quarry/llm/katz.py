"""Language-model scoring with Katz backoff over bigrams.

    P(w | v) = d(c(vw)) c(vw) / c(v)      where the pair vw was seen in training,
             = alpha(v) P(w)              where it was not; P(w) likewise over single words,
                                          with what is left for all unseen words together.

Counts up to ``LOW`` are discounted by Good-Turing, higher ones by the fixed factor ``HIGH``,
so that every context leaves some mass; alpha(v) is what is left over the unigram mass of
the words not seen after v, so the probabilities after each context sum to 1. A text starts
in the context of the end token and ends with it.

The logarithm of a text is a sum over its tokens of terms that each need one count or one
context. So tokens travel to the counts, packed, and sums travel back:

1. Word counts. The most frequent words, a fixed number, are broadcast with their counts;
   the others are known by 64-bit hashes.
2. One shuffle of all bigrams, by the pair when the second word is frequent, else by that
   word. Each bucket counts its pairs (training documents only), writes its part of the
   model table, and sums for each document what the counts give. No bucket holds the pairs
   of a frequent word together, and the number of buckets grows with the tokens.
3. Contexts: what the seen pairs of each leave. The unseen pairs of held-out documents are
   joined to them, frequent contexts by broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fold, give_back, giving_back, heaviest, keyed_texts, load, materialize, mix, pack, shared_dir, short_batches, shuffle_partitions, steps, sums, text_chunks, unpack

LOW = 5
HIGH = 0.999
END = b""
TAIL = np.uint64(1) << np.uint64(63)


def good_turing(having: list[int]) -> np.ndarray:
    """Discount factors for counts 0..LOW (0 unused). ``having[r]``: number of types with count r,
    up to LOW + 1. Where the formula leaves (0, 1), absolute discounting stands in."""
    n1, n2 = having[1], having[2]
    out = np.ones(LOW + 1)
    if not n1:
        return np.where(np.arange(LOW + 1) > 0, HIGH, 1.0)
    share = (LOW + 1) * having[LOW + 1] / n1
    absolute = n1 / (n1 + 2 * n2)
    for r in range(1, LOW + 1):
        d = ((r + 1) * having[r + 1] / (r * having[r]) - share) / (1 - share) if having[r] and share < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - absolute) / r if absolute < r else 0.5
    return out


class Unigrams:
    """What every task knows: frequent words with counts, totals, and the unigram probabilities."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, types: int, having: list[int]):
        words = sorted(frequent, key=lambda x: (-x[1], x[0]))
        if END not in {w for w, _ in words}:
            words.append((END, 0))
        self.codes = {w: i for i, (w, _) in enumerate(words)}
        self.counts = np.array([n for _, n in words], np.int64)
        self.size = len(words)
        self.total, self.types = total, types
        self.discount = good_turing(having)
        low = sum(having[r] * r for r in range(1, LOW + 1))
        kept = sum(having[r] * r * self.discount[r] for r in range(1, LOW + 1)) + HIGH * (total - low)
        self.unknown = (total - kept) / total if total else 1.0
        self.frequent = self.probability(self.counts)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        low = np.minimum(counts, LOW)
        p = np.where(counts > LOW, HIGH, self.discount[low]) * counts / max(1, self.total)
        return np.where(counts > 0, p, self.unknown)


class _Codes(dict):
    """Code of a word: its place among the frequent ones, or a marked hash; the latest are remembered."""

    bound = 200_000

    def __init__(self, frequent: dict[bytes, int]):
        super().__init__()
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.bound:
            self.clear()
        if (code := self.frequent.get(word)) is None:
            code = xxhash.xxh64_intdigest(word) | 1 << 63
        self[word] = code
        return code


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the training texts; the empty word is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in text_chunks(batches):
            count = Counter({END: len(ids)})
            for text in rows:
                count.update(text.lower().split())
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(count), pa.binary()), "n": pa.array(list(count.values()), pa.int64())})

    return texts.where("not held_out").select("doc_id", "text").mapInArrow(giving_back(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_words(texts: DataFrame, where: str, frequent: int) -> Unigrams:
    words = materialize(count_words(texts), where, "model/order=1")
    ends = F.sum(F.when(F.length("word") == 0, F.col("n")))
    row = words.agg(F.sum("n").alias("total"), ends.alias("ends"), F.count(F.lit(1)).alias("types"), *(F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, LOW + 2))).first()
    # the end token is in the table even where words of its frequency are not
    head = [(bytes(r["word"]), r["n"]) for r in heaviest(words.where(F.length("word") > 0), "n", "word", frequent).collect()] + [(END, row["ends"] or 0)]
    return Unigrams(head, row["total"] or 0, row["types"], [0, *(row[f"n{r}"] for r in range(1, LOW + 2))])


#: Sums kept for each document while they travel.
SUMS = ["n_tokens", "n_known", "base", "context", "log_high", "n_high", *(f"n_low{r}" for r in range(1, LOW + 1)), "unseen"]
_AT = {name: i for i, name in enumerate(SUMS)}
SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), *((f"t{r}", pa.int64()) for r in range(1, LOW + 2)), ("x", pa.float64()), ("packed", pa.binary())])
DDL = "kind int, chunk long, a long, b long, " + ", ".join(f"t{r} long" for r in range(1, LOW + 2)) + ", x double, packed binary"


def _rows(kind: int, n: int, **columns) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.array(np.full(n, kind), f.type) if f.name == "kind" else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


def _pack_sums(part: dict[str, np.ndarray], places: np.ndarray) -> bytes:
    present = [name for name in SUMS if name in part and part[name].any()]
    return pack(steps(places.astype(np.uint64)), np.array([_AT[p] for p in present], np.uint64), *(part[p] if part[p].dtype.kind == "f" else part[p].astype(np.uint64) for p in present))


def send(texts: DataFrame, known: Unigrams, buckets: int) -> DataFrame:
    """Packed bigrams of chunks of documents, by bucket."""
    spread = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = spread.value
        codes = _Codes(k.codes)
        end = k.codes[END]
        size = np.uint64(k.size)
        held_of: dict[int, bool] = {}

        def noted(source):
            for batch in source:
                held_of.update(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
                yield batch

        for ids, rows in text_chunks(noted(batches)):
            split = [t.lower().split() for t in rows]
            lengths = np.fromiter((len(w) + 1 for w in split), np.int64, len(split))
            word = np.concatenate([np.fromiter((*map(codes.__getitem__, w), end), np.uint64, len(w) + 1) for w in split])
            del split
            doc = np.repeat(np.arange(len(ids)), lengths)
            before = np.concatenate([[np.uint64(end)], word[:-1]])
            before[np.cumsum(lengths)[:-1]] = end
            held = np.array([held_of.pop(i) for i in ids], bool)
            m, chunk = len(ids), ids[0]
            head2, head1 = word < size, before < size
            n2 = k.counts[word[head2].astype(np.int64)]
            n1 = k.counts[before[head1].astype(np.int64)]
            part = {
                "n_tokens": lengths,
                "n_known": np.bincount(doc[head2][n2 > 0], minlength=m),
                "base": np.bincount(doc[head2], weights=np.log10(n2 + 1.0), minlength=m),
                "context": -np.bincount(doc[head1][n1 > 0], weights=np.log10(n1[n1 > 0].astype(float)), minlength=m),
            }
            chunk_hash = int(mix(np.array([chunk & (2**63 - 1)], np.uint64))[0])
            names, packed = [buckets + chunk_hash % buckets], [pack(np.array(ids, np.int64), np.packbits(held), np.frombuffer(_pack_sums(part, np.arange(m)), np.uint8))]
            both = head1 & head2
            # a pair of frequent words travels once for each document, with its number there
            key, owner = before[both] * size + word[both], doc[both]
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(start, len(key)))
            key, owner = key[start], owner[start]
            b = [mix(key) % np.uint64(buckets)]
            t1, t2 = before[~both], word[~both]
            b.append(np.where(head2[~both], mix(mix(t1) + t2), mix(t2)) % np.uint64(buckets))
            c1 = before[~head1]
            b.append(mix(c1) % np.uint64(buckets))
            docs = [owner, doc[~both], doc[~head1]]
            orders = [np.lexsort((x, y)) for x, y in ((key, b[0]), (t2, b[1]), (c1, b[2]))]
            bounds = [np.searchsorted(x[o], np.arange(buckets + 1, dtype=np.uint64)) for x, o in zip(b, orders, strict=True)]
            doc_ids = np.array(ids, np.int64)
            for i in range(buckets):
                at = [o[e[i] : e[i + 1]] for o, e in zip(orders, bounds, strict=True)]
                if not any(map(len, at)):
                    continue
                names.append(i)
                own, local = np.unique(np.concatenate([d[a] for d, a in zip(docs, at, strict=True)]), return_inverse=True)
                kd, td, cd = np.split(local.astype(np.uint64), np.cumsum([len(a) for a in at])[:-1])
                packed.append(pack(steps(own.astype(np.uint64)), doc_ids[own], np.packbits(held[own]), steps(key[at[0]]), kd, times[at[0]].astype(np.uint64), t1[at[1]], steps(t2[at[1]]), td, steps(c1[at[2]]), cd))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(names, pa.int32()), "chunk": pa.array([chunk] * len(names), pa.int64()), "packed": pa.array(packed, pa.binary())})

    return texts.select("doc_id", "text", "held_out").mapInArrow(giving_back(run), "bucket int, chunk long, packed binary")


def pieces(pair: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of the pairs, about ``most`` at once, by ascending ranges; equal pairs stay together."""
    n = max(1, -(-len(pair) // most))
    few = np.sort(pair[:: max(1, min(64, len(pair) // (64 * n)))])
    cuts = np.unique(few[np.arange(1, n) * len(few) // n])
    range_of = np.searchsorted(cuts, pair, side="right").astype(np.uint16)
    for i in range(len(cuts) + 1):
        yield np.flatnonzero(range_of == i)


def count_pairs(sent: DataFrame, known: Unigrams, buckets: int, most: int) -> DataFrame:
    """Rows of four kinds: 0 sums of a chunk's documents (packed); 1 contexts with what their pairs
    in this bucket hold; 2 unseen pairs (document, context); 3 a part of the model table with
    its numbers of pairs by count."""
    spread = sent.sparkSession.sparkContext.broadcast(known)

    def run(table: pa.Table) -> pa.Table:
        give_back()
        k = spread.value
        chunks = table.column("chunk").to_pylist()
        values = table.column("packed").to_pylist()
        if table.column("bucket")[0].as_py() >= buckets:
            opened = [unpack(v) for v in values]
            own = _rows(0, len(chunks), chunk=chunks, a=[1] * len(chunks), packed=[pack(ids, bits) for ids, bits, _ in opened])
            return pa.concat_tables([own, _rows(0, len(chunks), chunk=chunks, packed=[x.tobytes() for _, _, x in opened])])
        size = np.uint64(k.size)
        places, ids, held, parts, offset = [], [], [], [[] for _ in range(8)], np.int32(0)
        for v in values:
            own, doc_ids, bits, key, kd, times, t1, t2, td, c1, cd = unpack(v)
            places.append(sums(own))
            ids.append(doc_ids)
            held.append(np.unpackbits(bits, count=len(doc_ids)).astype(bool))
            for p, x in zip(parts, (sums(key), kd.astype(np.int32) + offset, times.astype(np.int32), t1.astype(np.uint64), sums(t2), td.astype(np.int32) + offset, sums(c1), cd.astype(np.int32) + offset), strict=True):
                p.append(x)
            offset += np.int32(len(doc_ids))
        key, kd, times, t1, t2, td, c1, cd = (np.concatenate(parts.pop(0)) for _ in range(8))
        sizes = [len(x) for x in ids]
        ids, held = np.concatenate(ids), np.concatenate(held)
        m = len(ids)
        part = {name: np.zeros(m) if name in ("base", "context", "log_high", "unseen") else np.zeros(m, np.int64) for name in SUMS}
        # counts of the words that only this bucket has
        rare = t2 >= size
        words, inverse = np.unique(t2[rare], return_inverse=True)
        rare_n = np.bincount(inverse[~held[td[rare]]], minlength=len(words))
        n2 = np.zeros(len(t2), np.int64)
        n2[rare] = rare_n[inverse]
        p2 = np.empty(len(t2))
        p2[rare] = k.probability(n2[rare])
        p2[~rare] = k.frequent[t2[~rare].astype(np.int64)]
        part["n_known"] += np.bincount(td[rare][n2[rare] > 0], minlength=m)
        part["base"] += np.bincount(td[rare], weights=np.log10(n2[rare] + 1.0), minlength=m)
        at = np.searchsorted(words, c1)
        found = np.append(words, 0)[at] == c1
        nc = np.where(found, np.append(rare_n, 0)[at], 0)
        part["context"] -= np.bincount(cd[nc > 0], weights=np.log10(nc[nc > 0].astype(float)), minlength=m)
        unseen_docs, unseen_contexts, having, contexts, model = [], [], np.zeros(LOW + 2, np.int64), [], []
        model_parts = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
        rare_pair = mix(mix(t1) + t2)
        for both, at in chain(zip(repeat(True), pieces(key, most)), zip(repeat(False), pieces(rare_pair, most))):  # noqa: B905
            if both:
                pair, doc, n_times = key[at], kd[at], times[at]
                first, p = pair // size, k.frequent[(pair % size).astype(np.int64)]
            else:
                pair, doc, first, p = rare_pair[at], td[at], t1[at], p2[at]
                n_times = np.ones(len(doc), np.int32)
            kinds, place, inverse = np.unique(pair, return_index=True, return_inverse=True)
            trained = ~held[doc]
            n = np.bincount(inverse[trained], weights=n_times[trained], minlength=len(kinds)).astype(np.int64)
            c = n[inverse]
            for r in range(1, LOW + 1):
                part[f"n_low{r}"] += np.bincount(doc[c == r], weights=n_times[c == r], minlength=m).astype(np.int64)
            high = c > LOW
            part["n_high"] += np.bincount(doc[high], weights=n_times[high], minlength=m).astype(np.int64)
            part["log_high"] += np.bincount(doc[high], weights=np.log10(c[high].astype(float)) * n_times[high], minlength=m)
            unseen = c == 0
            part["unseen"] += np.bincount(doc[unseen], weights=np.log10(p[unseen]) * n_times[unseen], minlength=m)
            unseen_docs.append(np.repeat(ids[doc[unseen]], n_times[unseen]))
            unseen_contexts.append(np.repeat(first[unseen], n_times[unseen]))
            real = n > 0
            n, place = n[real], place[real]
            having += np.bincount(np.minimum(n, LOW + 2), minlength=LOW + 3)[: LOW + 2]
            context, inverse = np.unique(first[place], return_inverse=True)
            tally = [np.bincount(inverse[n == r], minlength=len(context)) for r in range(1, LOW + 1)]
            contexts.append(_rows(1, len(context), a=context.view(np.int64), x=np.bincount(inverse, weights=p[place], minlength=len(context)), **{f"t{r}": t for r, t in enumerate(tally, 1)}, **{f"t{LOW + 1}": np.bincount(inverse, weights=n, minlength=len(context)).astype(np.int64)}))
            if both:
                model_parts[0].append(kinds[real])
                model_parts[1].append(n)
            else:
                model.append((t1[at][place], n, t2[at][place]))
        # pieces are ranges of pairs, so the pairs of frequent words are in order as a whole
        model = [steps(np.concatenate(model_parts[0])), np.concatenate(model_parts[1]).astype(np.uint64), *(np.concatenate(x) for x in zip(*model, strict=True))]
        model[3] = model[3].astype(np.uint64)
        ends = np.cumsum(sizes)
        sums_rows = _rows(0, len(chunks), chunk=chunks, packed=[_pack_sums({name: x[e - s : e] for name, x in part.items()}, own) for own, s, e in zip(places, sizes, ends.tolist(), strict=True)])
        pairs = np.stack([np.concatenate(unseen_docs), np.concatenate(unseen_contexts).view(np.int64)])
        pairs = pairs[:, np.lexsort(pairs[::-1])]
        return pa.concat_tables([sums_rows, *contexts, _rows(2, pairs.shape[1], a=pairs[0], b=pairs[1]), _rows(3, 1, packed=[pack(*model)], **{f"t{r}": [int(having[r])] for r in range(1, LOW + 2)})])

    return sent.groupBy("bucket").applyInArrow(run, DDL)


def document_sums(made: DataFrame) -> DataFrame:
    """(doc_id, held_out, sums) of every document, added up over the buckets."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        values = table.column("packed").to_pylist()
        ids, bits = unpack(values.pop(table.column("a").to_pylist().index(1)))
        total = np.zeros((len(SUMS), len(ids)))
        for value in values:
            places, present, *arrays = unpack(value)
            places = sums(places).astype(np.int64)
            for i, x in zip(present.tolist(), arrays, strict=True):
                total[i, places] += x
        held = np.unpackbits(bits, count=len(ids)).astype(bool)
        return pa.table({"doc_id": pa.array(ids), "held_out": pa.array(held), **{name: pa.array(x) for name, x in zip(SUMS, total, strict=True)}})

    return made.where("kind = 0").select("chunk", "a", "packed").groupBy("chunk").applyInArrow(run, "doc_id long, held_out boolean, " + ", ".join(f"{s} double" for s in SUMS))


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, frequent: int = 1 << 17, bucket_tokens: int = 2_000_000, piece_pairs: int = 1 << 19) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each id.

    Rows without an id are left out, a null text is empty (one token, its end), rows that share
    an id are one document with the least text. Without training texts every word is unknown
    and has probability 1."""
    spark = docs.sparkSession
    where = shared_dir(spark)
    short_batches(spark)
    texts = keyed_texts(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == held_out)
    known = learn_words(texts, where, frequent)
    buckets = max(shuffle_partitions(spark), -(-known.total // bucket_tokens))
    sent = send(texts, known, buckets)
    made = materialize(count_pairs(sent, known, buckets, piece_pairs), where, "model/order=2", ["kind"])
    row = made.where("kind = 3").agg(*(F.sum(f"t{r}").alias(f"n{r}") for r in range(1, LOW + 2))).first()
    discount = good_turing([0, *(row[f"n{r}"] or 0 for r in range(1, LOW + 2))])
    contexts = made.where("kind = 1").groupBy("a").agg(F.sum("x").alias("x"), *(F.sum(f"t{r}").alias(f"t{r}") for r in range(1, LOW + 2)))
    kept, low = F.lit(0.0), F.lit(0)
    for r in range(1, LOW + 1):
        kept = kept + F.col(f"t{r}") * float(r * discount[r])
        low = low + F.col(f"t{r}") * r
    total = F.col(f"t{LOW + 1}")
    left = total - kept - HIGH * (total - low)
    contexts = materialize(contexts.select("a", F.log10(left / (1 - F.col("x"))).alias("alpha")), where, "contexts")
    unseen = made.where("kind = 2").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select(F.col("a").alias("doc_id"), F.col("b").alias("context"), "n")
    alphas = contexts.select(F.col("a").alias("context"), "alpha")
    few = unseen.where("context >= 0").join(F.broadcast(alphas.where("context >= 0")), "context", "left")  # at most ``frequent`` + 1 rows
    many = unseen.where("context < 0").join(alphas.where("context < 0"), "context", "left")
    backed = few.unionByName(many).groupBy("doc_id").agg(F.sum(F.col("n") * F.coalesce("alpha", F.lit(0.0))).alias("backed"))
    logs = F.col("log_high") + F.col("n_high") * math.log10(HIGH)
    for r in range(1, LOW + 1):
        logs = logs + F.col(f"n_low{r}") * math.log10(r * discount[r])
    return (
        document_sums(made)
        .join(backed, "doc_id", "left")
        .select(
            "doc_id",
            "held_out",
            F.col("n_tokens").cast("long").alias("n_tokens"),
            F.col("n_known").cast("long").alias("n_known"),
            F.lit(known.total).cast("long").alias("train_tokens"),
            (F.col("base") - F.col("n_tokens") * math.log10(known.total + known.types + 1)).alias("base_score"),
            (logs + F.col("context") + F.col("unseen") + F.coalesce("backed", F.lit(0.0))).alias("score"),
        )
    )


def op3_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir))
