"""Language identification by word-first backoff.

A known word gives each language the logarithm of its frequency there. A word that is not
known is broken into character n-grams of its padded form: the longest order of which any
n-gram is known decides, shorter orders count only where the longer ones know nothing.

The model is learned from labelled texts. Its size is bounded by parameters: the most
frequent words and n-grams of each language are kept, so that it can be broadcast at any
corpus size; what falls outside is handled by the backoff. Counts of words and n-grams are
taken over all training texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fold, free_name, give_back, giving_back, load, materialize, shared_dir, short_batches, slices, strings_of

UNDETERMINED = "und"
_RUNS = re.compile(r"[^\W\d_]+")
#: No letters; most tokens are a word once these are gone from their ends.
_MARKS = ".,;:!?\"'()[]{}<>*#-_/0123456789\u2026\u201c\u201d\u2018\u2019\u00ab\u00bb"


def _words(text: str) -> list[str]:
    """Runs of letters. The pattern also takes numerals such as one half or a circled one, which are no
    letters; runs that hold one are rare and are cut there."""
    if text.isalpha():
        return [text]
    runs = _RUNS.findall(text)
    if not runs or "".join(runs).isalpha():
        return runs
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]


def tokens_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct tokens of texts (runs between ASCII white space, which ends a word and the context of
    its case), the place in that list of every token in order, and where those of each text begin
    (one more entry at the end). A null text has no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return strings_of(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def words_of(tokens: list[str]) -> tuple[list[str], np.ndarray]:
    """Words of all tokens, in lower case, and the place of the token of each. Those of one token stand in
    order; tokens that are one word come first."""
    words = [t if t.isalpha() else t.strip(_MARKS) for t in map(str.lower, tokens)]
    alone = np.fromiter(map(str.isalpha, words), bool, len(words))
    if alone.all():
        return words, np.arange(len(words))
    rest = np.flatnonzero(~alone)
    found = [_words(words[i]) for i in rest.tolist()]
    owner = np.concatenate([np.flatnonzero(alone), np.repeat(rest, np.fromiter(map(len, found), np.int64, len(found)))])
    return [*(w for w in words if w.isalpha()), *(w for x in found for w in x)], owner


#: Parts of one that weights of n-grams are counted in.
UNIT = 1 << 16
_DRAWS = 1 << 20
#: Of words with their counts that a task gathers before it sums them up.
HELD_BYTES = 32_000_000


@dataclass
class LanguageModel:
    """Evidence is a matrix with a row for each known word (log frequency in each language) and
    each known n-gram (log share of each language). The keys stay in Arrow arrays, as they came
    to the driver and as they are sent; a worker makes its tables when it first needs them."""

    languages: list[str]
    word_keys: pa.Array
    gram_keys: list[pa.Array]  # longest order first
    rows: np.ndarray

    @cached_property
    def tables(self) -> list[dict[str, int]]:
        """Row of each word, then of each n-gram by order."""
        out, at = [], 0
        for keys in (self.word_keys, *self.gram_keys):
            out.append(dict(zip(keys.to_pylist(), range(at, at + len(keys)), strict=True)))
            at += len(keys)
        return out

    def evidence(self, word: str) -> list[int]:
        """Rows whose mean is the evidence of a word; none where nothing is known."""
        words, *grams = self.tables
        known = words.get(word)
        if known is not None:
            return [known]
        padded = f"^{word}$"
        order = len(grams)
        for table in grams:
            hits = [h for i in range(len(padded) - order + 1) if (h := table.get(padded[i : i + order])) is not None]
            if hits:
                return hits
            order -= 1
        return []

    def tokens(self, tokens: list[str]) -> np.ndarray:
        """For each token the sums over its words, then the number of these words; column by column."""
        words, owner = words_of(tokens)
        out = np.zeros((len(self.languages) + 1, len(tokens)))
        out[-1] = np.bincount(owner, minlength=len(tokens))
        known = np.fromiter(map(self.tables[0].get, words, repeat(-1)), np.int64, len(words))
        codes = _Codes()
        unknown = np.flatnonzero(known < 0)
        at = np.fromiter(map(codes.__getitem__, map(words.__getitem__, unknown.tolist())), np.int64, len(unknown))
        grams = [self.evidence(w) for w in codes]
        counts = np.fromiter(map(len, grams), np.int64, len(grams))
        rows = np.fromiter((r for found in grams for r in found), np.int64, int(counts.sum()))
        of, weight = np.repeat(np.arange(len(grams)), counts), np.repeat(1 / np.maximum(counts, 1), counts)
        for k in range(len(self.languages) if len(self.rows) else 0):
            shown = self.rows[known, k]
            shown[unknown] = np.bincount(of, self.rows[rows, k] * weight, len(grams))[at] if len(grams) else 0.0
            out[k] = np.bincount(owner, shown, len(tokens))
        return out.T


class _Codes(dict):
    def __missing__(self, token: str) -> int:
        self[token] = code = len(self)
        return code


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, lang, n) over all texts; summed within each task before they are shuffled."""

    def emit(held: dict[str, list[pa.Table]]) -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            summed = pa.TableGroupBy(pa.concat_tables(held.pop(lang)), "word", use_threads=False).aggregate([("n", "sum")])
            for part in summed.to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_arrays([part.column("word"), pa.repeat(pa.scalar(lang, pa.string()), part.num_rows), part.column("n_sum")], names=["word", "lang", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        size = 0
        for batch in slices(batches, 0):
            tokens, at, begin = tokens_of(batch.column(0))
            words, owner = words_of(tokens)
            words = pa.array(words, pa.string())
            langs = batch.column(1).dictionary_encode()
            spoken = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(begin))
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                seen = np.bincount(at[spoken == i], minlength=len(tokens))[owner]
                found = np.flatnonzero(seen)
                held.setdefault(lang, []).append(part := pa.table({"word": words.take(pa.array(found)), "n": seen[found]}))
                size += part.nbytes
            if size > HELD_BYTES:
                yield from emit(held)
                size = 0
        yield from emit(held)

    return docs.select("text", "lang").mapInArrow(giving_back(run), "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def gram_weights(counts: DataFrame, orders: int) -> DataFrame:
    """(gram, lang, n) over the n-grams of all words: the square roots of the words' counts, in
    whole units so that sums do not depend on their order; summed by task before they are shuffled."""

    def emit(sums: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
        for lang, table in sums.items():
            yield pa.RecordBatch.from_pydict({"gram": pa.array(list(table), pa.string()), "lang": pa.array([lang] * len(table), pa.string()), "n": pa.array(list(table.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[str, int]] = {}
        for batch in batches:
            for word, lang, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = sums.setdefault(lang, {})
                root = round(n**0.5 * UNIT)
                padded = f"^{word}$"
                for order in range(1, min(orders, len(padded)) + 1):
                    for i in range(len(padded) - order + 1):
                        gram = padded[i : i + order]
                        table[gram] = table.get(gram, 0) + root
            if sum(map(len, sums.values())) > 150_000:
                yield from emit(sums)
                sums = {}
        yield from emit(sums)

    return counts.select("word", "lang", "n").mapInArrow(giving_back(run), "gram string, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def shares(sizes: dict[str, int], k: int) -> dict[str, int]:
    """``k`` places in even parts; what a small language does not need goes to the larger ones."""
    out, left = {}, k
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(sizes) - i))
        left -= out[lang]
    return out


def heaviest_by_language(counts: DataFrame, key: str, kind: Column, k: int) -> tuple[dict[int, dict[str, tuple[int, int]]], pa.Table]:
    """Sum and number of rows for each kind and language; and (kind, key, lang, n) of the kept keys.

    Of each kind about ``k`` keys are kept, those that weigh most in any language, by places for
    each language. A hash draws the keys that take the last places of a language where the keys
    of one level (a power of 2**(1/16)) outnumber these places."""
    spark = counts.sparkSession
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    counts = counts.select(key, "lang", "n", kind.cast("int").alias("kind"))
    levels: dict[int, dict[str, dict[int, tuple[int, int]]]] = {}
    for r in counts.groupBy("kind", "lang", level.alias("level")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        levels.setdefault(r["kind"], {}).setdefault(r["lang"], {})[r["level"]] = (r["n"], r["types"])
    sizes = {x: {lang: (sum(n for n, _ in by.values()), sum(t for _, t in by.values())) for lang, by in langs.items()} for x, langs in levels.items()}
    rules = []
    for x, langs in levels.items():
        places = shares({lang: types for lang, (_, types) in sizes[x].items()}, k)
        for lang, by in langs.items():
            room, cut, drawn = places[lang], -1, 0.0
            for at in sorted(by, reverse=True):
                if by[at][1] > room:
                    cut, drawn = at, room / by[at][1]
                    break
                room -= by[at][1]
            rules.append((x, lang, cut, int(drawn * _DRAWS)))
    rules = spark.createDataFrame(rules, "kind int, lang string, cut int, drawn int")
    last = (level == F.col("cut")) & (F.pmod(F.xxhash64(key), F.lit(_DRAWS)) < F.col("drawn"))
    kept = counts.join(F.broadcast(rules), ["kind", "lang"]).where((level > F.col("cut")) | last).select(key)  # about k rows of each kind
    return sizes, counts.join(F.broadcast(kept), key, "left_semi").select("kind", key, "lang", "n").toArrow()


def learn(docs: DataFrame, max_words: int = 120_000, max_grams: int = 40_000, orders: int = 5, max_word: int = 40) -> LanguageModel:
    """Learns from the rows of ``docs`` whose text and lang are not null; without any, the model has
    no language.

    Words and n-grams are counted over all training texts, the n-grams of a word weighted by the
    square root of its frequency. About ``max_words`` words and ``max_grams`` n-grams of each
    order come to the driver, with even places for each language. Words of more than
    ``max_word`` letters give n-grams, but take no place among the words."""
    where = shared_dir(docs.sparkSession)
    short_batches(docs.sparkSession)
    counts = materialize(word_counts(docs.where("text is not null and lang is not null")), where, "words")
    sizes, table = heaviest_by_language(counts.where(F.length("word") <= max_word), "word", F.lit(0), max_words)
    gram_sizes, gram_table = heaviest_by_language(materialize(gram_weights(counts, orders), where, "grams"), "gram", F.length("gram"), max_grams)
    languages = sorted({*sizes.get(0, {}), *gram_sizes.get(1, {})})
    at = pa.array(languages, pa.string())

    def matrix(part: pa.Table, key: str) -> tuple[pa.Array, np.ndarray]:
        coded = part.column(key).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        seen = np.zeros((len(order), len(languages)))
        seen[place[coded.indices.to_numpy()], pc.index_in(part.column("lang").combine_chunks(), at).to_numpy()] = part.column("n").to_numpy()
        return coded.dictionary.take(order), seen

    def totals(of: dict[str, tuple[int, int]]) -> np.ndarray:
        return np.array([of.get(x, (0, 0))[0] for x in languages], float)

    words, seen = matrix(table, "word")
    held = sizes.get(0, {})
    rows = [np.log((seen + 0.1) / (totals(held) + 0.1 * sum(types for _, types in held.values())))] if len(words) else []
    grams = []
    for order in range(orders, 0, -1):
        names, seen = matrix(gram_table.filter(pc.equal(gram_table.column("kind"), order)), "gram")
        grams.append(names)
        if len(names):
            rate = (seen / UNIT + 0.02) / (1.0 + totals(gram_sizes[order]) / UNIT)
            rows.append(np.log(rate / rate.sum(axis=1, keepdims=True)))
    return LanguageModel(languages, words, grams, np.concatenate(rows) if rows else np.zeros((0, 0)))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its score under ``names`` to the columns ``keep`` of every row.

    A text that is null or has no letter is ``und`` with score 0. The score is the share of
    the best language when evidence grows with the square root of the number of words; ties
    go to the language that sorts first.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, len(keep)):
            tokens, at, begin = tokens_of(batch.column(batch.num_columns - 1))
            values = m.tokens(tokens)
            full = np.flatnonzero(np.diff(begin))
            total = np.zeros((batch.num_rows, len(m.languages) + 1))
            for k in range(total.shape[1] if len(full) else 0):
                total[full, k] = np.add.reduceat(values[:, k][at], begin[full])
            langs, scores = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            if len(told := np.flatnonzero(total[:, -1])) and m.languages:
                z = total[told, :-1] / np.sqrt(total[told, -1:])
                share = np.exp(z - z.max(axis=1, keepdims=True))
                langs[told] = np.array(m.languages, object)[z.argmax(axis=1)]
                scores[told] = 1 / share.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    kinds = dict(docs.dtypes)
    shown = docs.select(*keep, F.col("text").alias(free_name(docs, "whole_text")))
    return shown.mapInArrow(giving_back(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{names[0]}` string", f"`{names[1]}` double"]))


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0, **limits) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, also where ids are null or repeated;
    learns from the other folds. Null and empty texts are ``und``; very long ones are read whole.
    An empty table gives no row."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text", "lang")
    return predict(out, learn(out.where("not held_out"), **limits), ["doc_id", "held_out"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the rest (no text, no letter, or a best language
    with hardly more than an even share) go. Columns and values stay as they are; rows with null
    or repeated ids are judged like others. Without any labelled training text all rows go."""
    columns = docs.columns
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    model = learn(docs.where(fold(F.col("doc_id"), 5) != 0).select("text", "lang"))
    floor = 1.01 / len(model.languages) if len(model.languages) > 1 else 0.0
    out = predict(docs, model, columns, (lang, score))
    return out.where((F.col(lang) != UNDETERMINED) & (F.col(score) > floor)).select(*columns)
