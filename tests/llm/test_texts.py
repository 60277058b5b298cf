"""Language ID, scoring, token files, substring dedup, BPE against plain versions."""

import base64
import hashlib
import itertools
import math
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute_langid  # noqa: E402
from brute_katz import katz  # noqa: E402

from quarry.llm import bpe, common, katz as lm, langid, substrings, tokenfile  # noqa: E402

ODD = [(1, None), (1, None), (2, ""), (None, "lost"), (3, "one"), (4, " \n\t "), (5, "a b c d e f g h i j k l m n"), (6, "日本語 \x1c text"), (7, "x" * 50_000)]


def odd(spark, **more):
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


def test_pack_round_trip():
    r = np.random.default_rng(1)
    arrays = [r.integers(0, 2**63, 500).astype(np.uint64), np.array([], np.int64), r.normal(size=70), np.array([-5, 3], np.int64), np.arange(300, dtype=np.uint64), np.array([7], np.uint8), r.integers(-9, 9, 100)]
    for a, b in zip(arrays, common.unpack(common.pack(*arrays)), strict=True):
        assert (a == b).all() and len(a) == len(b)
    up = np.sort(arrays[0])
    assert (common.sums(common.steps(up)) == up).all()


def test_language_id(spark, sf_dir):
    docs = common.load(spark, sf_dir)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.collect())
    # labels, sources and ids of a document have no part in its prediction
    other = docs.withColumn("source", F.lit("z")).withColumn("lang", F.when(common.fold(F.col("doc_id"), 5) == 0, "xx").otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(other).collect()}


def test_language_id_backs_off():
    model = langid.LanguageModel(["a", "b"], pa.array(["the"]), [pa.array(["ing"]), pa.array(["ng"]), pa.array(["g"])], np.array([[0.0, -1], [1, 0], [2, 0], [3, 0]]))
    assert model.evidence("the") == [0] and model.evidence("sing") == [1] and model.evidence("ang") == [2] and model.evidence("gx") == [3] and model.evidence("q") == []


def test_language_id_counts_grams_of_rare_words(spark):
    common_words = " ".join(f"{a}{b}e" for a in "bcdfglmn" for b in "aeiou")
    rows = [(common_words, "big")] * 30 + [(f"{common_words} zwqx{c}", "big") for c in "aeiou"]
    rows += [(f"kjt{c}v", "small") for c in "aeiou"] + [("hyph", "small")]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"), max_words=20, max_grams=40)
    # a small language has its own places, and words outside the word list give n-grams
    assert {"hyph", "kjtav"} <= set(model.word_keys.to_pylist()) and len(model.word_keys) <= 30
    small = model.languages.index("small")
    assert all(np.argmax(model.rows[model.evidence(w)].mean(axis=0)) == small for w in ("hyph", "kjtyv", "akjt"))
    every = langid.learn(spark.createDataFrame(rows, "text string, lang string"), max_words=8, max_grams=4000)
    assert "zwqxa" not in every.tables[0] and all(g in every.tables[1] for g in ("^zwqx", "^kjta", "kjtuv"))
    assert np.argmax(every.rows[every.evidence("zwqxy")].mean(axis=0)) != small


def test_language_id_equals_plain_version(spark, sf_dir):
    docs = common.load(spark, sf_dir).select("doc_id", F.col("text").substr(1, 400).alias("text"), "lang").limit(60)
    rows = [tuple(r) for r in docs.collect()] + [(1001, "q" * 60 + " zzz", "en"), (1002, None, "en"), (1003, "12 _", "fr"), (1004, "tie", "aa"), (1005, "tie", "bb"), (1006, "tie", None), (1008, "Ünïcode straße", "de")]
    want = brute_langid.predict(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_language_id_words_of_tokens(monkeypatch):
    texts = ["Word, (two) a-b ΟΔΟΣ. ΟΔΟΣ.Α 'İstanbul'", None, "", " \t\x0b x\u00a0y\x1cz 12 … ½ a½b ⅷ", "日本語。語 x_y 3rd ǅ", "word, word,\nWord,"]
    calls, plain = [], langid._words
    monkeypatch.setattr(langid, "_words", lambda token: calls.append(token) or plain(token))
    tokens, at, begin = langid.tokens_of(pa.array(texts))
    words, owner = langid.words_of(tokens)
    by = [[w for w, o in zip(words, owner, strict=True) if o == i] for i in range(len(tokens))]
    got = [[w for i in at[a:b] for w in by[i]] for a, b in itertools.pairwise(begin)]
    assert got == [[w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split(" ") if w] for t in texts]
    # what is one word without the marks at its ends needs no pattern
    assert "word" in words and not {"word", "two", "οδος"} & set(calls)


def test_language_id_sums_words_of_a_task(spark):
    class Task:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        select = groupBy = agg = lambda self, *_: self

    # a task sends a word once, also where the same 110,000 words come in each slice
    batch = pa.RecordBatch.from_pydict({"text": [" ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(110_000))], "lang": ["en"]})
    out = pa.Table.from_batches(langid.word_counts(Task()).run(iter([batch] * 3)))
    assert out.num_rows == 110_000 and set(out.column("n").to_pylist()) == {3} and set(out.column("lang").to_pylist()) == {"en"}


def test_language_id_fills_places_among_equal_words(spark):
    rows = [(" ".join(f"w{chr(97 + i)}x" for i in range(20)), "en"), ("other", "de")]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"), max_words=12)
    assert 5 <= len(model.word_keys) <= 18


def test_language_id_odd_rows(spark):
    got = langid.identify(odd(spark, score="clash")).collect()
    assert len(got) == len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r in got)
    assert langid.identify(odd(spark).limit(0)).count() == 0
    # without a labelled text nothing can be told; with two languages short texts are kept
    assert langid.language_stage(spark, odd(spark, __x=1), "").count() == 0
    named = odd(spark, lang_pred=1, held_out="x").withColumn("lang", F.when(F.col("doc_id") > 4, F.when(F.col("doc_id") == 6, "ja").otherwise("en")))
    kept = langid.language_stage(spark, named, "")
    assert kept.columns == named.columns and {5, 7} <= {r.doc_id for r in kept.collect()} <= {None, 3, 5, 6, 7}


@pytest.mark.parametrize("frequent", [1 << 17, 40])
def test_katz_scores(spark, sf_dir, frequent):
    docs = common.load(spark, sf_dir)
    want, _ = katz([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in lm.score(docs, frequent=frequent, bucket_tokens=20_000).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert math.isclose(g.base_score, w[4], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g.score, w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_katz_sums_to_one(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in common.load(spark, sf_dir).collect()]
    _, (uni, bi, p1, unknown, alpha, d2) = katz(rows)
    assert math.isclose(sum(p1.values()) + unknown, 1)
    for v in list(uni)[:50]:
        seen = {w: c for (x, w), c in bi.items() if x == v}
        total = sum((d2[c] if c <= lm.LOW else lm.HIGH) * c / uni[v] for c in seen.values()) + alpha[v] * (1 - sum(p1[w] for w in seen))
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_katz_counts_in_pieces(spark, sf_dir):
    r = np.random.default_rng(2)
    pair = r.integers(0, 3000, 20_000).astype(np.uint64)
    cut = list(lm.pieces(pair, 1000))
    assert sorted(np.concatenate(cut).tolist()) == list(range(len(pair))) and len(cut) > 10 and max(map(len, cut)) < 3000
    assert all(pair[a].max() < pair[b].min() for a, b in zip(cut, cut[1:])) and [len(x) for x in lm.pieces(pair[:0], 10)] == [0]  # noqa: B905
    docs = common.load(spark, sf_dir)
    want, _ = katz([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in lm.score(docs, frequent=300, piece_pairs=200).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i].score, w[5], rel_tol=1e-9) for i, w in want.items())


def test_katz_odd_rows(spark):
    got = {r.doc_id: r for r in lm.score(odd(spark, chunk=3)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[1].n_tokens == 1 and all(math.isfinite(r.score) for r in got.values())
    assert lm.score(odd(spark).limit(0)).count() == 0


def test_katz_end_token_outside_the_table(spark):
    # more words than the table holds are as frequent as the end token
    rows = [(i, " ".join(f"w{j}" for j in range(100)) if i < 4 else f"w{i} new w{i + 1}") for i in range(8)]
    rows[:2] = [(i, " ".join(f"v{j}" for j in range(300)) + " " + " ".join(f"v{j}" for j in range(300)) * 9) for i in range(2)]
    want, _ = katz(rows)
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), frequent=40).collect()}
    for i, w in want.items():
        assert (got[i].n_tokens, got[i].n_known) == w[1:3]
        assert math.isclose(got[i].base_score, w[4], rel_tol=1e-9) and math.isclose(got[i].score, w[5], rel_tol=1e-9)


def test_katz_buckets_hold_their_documents_only(spark):
    rows = [(i, f"a{i} b{i} a{i} b{i} a{i} b{i}") for i in range(300)]
    texts = common.keyed_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).withColumn("held_out", F.col("doc_id") % 7 == 2)
    known = lm.learn_words(texts, common.shared_dir(spark), 1 << 17)
    sent = [r for r in lm.send(texts, known, 50).collect() if r.bucket < 50]
    # each of the four different pairs of a text of known words goes once, with its number
    trained = sum(i % 7 != 2 for i, _ in rows)
    opened = [common.unpack(r.packed) for r in sent]
    assert sum(len(x[1]) for x in opened) <= 4 * 300 and max(len(x[1]) for x in opened) < 100
    assert sum(len(x[4]) for x in opened) == 4 * trained and sum(int(x[5].sum()) for x in opened) == 7 * trained
    want, _ = katz(rows)
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(math.isclose(got[i].score, w[5], rel_tol=1e-9) for i, w in want.items())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files(spark, sf_dir, tokenizer):
    docs = common.load(spark, sf_dir).repartition(5)
    shards = tokenfile.write_shards(docs, common.shared_dir(spark), shard_ids=20_000)
    got = tokenfile.read_documents(shards).orderBy("start").collect()
    start, everything = 0, []
    for r, row in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (row.doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        everything += ids
    assert sum(r.n_found for r in tokenfile.occurrences(shards, 262, 3).collect()) == everything.count(262)


def test_library_encoder(tokenizer):
    r = random.Random(4)
    letters = " \n\t  aab'sé日1299!?#\x0b\x1c\U0001f600\xa0\x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)] + ["end\n", " x", "a b\n", "c d"]
    encoder = tokenfile.LibraryEncoder("byte_bpe_50k.json", 500)
    for at in range(0, len(texts), 61):
        some = texts[at : at + 61]
        for text, ids in zip(some, encoder.encode(pa.array(some)), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_library_is_asked_once_for_each_word(tokenizer):
    words = ["ofonesthnt", "Ñieesdo", "it's", "éoireaux"]
    texts = [" ".join(["begin", *(w + tail for w in words for tail in ("", ",", ".\nUnd", "***", ';"', ") x"))]), "begin ofonesthnt. it's?!"]
    encoder, asked = tokenfile.LibraryEncoder("byte_bpe_50k.json"), []
    ids_of = encoder._ids
    encoder._ids = lambda strings: (asked.extend(strings), ids_of(strings))[1]
    for text in texts:
        assert next(encoder.encode(pa.array([text]))).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert [sum(s.count(w) for s in asked) for w in ("ofonesthnt", "Ñieesdo", "éoireaux", "Und")] == [1, 1, 1, 1]


def test_library_encoder_forgets(tokenizer, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("ab é日,.\n'9  ") for _ in range(r.randint(0, 80))) for _ in range(1500)]
    monkeypatch.setattr(tokenfile, "GATHERED", 7)
    for known_bytes in (10**6, 2_000):
        monkeypatch.setattr(tokenfile, "KNOWN_BYTES", known_bytes)
        encoder = tokenfile.LibraryEncoder("byte_bpe_50k.json", 200, 100)
        for at in range(0, len(texts), 50):
            some = pa.array(["", *texts[at : at + 50]]).slice(1)
            for text, ids in zip(some.to_pylist(), encoder.encode(some), strict=True):
                assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
            assert len(encoder.parts.names) <= 200 and len(encoder.words.names) <= 100 and encoder.parts.names.nbytes <= known_bytes


def test_known_strings_keep_their_ids():
    fail = True

    def make(strings):
        if fail:
            raise MemoryError
        return np.array([int(s) for s in strings.to_pylist() for _ in range(int(s) % 3)], np.uint32), np.array([int(s) % 3 for s in strings.to_pylist()])

    known = tokenfile.Known(6, make)
    array = lambda *values: pa.array(map(str, values), pa.large_string())
    with pytest.raises(MemoryError):
        known.ids(array(7, 8))
    fail = False
    for values in ((8, 7, 8), (), (5, 6), (8, 8, 5), (10, 11, 12, 13), (8, 5, 14)):
        ids, lengths = known.ids(array(*values))
        assert ids.tolist() == [v for v in values for _ in range(v % 3)] and lengths.tolist() == [v % 3 for v in values]
    assert {"8", "5"} <= set(known.names.to_pylist())


def test_white_space_of_token_files():
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    white = pc.match_substring_regex(pa.array(every), f"[{tokenfile._WHITE}]").to_pylist()
    assert white == [c.isspace() for c in every]
    r = random.Random(6)
    texts = ["".join(r.choice(" \n\t\r\x0b\x1f\xa0\u2003ab") for _ in range(r.randint(0, 8))) for _ in range(3000)]
    assert pc.match_substring_regex(pa.array(texts), f"[{tokenfile._WHITE}] ").to_pylist() == [bpe.crosses(t) for t in texts]


class Asked(dict):
    """A dict that counts how often it is asked."""

    times = 0

    def get(self, *a):
        self.times += 1
        return super().get(*a)

    def __getitem__(self, key):
        self.times += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.times += 1
        return super().__contains__(key)


def test_known_parts_are_looked_up_once():
    memo = bpe.Memo(1000)
    make = lambda strings: (np.array([len(s) for s in strings], np.uint32), np.ones(len(strings), np.int64))
    names = [f"part{'x' * i}" for i in range(50)]
    rows = memo.find([*names, *names[:5]], make)
    assert memo.flat[rows].tolist() == [4 + i for i in [*range(50), *range(5)]]
    memo.codes = Asked(memo.codes)
    rows = memo.find([*names[::-1], "new", "new"], make)
    assert memo.flat[rows].tolist() == [*(4 + i for i in range(49, -1, -1)), 3, 3]
    assert memo.codes.times == 50 + 2 + 2
    names, at, begin = bpe.parts_of(pa.array(["é b  c", "a b é", "", "b a"], pa.large_string()), bpe.regex.compile(public_tokenizers.PATTERN))
    assert ["".join(names[k] for k in at[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)] == ["é b  c", "a b é", "", "b a"]


def test_token_files_keep_added_tokens(spark, tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n z", "plain text", " two  spaces", "<|endoftext"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokenfile.read_documents(tokenfile.write_shards(df, common.shared_dir(spark))).collect()}
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert got[i].n_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert 50256 in tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_token_files_odd_rows(spark):
    df = odd(spark, start="clash")
    got = tokenfile.read_documents(tokenfile.write_shards(df, common.shared_dir(spark))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7] and got[1].n_tokens == 1
    assert tokenfile.read_documents(tokenfile.write_shards(df.limit(0), common.shared_dir(spark))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 513, 5000])
def test_wavelet_matrix(n):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % 50257).astype(np.uint32)
    m = tokenfile.WaveletMatrix.from_bytes(tokenfile.WaveletMatrix.build(ids).to_bytes())
    assert (m.ids() == ids).all() and [m.access(i) for i in range(min(n, 300))] == ids[:300].tolist()
    for v in {*ids[:10].tolist(), 50000, 1 << 20}:
        places = np.flatnonzero(ids == v)
        assert m.rank(v, n) == len(places) and m.rank(v, n // 2) == (places < n // 2).sum()
        assert [m.select(v, k) for k in range(min(len(places), 4))] == places[:4].tolist()
    with pytest.raises(IndexError):
        m.select(50000, n)


def plain_removal(docs, window):
    first = {}
    for i, words in docs.items():
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, words in docs.items():
        gone = {k + j for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < i for j in range(window)}
        out[i] = (len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("window,filter_bits", [(4, 1 << 16), (13, 1 << 10), (6, 1 << 20)])
def test_substring_dedup(spark, window, filter_bits, monkeypatch):
    r = random.Random(window)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(10, 40))) for _ in range(6)]
    texts = {i: " ".join(r.choice([r.choice(pool), "x y " * r.randint(1, 15), " ".join(f"u{r.randint(0, 10**6)}" for _ in range(9))]) for _ in range(r.randint(0, 6))) for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    monkeypatch.setattr(substrings.removals, "__defaults__", (filter_bits,))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.without_repeats(df, window).collect()}
    assert got == plain_removal({i: t.encode().split() for i, t in texts.items()}, window)


def test_substring_shards_follow_the_anchors(spark, monkeypatch):
    r = random.Random(5)
    pool = [" ".join(f"w{r.randint(0, 300)}" for _ in range(40)) for _ in range(30)]
    texts = {i: " ".join(r.choice(pool) for _ in range(3)) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    _, passing = substrings.shared_anchors(common.keyed_texts(df), 13, 1 << 20)
    words = [t.encode().split() for t in texts.values()]
    found = [set(substrings.anchors(common.word_hashes(w), np.zeros(len(w), np.int64), 13)[0].tolist()) for w in words]
    assert passing == sum(sum(a in f for f in found) > 1 for a in set().union(*found))
    seen = []
    monkeypatch.setattr(substrings, "SHARD_ANCHORS", 2)
    real = substrings.segments
    monkeypatch.setattr(substrings, "segments", lambda *a: seen.append(a[3]) or real(*a))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.without_repeats(df).collect()}
    assert seen == [-(-passing // 2)] and seen[0] > 4 * common.shuffle_partitions(spark)
    assert got == plain_removal({i: t.encode().split() for i, t in texts.items()}, 13)


def test_substring_dedup_words_beyond_the_characters(spark):
    # one shard with more different words than there are characters
    shared = b"a b c d"
    rows = [b" ".join(b"%x" % x for x in range(10**6 + 40 * i, 10**6 + 40 * i + 40)) for i in range(30_000)]
    blob = b"\n".join([*rows, b"u " + shared, b"v w " + shared])
    n = len(rows)
    value = common.pack(np.array([1, 2, 3], np.int64), np.array([0] * n + [1, 2], np.uint64), np.zeros(n + 2, np.uint64), np.arange(n + 2, dtype=np.uint64), np.frombuffer(blob, np.uint8))
    found = spark.createDataFrame([(0, bytearray(value))], "shard int, packed binary")
    assert [(r.doc_id, r.starts) for r in substrings.locate(found, 4).collect()] == [(3, [2])]


@pytest.mark.parametrize("characters", [40, 12])
def test_substring_dedup_in_several_automata(characters, monkeypatch):
    monkeypatch.setattr(substrings, "CHARACTERS", characters)
    flat = np.random.default_rng(characters).integers(0, 60, 400)
    firsts = np.arange(0, 396, 5)
    got = []
    for run, used in substrings.phrase_batches(flat, firsts, 4):
        assert len(used) <= characters
        text = substrings.as_text(flat, used)
        got += [end - 3 for end, _ in substrings.automaton(text, firsts[run], firsts[run], 4).iter(text)]
    phrases = {tuple(flat[i : i + 4]) for i in firsts}
    assert sorted(got) == [i for i in range(397) if tuple(flat[i : i + 4]) in phrases]


@pytest.mark.parametrize("window", [1, 2, 5, 11, 20])
def test_substring_automata_find_every_phrase(spark, window):
    r = random.Random(window)
    pool = [[r.choice("abc") for _ in range(40)] for _ in range(4)]
    docs = {}
    for i in range(40):
        source, at = r.choice(pool), r.randint(0, 40 - window)
        docs[i] = [*(f"u{r.randint(0, 500)}" for _ in range(r.randint(0, 3))), *source[at : at + window + r.randint(0, 9)], *(r.choice("abcde") * r.randint(0, 25))]
    docs = {i: [w.encode() for w in words] for i, words in docs.items()}
    n = np.arange(len(docs), dtype=np.uint64)
    value = common.pack(np.array(list(docs), np.int64), n, np.zeros(len(n), np.uint64), n, np.frombuffer(b"\n".join(map(b" ".join, docs.values())), np.uint8))
    found = spark.createDataFrame([(0, bytearray(value))], "shard int, packed binary")
    first = {}
    for i, words in docs.items():
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    wanted = {i: [k for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i] for i, w in docs.items()}
    assert {x.doc_id: x.starts for x in substrings.locate(found, window).collect()} == {i: at for i, at in wanted.items() if at}


def test_substring_automata_have_short_paths_and_few_branches(monkeypatch):
    # building one was most of the work: a node for each word of each phrase, all first words at the root
    built = []
    real = substrings.automaton
    monkeypatch.setattr(substrings, "automaton", lambda *a: built.append(real(*a)) or built[-1])

    class Table:
        groupBy = lambda self, _: self
        applyInArrow = lambda self, f, _: f

    words = [b"%x" % x for x in np.random.default_rng(1).permutation(4000)]
    copies = b"\n".join(b" ".join(words[i : i + 40]) for i in range(0, 4000, 40))
    n = 100
    value = common.pack(np.array([1, 2], np.int64), np.repeat(np.arange(2, dtype=np.uint64), n), np.zeros(2 * n, np.uint64), np.tile(np.arange(n, dtype=np.uint64), 2), np.frombuffer(copies, np.uint8))
    out = substrings.locate(Table(), 13)(pa.table({"shard": pa.array([0], pa.int32()), "packed": pa.array([value], pa.binary())}))
    assert out.to_pylist() == [{"doc_id": 2, "starts": sorted(list(range(28)) * n)}]
    (patterns,) = built
    phrases = len(patterns)
    branches = Counter(begin for begin, _, _ in patterns.dump()[1])
    assert phrases == 28 * n and patterns.get_stats()["nodes_count"] < 8 * phrases and max(branches.values()) < 2 * (3 * phrases) ** 0.5


def test_substring_dedup_odd_rows(spark):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.without_repeats(odd(spark, starts=1)).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (0, 0), 5: (14, 0), 6: (3, 0), 7: (1, 0)} | {6: (len("日本語 \x1c text".encode().split()), 0)}
    assert substrings.without_repeats(odd(spark).limit(0)).count() == 0


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_blocks(reference_encoding):
    r = random.Random(3)
    parts = " \n\t  aab'sé日1299!?#\x0b\x1c\U0001f600\xa0"
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, "ab" * 3000, " " * 50 + "x", "日" * 300, "", "<|endoftext|>"]
    words = bpe.merges("byte_bpe_50k.tiktoken")
    encoder = bpe.Encoder(public_tokenizers.PATTERN, bpe.replayed(words, public_tokenizers.PATTERN), 400)
    for at in range(0, len(texts), 97):
        some = texts[at : at + 97]
        ids, begin = encoder.encode(pa.array(some))
        for text, a, b in zip(some, begin[:-1], begin[1:], strict=True):
            assert ids[a:b].tolist() == reference_encoding.encode_ordinary(text)
            assert words.decode(ids[a:b]) == text.encode()


def test_heaviest(spark):
    rows = [(f"k{i:02d}", 5 if i % 2 else 7) for i in range(20)] + [("big", 900), ("none", 0)]
    df = spark.createDataFrame(rows, "k string, n long")
    for k in (0, 1, 5, 14, 30):
        assert {r.k for r in common.heaviest(df, "n", "k", k).collect()} == {x for x, _ in sorted((r for r in rows if r[1]), key=lambda r: (-r[1], r[0]))[:k]}


def test_slices():
    texts = ["a" * 10, None, "b" * 95, "", "c" * 40, "d" * 40, "e" * 40]
    batch = pa.RecordBatch.from_pydict({"i": pa.array(range(7)), "t": pa.array(texts)})
    cut = list(common.slices(iter([batch, batch.slice(0, 0)]), 1, 100, 5))
    assert [x.column(0).to_pylist() for x in cut if x.num_rows] == [[0, 1], [2, 3], [4], [5, 6]]


def test_workers_give_back_when_a_task_ends(monkeypatch):
    order = []

    class Table:
        def __del__(self):
            order.append("table gone")

    def run(batches):
        table = Table()  # noqa: F841
        yield from batches

    monkeypatch.setattr(common, "give_back", lambda: order.append("give back"))
    assert list(common.giving_back(run)(iter([1, 2]))) == [1, 2] and order == ["table gone", "give back"]


def test_texts_travel_in_short_batches(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows, want in (("10000", "2000"), ("0", "2000"), ("7", "7")):
            spark.conf.set(name, rows)
            assert bpe.encode(odd(spark)).count() == len(ODD) and spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_bpe_replays_new_parts_of_slices_together(reference_encoding, monkeypatch):
    words = bpe.merges("byte_bpe_50k.tiktoken")
    sizes = []
    make = bpe.replayed(words, public_tokenizers.PATTERN)
    r = random.Random(5)
    texts = ["".join(r.choice(" aaabcdé'\x1c\n\u00a0½日") for _ in range(r.randrange(60))) + r.choice([" x", "  y", "\n", " "]) for _ in range(400)] + ["", "one two's three", "ab " * 50]
    slices = [([i], pa.array(texts[i : i + 50])) for i in range(0, len(texts), 50)]
    for new_parts, waiting in ((10**6, 10**6), (100, 10**6), (10**6, 500)):
        monkeypatch.setattr(bpe, "NEW_PARTS", new_parts)
        monkeypatch.setattr(bpe, "WAITING_PARTS", waiting)
        sizes.clear()
        encoder = bpe.Encoder(public_tokenizers.PATTERN, lambda parts: sizes.append(len(parts)) or make(parts), 50)
        for ([i], ids, begin), (_, some) in zip(encoder.encode_all(iter(slices)), slices, strict=True):
            for text, a, b in zip(texts[i : i + len(some)], begin[:-1], begin[1:], strict=True):
                assert ids[a:b].tolist() == reference_encoding.encode_ordinary(text)
        if new_parts == waiting:  # one replay, although there are nine slices
            assert len(sizes) == 1 and len(encoder.parts.codes) <= encoder.parts.bound
        else:
            assert len(sizes) > 1
    assert list(encoder.encode_all(iter([]))) == []


def test_bpe_on_tables(spark, sf_dir, reference_encoding):
    docs = common.load(spark, sf_dir)
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for row in docs.collect():
        ids = reference_encoding.encode_ordinary(row.text or "")
        g = got[row.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and g.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    odd_docs = odd(spark, ids="clash")
    back = bpe.decode(bpe.encode(odd_docs)).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t in ODD)
    assert bpe.digests(odd_docs).count() == len(ODD) and bpe.digests(odd_docs.limit(0)).count() == 0
