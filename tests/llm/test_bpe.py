import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowkin.llm import bpe, units

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t", "Hello world, hello WORLD!", "it's we'll I'd 12345 x2", "été Été ÉTÉ ñ ß İ Σας ΟΔΟΣ", "a b c\x1cd\x85e",
         "<|endoftext|> x<|startoftext|>y <|endoftext|", "\U0001f600\U0001f468‍\U0001f469 日本語 한국어", "̸́ ̸≠", "a" * 3000,
         "Hello world, hello WORLD!", "﻿bom � \x00nul", "word " * 4000]


def corpus():
    rng = random.Random(1)
    alphabet = "abcdeßéñ'.,!1 2\n<|>"
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(80)]


def brute(text):
    tokenizer = Tokenizer.from_file(PATH)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("chars", [bpe.UNIT_CHARS, 500])
def test_equals_the_library(spark, chars):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(corpus())]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("part", F.lit("clash"))
    got = sorted(((r.doc_id, list(r.ids), r.decoded, r.n_tokens) for r in bpe.encode(frame, PATH, chars).collect()), key=repr)
    assert got == sorted(((i, *brute(t), len(brute(t)[0])) for i, t in rows), key=repr)


def test_shuffled_input_and_empty_table(spark):
    frame = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(frame.repartition(5), PATH, 300).collect()}
    assert got == {i: brute(t)[0] for i, t in enumerate(corpus())}
    assert bpe.encode(frame.limit(0), PATH).count() == 0


def test_decode_joins_pieces(spark):
    encoded = bpe.encode(spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string"), PATH)
    rows = encoded.select(F.col("doc_id").alias("row_key"), "ids").collect() + [(-1, None), (-2, [10**8, 5])]
    got = {r.row_key: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "row_key long, ids array<int>"), PATH).collect()}
    want = {i: brute(t)[1] for i, t in enumerate(corpus())} | {-1: "", -2: Tokenizer.from_file(PATH).id_to_token(5)}
    assert got == want


def test_each_word_is_encoded_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(bpe, "encoded", lambda words, path: seen.extend(words) or [[0]] * len(words))
    import pandas as pd

    group = pd.DataFrame({"part": [0, 0], "fold": 0, "unit": [0, 1], "block": 3, "words": ["a b", "b c"]})
    got = bpe._answer(PATH)(group)
    assert [units.from_planes(i, 3).tolist() for i in got["ids"]] == [[0, 0], [0, 0]] and sorted(seen) == ["a", "b", "c"]


def test_digests(spark):
    r = bpe.digests(spark.createDataFrame([(1, 2, [7, 8], "a b"), (2, 0, [], "")], "doc_id long, n_tokens long, ids array<int>, decoded string")).orderBy("doc_id").collect()
    assert r[0].ids_sha256 == hashlib.sha256(b"7 8").hexdigest() and r[1].ids_sha256 == r[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_block_may_forget(spark, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode(frame, PATH, 300, remembered=5).collect()}
    assert got == {i: brute(t) for i, t in enumerate(corpus())}


def test_word_ids_by_word():
    known = bpe.WordIds(PATH, remembered=3)
    for words in (["a", "hello"], [], ["hello", "xyzzy12"], ["\x00"], ["a", "b", "c", "d"], ["hello", "a"]):
        sizes, ids = known.of([w.encode() for w in words])
        want = [brute(w)[0] for w in words]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_are_dealt_once_and_sorted_per_block():
    words = [f"w{i}\u00e9".encode() for i in range(200)]
    got = bpe.dealt(reversed(words), 7)
    assert sorted(w for block in got for w in block) == sorted(words)
    assert all(block == sorted(block) for block in got) and sum(map(bool, got)) > 1
