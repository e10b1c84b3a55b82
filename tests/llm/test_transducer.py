"""Token counts against the library whose vocabulary is compiled."""

import random

import numpy as np
import pytest

from rowkin.llm import transducer
from rowkin.llm.registry import QUERIES, vocabulary
from rowkin.llm.tables import given

FOLDER = "/root/testdata/sf0.001"
LETTERS = "aabbcdeinstthre'''  \n\t0129.,!?-éÉßİ̧́ǅ中文字日本٠¼ªºᾳΣςK ᠎\x1c\x85ꟲ🙂한ᅡᆨ"
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'re", "'ll", "'ve", "'r", "the", "ing", "<|", "Word."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(vocabulary())
    loaded.no_truncation()
    loaded.no_padding()
    return lambda text: len(loaded.encode(text or "", add_special_tokens=False).ids)


def made_up(rng):
    return "".join(rng.choice(LETTERS) if rng.random() < 0.85 else rng.choice(PARTS) for _ in range(rng.randrange(40)))


def test_the_machine_counts_like_the_library(library):
    rng, machine = random.Random(1), transducer.machine(vocabulary())
    for _ in range(4_000):
        text = made_up(rng)
        assert machine.count(text.encode()) == library(text), text


def test_chunks_compose_to_the_whole(library):
    rng, machine = random.Random(2), transducer.machine(vocabulary())
    for _ in range(2_000):
        text = made_up(rng) + rng.choice(["", "x" * 20, "aab" * 9, "中文" * 9])
        parts = transducer.chunks(text, rng.randrange(1, 9), machine.special)
        assert "".join(parts) == text
        state, total = transducer.RESET, 0
        for part in parts:
            state, n = machine.map_from(state, part)
            total += n
        assert total + machine.closed(state) == library(text), parts


def test_the_machine_may_forget(library, monkeypatch):
    monkeypatch.setattr(transducer, "MAX_STATES", 50)
    monkeypatch.setattr(transducer, "MAX_WORDS", 20)
    rng, machine = random.Random(4), transducer.Machine(vocabulary())
    for _ in range(300):
        text = made_up(rng)
        assert machine.count(text.encode()) == library(text)


def test_prefix_scan_composes_in_order():
    rng = np.random.default_rng(5)
    ends, emitted = rng.integers(-1, 4, (13, 4)), rng.integers(0, 9, (13, 4))
    got_ends, got_emitted = transducer.prefix_scan(ends, emitted)
    for s in range(4):
        state, total = s, 0
        for i in range(13):
            if state >= 0:
                state, total = (ends[i, state], total + emitted[i, state]) if ends[i, state] >= 0 else (-1, 0)
            assert got_ends[i, s] == state and (state < 0 or got_emitted[i, s] == total)


@pytest.mark.parametrize("chars", [1, 7, 64, 1 << 16])
def test_rows_of_every_kind(spark, library, chars):
    rng = random.Random(chars)
    texts = [None, "", " \n", "<|endoftext|>", "a" * 500, "ab" * 300, "the cat's 12 " * 30, "中文" * 100, "!?" * 150, "é" * 99,
             "<|endoftext|>" * 20, "don't" * 50, *[made_up(rng) for _ in range(20)], "same", "same"]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = transducer.count_tokens(docs, vocabulary(), chars).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    want = [(i if i % 7 else None, len((t or "").encode()), library(t)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert transducer.count_tokens(docs.limit(0), vocabulary(), chars).count() == 0


def test_query_against_the_library(spark, library):
    got = {r.doc_id: r for r in QUERIES["op13_transducer"](spark, FOLDER).collect()}
    docs = given(spark, FOLDER, "documents").collect()
    assert len(got) == len(docs)
    for doc in docs:
        n, row = library(doc.text), got[doc.doc_id]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((doc.text or "").encode()), n, n > 2048)
