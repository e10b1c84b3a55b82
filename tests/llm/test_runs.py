"""Periodic runs against their definition, and the registered query against plain Python."""

import hashlib
import random
import zlib

import pytest

from rowkin.llm import runs
from rowkin.llm.registry import QUERIES, with_planted_runs
from rowkin.llm.tables import given

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def by_definition(words):
    """Every stretch of matches at every lag, kept if its smallest period is the lag."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            run = words[start: start + length]
            if length >= max(6, 4 * q) and all(run[p:] != run[:-p] for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words, found):
    dropped = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_runs_follow_their_definition():
    rng, total = random.Random(3), 0
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            words = [str(rng.randrange(rng.choice([1, 2, 3, 5, 50]))) for _ in range(rng.randrange(0, 120))]
            for _ in range(rng.randrange(0, 4)):
                at, period = rng.randrange(0, len(words) + 1), [str(rng.randrange(3)) for _ in range(rng.randrange(1, 20))]
                words[at:at] = [period[j % len(period)] for j in range(rng.randrange(0, 6 * len(period) + 1))]
            texts.append(" ".join(words))
        for text, (n, found, rest) in zip(texts, runs.detect(texts), strict=True):
            words = text.split()
            wanted = by_definition(words)
            total += len(wanted)
            assert n == len(words) and [tuple(r) for r in found] == wanted and rest == without_repeats(words, wanted)
    assert total > 500


def test_a_period_whose_five_word_parts_all_come_twice():
    """Neighbouring occurrences of short parts have lags below the period."""
    half = "a b c d e f g h i j"
    period = f"{half} {half} x {half} {half} y"
    (_, found, _), = runs.detect([" ".join([period] * 5)])
    assert (0, 5 * 42, 42) in found


@pytest.mark.parametrize("word", ["a", "a b", "a b c"])
def test_a_very_long_run(word):
    text = " ".join([word] * 300_000)
    (n, found, rest), = runs.detect([text])
    assert found == [(0, n, n // 300_000)] and rest == word


def test_dirty_rows(spark):
    rows = [(1, None), (None, "a a a a a a"), (2, ""), (2, " \n\t "), (3, "é é é é é é\x1cx"), (3, "b " * 7)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA + ", n_words int, runs string")
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(docs).collect())
    assert got == sorted([
        ("1", 0, [], ""), ("None", 6, [(0, 6, 1)], "a"), ("2", 0, [], ""), ("2", 0, [], ""),
        ("3", 6, [], "é é é é é é\x1cx"), ("3", 7, [(0, 7, 1)], "b")])
    assert runs.find_runs(docs.limit(0)).count() == 0


def planted(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return [w.decode() for w in words]


def test_query_against_plain_python(spark):
    sha, long, docs = lambda t: hashlib.sha256(t.encode()).hexdigest(), 0, given(spark, FOLDER, "documents").collect()
    got = {r.doc_id: r for r in QUERIES["op11_runs"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for doc in docs:
        words, row = planted(doc.doc_id, doc.text), got[doc.doc_id]
        if len(words) > 3_000:
            long += 1
            continue
        found = by_definition(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert row.collapsed_sha256 == sha(without_repeats(words, found))
    assert long < 10 and sum(r.n_runs > 0 for r in got.values()) > 5


def test_planting_leaves_other_texts_alone(spark):
    docs = spark.createDataFrame([(i, f"a  b\nc {i} d e f g h") for i in range(40)] + [(None, "x y z")], SCHEMA)
    for row in with_planted_runs(docs).collect():
        if row.doc_id is not None:
            assert row.text.split() == planted(row.doc_id, f"a  b\nc {row.doc_id} d e f g h")
