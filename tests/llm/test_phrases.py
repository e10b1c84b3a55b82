"""Collocations against plain counting, with groups of every size."""

import random
import re
from collections import Counter

import pytest

from rowkin.llm import phrases

SCHEMA = "doc_id long, lang string, text string"


def by_counting(rows, top, least=10, covered=50):
    out, by_lang = [], {}
    for _, lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            by_lang.setdefault("und" if lang is None else lang, []).append(re.findall("[^ \t]+", piece))
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i: i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n, found = sum(c for w, c in f.items() if len(w) == 1), []
        candidates = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        for w, a in candidates.items():
            if any(100 * b >= covered * a for v, b in candidates.items() if len(v) > len(w) and w in (v[:2], v[1:])):
                continue
            score, _, left, right = min((10**6 * a * a // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def made_up(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "a", "New", "york", "CITY", "é", "ß", "日本", "in", *(f"w{i}" for i in range(30))]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[: rng.choice([4, 10, 40])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(rng.randrange(60)))
        rows.append((i, rng.choice(["en", "en", "en", "de", None, ""]), text + rng.choice(["new york city ", ""]) * 3))
    return rows


@pytest.mark.parametrize(("unit", "budget"), [(8 << 20, 1_500_000), (500, 40), (3_000, 7), (1, 1_000)])
def test_equals_counting(spark, unit, budget):
    rows = made_up(budget)
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), 50, unit_bytes=unit, budget=budget).collect()
    assert sorted(map(tuple, got)) == by_counting(rows, 50)


def test_dirty_rows(spark):
    rows = [(None, None, None), (1, "en", ""), (2, "en", " .,\t\n"), (3, None, "x y " * 12), (3, None, "x y " * 12), (4, "und", "X Y"), (5, "fr", "seul")]
    docs = spark.createDataFrame([(*r, "?", 1) for r in rows], SCHEMA + ", phrase string, n int")
    got = sorted(map(tuple, phrases.collocations(docs, 5).collect()))
    assert got == by_counting(rows, 5) and {r[0] for r in got} == {"und"}
    assert phrases.collocations(docs.limit(0), 5).count() == 0


def test_ties_go_by_bytes(spark):
    rows = [(i, "en", f"{w}1 {w}2") for w in ("a", "Z", "é", "z") for i in range(11)]
    got = [r.phrase for r in phrases.collocations(spark.createDataFrame(rows, SCHEMA), 3).orderBy("rank").collect()]
    assert got == [r[2] for r in by_counting(rows, 3)] == ["z1 z2", "a1 a2", "é1 é2"]


def test_large_products_are_exact(spark):
    a, left, right = 9_007_199_254_740, 9_007_199_254_741, 9_007_199_254_999
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases._score("l", "r").alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)


def test_a_very_long_text(spark):
    rows = [(1, "en", "one two three. " * 60_000)]
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), 10, unit_bytes=10_000, budget=5_000).collect()
    assert [tuple(r) for r in got] == [("en", 1, "one two three", 60_000, 60_000, 60_000, 180_000, 1_000_000)]
