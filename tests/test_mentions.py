"""Linking by keys found in texts, and the similarity join of sets, against plain Python."""

import math
import random
from collections import Counter

import pytest

from rowkin.operators import mentions, setjoin

TEXTS = [
    ("a", "write to Ann@X.com or call +54 (11) 4555-1234."), ("b", "ann@x.com, +541145551234"), ("c", "+54 11 4555 1234 bob@y.org"),
    ("d", "bob@y.org and eve@z.net"), ("e", "nothing @ all, 1234567890"), ("f", None), (None, "ann@x.com"), ("g", ""), ("h", "ann@x.com ann@x.com"),
    *[(f"r{i:02d}", f"role@x.com only{i}@q.net") for i in range(60)],
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t, 1) for k, t in TEXTS], "entity_key string, text string, key int").drop("key")


def test_links_and_hubs(texts):
    rooted, found, keys = mentions.linked(texts, hub=50, least=4.0)
    assert {r.entity_key: r.root_key for r in rooted.collect() if not r.entity_key.startswith("r")} == {"a": "a", "b": "a", "c": "a", "d": "a", "h": "a"}
    assert all(r.entity_key == r.root_key for r in rooted.collect() if r.entity_key.startswith("r"))
    assert [tuple(r) for r in mentions.hubs(keys).collect()] == [("e:role@x.com", 60, 1_770)]
    weights = {r.key: r.weight for r in keys.collect()}
    assert weights["e:bob@y.org"] == pytest.approx(math.log2(len(TEXTS) / 2))
    assert [tuple(r) for r in mentions.survivors(rooted, found).collect()] == [("a", 5, "ann@x.com", "541145551234")]


def test_weights_add_up(texts):
    """A key of three of 69 records weighs 4.5, one of two 5.1; a and b share two of three."""
    _, found, keys = mentions.linked(texts)
    got = {(r.left_key, r.right_key): r.shared for r in mentions.links(found, keys, 5.0).collect()}
    assert got == {("a", "b"): 2, ("c", "d"): 1}
    assert mentions.links(found, keys, 1e9).isEmpty()


def test_no_texts(texts):
    rooted, found, keys = mentions.linked(texts.limit(0))
    assert rooted.isEmpty() and keys.isEmpty() and mentions.survivors(rooted, found).isEmpty()


def all_pairs(rows, percent):
    sets = {(b, tuple(sorted({w for w in t if w is not None}))) for b, t in rows if b is not None and t is not None}
    out = set()
    for b, x in sets:
        for c, y in sets:
            if b == c and x and x < y:
                shared = len(set(x) & set(y))
                total = len(set(x) | set(y))
                if 100 * shared >= percent * total:
                    out.add((b, x, y, shared, total))
    return out


@pytest.mark.parametrize("percent", [34, 50, 60, 75, 100])
def test_similar_sets_equal_all_pairs(spark, percent):
    rng = random.Random(percent)
    rows = [(rng.choice(["x", "y", None]), [rng.choice("abcdefghijklmnop"[: rng.choice([3, 16])]) for _ in range(rng.randrange(7))]) for _ in range(250)]
    rows += [("x", None), ("x", []), ("x", [None]), ("x", ["a", "a"]), ("x", ["a"])]
    got = setjoin.similar_sets(spark.createDataFrame(rows, "block string, tokens array<string>"), percent).collect()
    assert len(got) == len({(r.block, tuple(r.left_tokens), tuple(r.right_tokens)) for r in got})
    assert {(r.block, tuple(r.left_tokens), tuple(r.right_tokens), r.shared, r.total) for r in got} == all_pairs(rows, percent)


def test_a_block_of_twenty_thousand(spark):
    """One block of 20,000 names: equal to the pairs that an index of single words finds."""
    rng = random.Random(9)
    names = sorted({tuple(sorted({f"g{rng.randrange(300)}", f"f{rng.randrange(900)}", f"s{rng.randrange(5000)}"})) for _ in range(20_000)})
    rows = [("all", list(n)) for n in names] + [("all", list(names[0]))] * 500
    by_word, want = {}, set()
    for n in names:
        for w in n:
            by_word.setdefault(w, []).append(n)
    for group in by_word.values():
        for i, x in enumerate(group):
            want |= {(x, y) for y in group[i + 1:] if len(set(x) & set(y)) >= 2}
    got = {(tuple(r.left_tokens), tuple(r.right_tokens)) for r in setjoin.similar_sets(spark.createDataFrame(rows, "block string, tokens array<string>"), 50).collect()}
    assert got == {tuple(sorted(p)) for p in want} and Counter(map(len, got)) == {2: len(got)}
