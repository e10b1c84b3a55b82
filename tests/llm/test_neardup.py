import random

from pyspark.sql import functions as F

from rowkin.llm import neardup, shingles


def brute(docs):
    """Components over all pairs, by rows."""
    sets = []
    for _, text in docs:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (doc, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if group[j] == group[i] and docs[j][0] is not None]
        low = min(ids) if ids else None
        out.append((doc, len(sets[i]), low, doc is not None and doc == low))
    return sorted(out, key=repr)


def got(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("v", F.lit(1))
    return sorted((tuple(r) for r in neardup.near_duplicates(frame).collect()), key=repr)


def corpus(seed=1, groups=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(60)]
    docs = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice((3, 6, 60, 200)))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.choice((1, 1, 2, 12))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 6))):
                copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs), " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
    return docs


def test_equals_all_pairs(spark):
    docs = corpus()
    assert got(spark, docs) == brute(docs)


def test_edge_cases(spark):
    docs = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE two"), (10, "one two three"), (None, "one two"), (None, None),
            (11, "x " * 50), (3, "x " * 60), (3, "x " * 60), (12, "a b c d e f"), (13, "Été été")]
    assert got(spark, docs) == brute(docs)
    assert got(spark, []) == []


def test_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)], "a long, b long")
    roots = {r.v: r.root for r in neardup.components(links).collect()}
    assert all(roots[i] == 0 for i in range(301)) and all(roots[1000 + i] == 1000 for i in range(50)) and len(roots) == 351
    assert neardup.components(links.limit(0)).count() == 0


def test_a_very_long_text_needs_slices_only():
    text = " ".join(f"w{i}" for i in range(30_000))
    found = shingles.shingle_set(text, shingles.WordHashes())
    assert len(found) == 29_996
    a, b = shingles.Sketcher(32, 4), shingles.Sketcher(32, 4)
    assert (a.half_keys(found) == b.half_keys(found)).all()


def test_a_set_that_most_pairs_name(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS_PER_SALT", 4)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    docs = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1:]])) for i in range(60)] + [(100 + i, " ".join(rng.sample(base, 40))) for i in range(10)]
    assert got(spark, docs) == brute(docs)


def test_clashing_names_are_kept(spark):
    docs = [(1, "a b c d e f g", 7), (2, "a b c d e f g", 8), (None, "", 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, _row long").withColumn("text_row", F.lit("x")).withColumn("component_id", F.lit(3))
    kept = neardup.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted((tuple(r)[:3] for r in kept.collect()), key=repr) == sorted([docs[0], docs[2]], key=repr)
