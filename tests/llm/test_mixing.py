import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowkin.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TARGETS = {"good": 0.7, "bad": 0.3}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.3
        source = rng.choice("ab") if rng.random() < 0.2 else ("a" if good else "b")
        text = " ".join(rng.choice(("w", "word", "x1", "#")) if not good else "word" for _ in range(rng.randrange(1, 400)))
        docs.append((i, text, rng.choice(("en", "fr")), source, len(text)))
        if i % 2:
            labels.append((i, "good" if good else "bad"))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, domain string")


def brute_posteriors(spark, docs, labels):
    """Naive Bayes with dictionaries over the same features."""
    rows = mixing.with_features(spark.createDataFrame(docs, DOCS)).collect()
    known = dict(labels)
    domains = sorted(TARGETS)
    prior = Counter(known[r.doc_id] for r in rows if r.doc_id in known)
    out = {}
    for r in rows:
        logs = [math.log((prior[d] + 1) / (sum(prior.values()) + 2)) for d in domains]
        for f in mixing.FEATURES:
            values = len({x[f] for x in rows})
            for i, d in enumerate(domains):
                seen = sum(x[f] == r[f] and known.get(x.doc_id) == d for x in rows)
                logs[i] += math.log((seen + 1) / (prior[d] + values))
        odds = np.exp(np.array(logs) - max(logs))
        out[r.doc_id] = odds / odds.sum()
    return out


def test_posteriors_equal_dictionaries(spark):
    docs, labels = corpus(60)
    want = brute_posteriors(spark, docs, labels)
    for r in mixing.mix(*frames(spark, docs, labels), TARGETS).collect():
        assert [r.p_bad, r.p_good] == pytest.approx(want[r.doc_id].tolist(), abs=1e-9)


def test_expected_tokens_match_reachable_targets(spark):
    got = mixing.mix(*frames(spark, *corpus()), TARGETS).collect()
    total = sum(r.tokens for r in got)
    for d, share in TARGETS.items():
        assert sum(r.rate * r.tokens * r[f"p_{d}"] for r in got) / total == pytest.approx(share, abs=1e-4)
    assert all(0 <= r.rate <= mixing.MAX_RATE for r in got)


def test_unreachable_targets_get_the_least_squares(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet((8, 2, 1), 12)
    t = rng.integers(1, 50, 12).astype(float)
    goal = np.array([0.2, 0.79, 0.01])
    cells = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(t, p)], f"{mixing.TOKENS} double, p array<double>")
    rates = np.array([r.rate for r in mixing.fit_rates(cells, goal.tolist()).orderBy(mixing.TOKENS, "p").collect()])
    order = sorted(range(12), key=lambda i: (t[i], p[i].tolist()))
    a = (t[order, None] * p[order] / t.sum()).T
    best = np.ones(12)
    for _ in range(200_000):
        best = np.clip(best - a.T @ (a @ best - goal) / np.linalg.norm(a, 2) ** 2, 0, mixing.MAX_RATE)
    error = lambda r: ((a @ r - goal) ** 2).sum()
    assert error(rates) <= error(best) * 1.02 + 1e-9


def test_nulls_repeats_no_labels_and_empty(spark):
    docs = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0)]
    frame, none = frames(spark, docs, [(9, "good"), (None, "bad"), (2, None), (1, "other")])
    got = mixing.mix(frame.withColumn("rate", F.lit("clash")), none, TARGETS).collect()
    assert len(got) == 4 and all(r.p_good == r.p_bad == 0.5 for r in got)
    assert mixing.mix(frame.limit(0), none, TARGETS).count() == 0
    assert mixing.take(frame.limit(0), none, TARGETS).columns == frame.columns


def test_take_follows_the_rates(spark):
    docs, labels = corpus(600)
    frame, marks = frames(spark, docs, labels)
    rates = {r.doc_id: r.rate for r in mixing.mix(frame, marks, TARGETS).collect()}
    taken = mixing.take(frame, marks, TARGETS)
    often = Counter(r.doc_id for r in taken.collect())
    assert taken.columns == frame.columns
    assert all(math.floor(rates[i]) <= often[i] <= math.floor(rates[i]) + 1 for i in rates)
    assert sum(often.values()) == pytest.approx(sum(rates.values()), rel=0.1)


def test_no_python_on_the_path(spark):
    plan = mixing.mix(*frames(spark, *corpus(20)), TARGETS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def worded(n=400):
    """Documents alike but for a word that half of the bad ones have."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = [rng.choice(("one", "two", "six")) for _ in range(60)] + (["Vile!"] if bad and i % 8 == 0 else ["fine"])
        docs.append((i, " ".join(text), "en", "a", 0))
        if i % 3:
            labels.append((i, "bad" if bad else "good"))
    return [*docs, (None, None, None, None, None), docs[8]], labels


@pytest.mark.parametrize("cells", [mixing.CELLS, 1])
def test_words_tell_documents_apart(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    docs, labels = worded()
    targets = {"good": 0.95, "bad": 0.05}
    got = mixing.mix(*frames(spark, docs, labels), targets, words=True).collect()
    assert len(got) == len(docs)
    vile = [r for r in got if r.doc_id is not None and r.doc_id % 8 == 0]
    other = [r for r in got if r.doc_id is not None and r.doc_id % 8]
    assert min(r.p_bad for r in vile) > 0.9 and max(r.p_bad for r in other) < 0.3
    assert max(r.rate for r in vile) < min(r.rate for r in other)
    coarse = mixing.mix(*frames(spark, docs[:400], labels), targets).collect()
    assert max(r.p_bad for r in coarse) < 0.5


def test_word_weights_equal_dictionaries(spark):
    docs, labels = worded()
    seen, of, known = Counter(), Counter(), dict(labels)
    for i, text, *_ in docs:
        if i in known:
            of[known[i]] += 1
            seen.update((w, known[i]) for w in set(text.lower().replace("!", "").split()))
    want = {}
    for word in {w for w, _ in seen}:
        a, b = seen[word, "bad"] + 0.5, seen[word, "good"] + 0.5
        n, m = of["bad"] + 1, of["good"] + 1
        ratio = math.log(a / n) - math.log(b / m)
        if abs(ratio) > mixing.SURE * math.sqrt(1 / a - 1 / n + 1 / b - 1 / m):
            want[word] = (round(ratio * mixing.WORD_UNIT), -round(ratio * mixing.WORD_UNIT))
    got = mixing.word_weights(*frames(spark, docs, labels), ["bad", "good"]).collect()
    assert {r.word: (r.w0, r.w1) for r in got} == want and set(want) == {"vile", "fine"}


def test_take_by_words_follows_the_rates(spark):
    docs, labels = worded()
    frame, marks = frames(spark, docs, labels)
    rates = {r.doc_id: r.rate for r in mixing.mix(frame, marks, TARGETS, words=True).collect()}
    taken = mixing.take(frame, marks, TARGETS, words=True)
    often = Counter(r.doc_id for r in taken.collect())
    assert taken.columns == frame.columns and often == Counter(r.doc_id for r in taken.collect())
    assert all(math.floor(rates[i]) <= often[i] <= math.floor(rates[i]) + 1 for i in rates if i is not None and i != 8)
    assert mixing.take(frame.limit(0), marks, TARGETS, words=True).count() == 0


def test_no_python_on_the_path_of_words(spark):
    plan = mixing.mix(*frames(spark, *worded(40)), TARGETS, words=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_form_equals_dictionaries(spark):
    """Weights from one fold, levels per document, posteriors from the other fold, and the misses of the rates."""
    docs, labels = worded()
    docs, targets = docs[:400], {"good": 0.8, "bad": 0.2}
    frame, marks = frames(spark, docs, labels)
    learns = {r.doc_id for r in frame.where(mixing._learns_words(F.col("doc_id"))).select("doc_id").collect()}
    words = {i: set(text.lower().replace("!", "").split()) for i, text, *_ in docs}
    known, domains = dict(labels), ["bad", "good"]
    of, seen = Counter(), Counter()
    for i in known.keys() & learns:
        of[known[i]] += 1
        seen.update((w, known[i]) for w in words[i])
    weight = {}
    for w in {w for w, _ in seen}:
        for d, e in (domains, domains[::-1]):
            a, b, n, m = seen[w, d] + 0.5, seen[w, e] + 0.5, of[d] + 1, of[e] + 1
            ratio = math.log(a / n) - math.log(b / m)
            if abs(ratio) > mixing.SURE * math.sqrt(1 / a - 1 / n + 1 / b - 1 / m):
                weight[w, d] = round(ratio * mixing.WORD_UNIT)
    level = {i: "".join(str(sum(sum(weight.get((w, d), 0) for w in own) >= c * mixing.WORD_UNIT for c in mixing.WORD_LEVELS)) for d in domains)
             for i, own in words.items()}
    rows = [{**{f: r[f] for f in mixing.FEATURES}, mixing.WORDS: level[r.doc_id], "i": r.doc_id} for r in mixing.with_features(frame).collect()]
    judged = {i: d for i, d in known.items() if i not in learns}
    prior, odds = Counter(judged.values()), {}
    for r in rows:
        logs = [math.log((prior[d] + 1) / (len(judged) + 2)) for d in domains]
        for f in (*mixing.FEATURES, mixing.WORDS):
            values = len({x[f] for x in rows})
            for k, d in enumerate(domains):
                logs[k] += math.log((sum(x[f] == r[f] and judged.get(x["i"]) == d for x in rows) + 1) / (prior[d] + values))
        odds[r["i"]] = math.exp(logs[0] - max(logs)) / sum(math.exp(x - max(logs)) for x in logs)
    got = mixing.mix(frame, marks, targets, words=True)
    found = got.collect()
    assert len(set(level.values())) > 1 and {r.doc_id: r.p_bad for r in found} == pytest.approx(odds, abs=1e-9)
    total = sum(r.tokens for r in found)
    for r in mixing.misses(got, targets).collect():
        share = sum(x.rate * x.tokens * x[f"p_{r.domain}"] for x in found) / total
        assert (r.target, r.expected, r.miss) == pytest.approx((targets[r.domain], share, share - targets[r.domain]))
        assert abs(r.miss) < 1e-4


def test_a_rare_domain_reaches_its_target(spark):
    """A domain with a fiftieth of its target needs rates far over any small bound."""
    docs = [(i, "word " * 50, "en", "rare" if i % 100 == 0 else "common", 250) for i in range(600)]
    labels = [(i, "bad" if i % 100 == 0 else "good") for i in range(600)]
    got = mixing.mix(*frames(spark, docs, labels), {"good": 0.5, "bad": 0.5})
    assert all(abs(r.miss) < 1e-3 for r in mixing.misses(got, {"good": 0.5, "bad": 0.5}).collect())
    assert got.agg(F.max("rate")).first()[0] > 20


def test_the_sample_is_bounded(spark):
    known = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("good").alias("domain"))
    assert 350 < mixing.sampled(known, 500).count() < 650 and mixing.sampled(known, 5_000).count() == 5_000
