import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowkin.llm import interpolation as lm


def corpus(n=140, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    after = {w: rng.sample(words, 3) for w in words}
    docs = []
    for i in range(n):
        text, w = [], rng.choice(words)
        for _ in range(rng.randrange(0, 40)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(after[w]) if rng.random() < 0.8 else f"rare{rng.randrange(500)}" if rng.random() < 0.3 else rng.choice(words)
            w = w if w in after else text[-1].lower() if text[-1].lower() in after else words[0]
        docs.append((i, " ".join(text)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "ÄÖ ä b\x0bc")]


FOLD = {2: lm.HELD_OUT, 3: lm.DELETED}


def toks(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w.decode()) for w in (text or "").encode().split()] + [None]


def brute(docs):
    """Counts by dictionaries, weights by EM over single events."""
    fold = {i: FOLD.get(i % 7, lm.LEARNED) for i, _ in docs}

    def counted(folds):
        word, pair = Counter(), Counter()
        for i, text in docs:
            if fold[i] in folds:
                t = toks(text)
                word.update(t)
                pair.update(zip([None, *t], t))
        return word, pair, sum(word.values()), len(word)

    word, pair, n, v = counted({lm.LEARNED})
    events = {}
    for i, text in docs:
        if fold[i] == lm.DELETED:
            t = toks(text)
            for u, w in zip([None, *t], t):
                level = lambda x: 0 if x == 0 else 1 + round(-lm.RESOLUTION * math.log2(x))
                key = (int(math.log2(word[u] + 1)), level(pair[u, w] / max(word[u], 1)), level(word[w] / n))
                events[key] = events.get(key, 0) + 1
    weights = lm.learned_weights(pd.DataFrame([(*k, c) for k, c in events.items()], columns=["bucket", "pair", "word", "n"]), v)
    word, pair, n, v = counted({lm.LEARNED, lm.DELETED})
    out = []
    for i, text in docs:
        t = toks(text)
        total = 0.0
        for u, w in zip([None, *t], t):
            a, b, c = weights[int(math.log2(word[u] + 1))]
            total += math.log10(a * pair[u, w] / max(word[u], 1) + b * word[w] / n + c / (v + 1))
        base = sum(math.log10((word[w] + 1) / (n + v + 1)) for w in t)
        out.append((i, fold[i] == lm.HELD_OUT, len(t), sum(word[w] > 0 for w in t), n, base, total))
    return out


@pytest.mark.parametrize("chars", [lm.UNIT_CHARS, 700])
def test_equals_dictionaries(spark, chars):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in lm.score(frame, F.col("doc_id") % 7 == 2, F.col("doc_id") % 7 == 3, chars).collect())
    want = brute(docs)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_beats_the_base_on_held_out_texts(spark):
    docs = corpus(400)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [r for r in lm.score(frame, F.col("doc_id") % 7 == 2, F.col("doc_id") % 7 == 3, 2000).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_words_and_the_unknown_share_all_probability(spark):
    events = pd.DataFrame([(3, 5, 9, 40.0), (3, 0, 12, 10.0), (5, 2, 9, 7.0)], columns=["bucket", "pair", "word", "n"])
    weights = lm.learned_weights(events, 100)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 2] > 0).all() and weights[0, 0] == 0


def test_empty_null_and_untrained(spark):
    schema = "doc_id long, text string"
    never, always = F.lit(False), F.lit(True)
    assert lm.score(spark.createDataFrame([], schema), never, never).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], schema)
    got = lm.score(rows, always, never).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)
    got = lm.score(rows, never, never).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3] and all(r.n_known == r.n_tokens for r in got)
