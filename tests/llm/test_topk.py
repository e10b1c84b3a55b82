import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowkin.llm import topk


def brute(rows, k):
    clean = {}
    for i, x in rows:
        if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            v = [math.floor(64 * a) for a in x]
            clean[i] = min(clean[i], v) if i in clean else v
    out = []
    for q, x in clean.items():
        if q % 20 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in clean.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked[:k])]
    return sorted(out)


def got(spark, rows, k=5):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    return sorted(tuple(r) for r in topk.top_products(frame, F.col("vec_id") % 20 == 0, k).collect())


def test_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 40)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) * rng.lognormal(0, 1, 400)[:, None]
    x[50:90] = x[0]
    x[100:120] = 0
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    assert got(spark, rows) == brute(rows, 5)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (3, [1.0, None]), (4, [-1.0, -2.0]),
            (4, [-1.0, -2.0]), (5, [1.0, 2.0]), (7, [1.0, 2.0]), (9, [1.0])]
    assert got(spark, rows) == brute([(i, [*x, 0.0][:2] if x else x) for i, x in rows], 5)
    assert got(spark, rows[:1]) == [] and got(spark, []) == [] and got(spark, rows[-3:]) == []


@pytest.mark.parametrize("floor", [0.3, 0.6, 0.9, 0.99])
def test_pruning_loses_nothing(floor):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6)) + 2 * rng.normal(size=6)
    lengths = np.linalg.norm(x, axis=1)
    order = np.argsort(-lengths)
    x, lengths = x[order], lengths[order]
    unit, q = x / lengths[:, None], x[17]
    least = floor * np.linalg.norm(q) * lengths[0]
    at = set(topk.candidates(unit, lengths, q, np.linalg.norm(q), least).tolist())
    assert set(np.flatnonzero(x @ q >= least).tolist()) <= at
    assert floor < 0.9 or len(at) < 1500


def test_large_components_stay_exact(spark):
    rows = [(0, [1e12, 3.0]), (1, [1e3, 1.0]), (2, [1e3, 0.0]), (random.Random(0).randrange(3, 9), [1e3, 2.0])]
    assert got(spark, rows) == brute([(i, [float(np.float32(v)) for v in x]) for i, x in rows], 5)
