"""Areas under the curve of several groups against pairwise counting."""

import random

import pytest

from rowkin.operators.metrics import auc, auc_table

ROWS = "g string, s double, y boolean"


def brute(rows):
    yes, no = ([s for _, s, y in rows if s is not None and y is want] for want in (True, False))
    won = sum((a > b) + (a == b) / 2 for a in yes for b in no)
    return won / len(yes) / len(no) if yes and no else None


def test_all_groups_in_one_pass(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 0.5, rng.random(), -rng.random() * 9]), rng.random() < 0.4) for _ in range(600)]
    rows += [("one", 0.1 * i, True) for i in range(5)] + [("none", None, True)]
    got = {r.g: r.auc for r in auc_table(spark.createDataFrame(rows, ROWS), "s", "y", ["g"]).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, value in got.items():
        want = brute([r for r in rows if r[0] == g])
        assert value == (None if want is None else pytest.approx(want, abs=1e-12))


def test_ties_only_empty_and_null_labels(spark):
    ties = [("a", 1.0, i % 3 == 0) for i in range(90)] + [("a", 2.0, None)]
    df = spark.createDataFrame(ties, ROWS)
    assert auc(df, "s", "y") == 0.5
    assert auc(df.limit(0), "s", "y") is None and auc_table(df.limit(0), "s", "y").count() == 1
    assert auc_table(df.limit(0), "s", "y", ["g"]).count() == 0
