"""Clusters that are updated equal clusters of a full run."""

import random

import pytest
from pyspark.sql import functions as F

from rowkin.operators import cluster_updates, components

EDGE = "left_key string, right_key string"


def xref_of(spark, keys, edges):
    frame = spark.createDataFrame([(k,) for k in keys], "entity_key string")
    return components.cross_reference(components.clusters(frame, spark.createDataFrame(edges, EDGE)))


def as_dict(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


@pytest.mark.parametrize("hot_rows", [components.HOT_ROWS, 5])
def test_two_updates_equal_a_full_run(spark, hot_rows):
    rng = random.Random(5)
    keys = [f"k{i:03}" for i in range(120)]
    rng.shuffle(keys)
    present = [keys[:60], keys[:90], keys]
    star = [("k000", k) for k in keys[100:]]
    batches = [[tuple(rng.sample(known, 2)) for _ in range(25)] for known in present]
    batches[2] += star + star[:3] + [(None, keys[0]), (keys[1], None), (keys[2], keys[2])]
    xref = xref_of(spark, present[0], batches[0])
    first = as_dict(xref)
    redirects = None
    for known, batch in zip(present[1:], batches[1:], strict=True):
        before = as_dict(xref)
        entities = spark.createDataFrame([(k, "x") for k in known], "entity_key string, master_id string")
        update = cluster_updates.update_clusters(xref, entities, spark.createDataFrame(batch, EDGE), hot_rows)
        xref = update.xref
        redirects = update.redirects if redirects is None else cluster_updates.extended_redirects(redirects, update.redirects)
        after = as_dict(xref)
        assert as_dict(update.redirects) == {m: after[k] for k, m in before.items() if m not in set(after.values())}
        members = lambda of: {m: {k for k in of if of[k] == m} for m in of.values()}
        was, now = members(before), members(after)
        assert {r.master_id for r in update.touched.collect()} == {m for m in now if now[m] != was.get(m)}
    edges = [e for batch in batches for e in batch if None not in e]
    final = as_dict(xref)
    assert final == as_dict(xref_of(spark, keys, edges))
    followed = as_dict(redirects)
    assert {m: followed.get(m, m) for m in first.values()} == {m: final[k] for k, m in first.items()}


def test_nothing_new_and_nothing_old(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "entity_key string")
    none = spark.createDataFrame([], EDGE)
    empty = spark.createDataFrame([], "entity_key string, master_id string")
    first = cluster_updates.update_clusters(empty, keys, spark.createDataFrame([("b", "a")], EDGE))
    assert len(set(as_dict(first.xref).values())) == 1 and first.redirects.count() == 0 and first.touched.count() == 1
    again = cluster_updates.update_clusters(first.xref, keys, none)
    assert as_dict(again.xref) == as_dict(first.xref) and again.touched.where(F.lit(True)).count() == 0
