"""Work that has to stay spread, or in proportion to its rows, on tables of its own."""

import random

from pyspark.sql import functions as F

from rowkin.functions import similarity
from rowkin.operators import setjoin
from rowkin.plans.queries import Tables


def test_rows_of_one_small_file_are_spread(spark, tmp_path):
    customers = [(k if k % 9 else None, f"n{k}", k % 3, float(k), "BUILDING") for k in range(64)] * 2
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(customers, schema).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(n, f"nation {n}") for n in range(3)], "n_nationkey int, n_name string").coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    tables = Tables(spark, str(tmp_path))
    assert tables.given("customer").rdd.getNumPartitions() == 1
    assert tables.rows().rdd.getNumPartitions() >= 8
    sizes = tables.rows().groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 8


def test_sets_that_share_one_frequent_token_do_not_meet(spark):
    rows = [("x", [f"a{i}", "common"]) for i in range(200)] + [("x", ["a7", "b", "common"])]
    cut = spark.createDataFrame([(b, i, t, len(t), t) for i, (b, t) in enumerate(rows)], "block string, set long, tokens array<string>, n int, prefix array<string>")
    assert setjoin.short_candidates(cut, 60).count() == 1
    found = setjoin.similar_sets(spark.createDataFrame(rows, "block string, tokens array<string>"), 60).collect()
    assert [tuple(r) for r in found] == [("x", ["a7", "b", "common"], ["a7", "common"], 2, 3)]


def test_short_and_long_sets_equal_all_pairs(spark):
    rng = random.Random(3)
    sets = {tuple(sorted({rng.choice("abcdefghijklmnop") for _ in range(rng.choice((1, 2, 3, 6, 8, 9, 11, 14)))})) for _ in range(150)}
    frame = spark.createDataFrame([("x", list(s)) for s in sets], "block string, tokens array<string>")
    for percent in (20, 60):
        want = {(x, y) for x in sets for y in sets if x < y and 100 * len(set(x) & set(y)) >= percent * len(set(x) | set(y))}
        got = [(tuple(r.left_tokens), tuple(r.right_tokens)) for r in setjoin.similar_sets(frame, percent).collect()]
        assert len(got) == len(want) and set(got) == want


def test_common_subsequences_of_a_batch_equal_those_of_single_pairs():
    rng = random.Random(1)
    some = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 64)))
    for size in (1, 2, 300):
        a, b = [some("abc ñ0é\U0001f600") for _ in range(size)], [some("abc ñ0xyz") for _ in range(size)]
        assert similarity._lcs_batch(a, b).tolist() == [similarity._lcs_long(x, y) for x, y in zip(a, b, strict=True)]
