"""Scoring that goes on where it stopped, and the rows behind failed checks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rowkin.operators import quality, scoring
from rowkin.sources.tables import Layers

TEXTS = "pair_id string, batch_id string, record_a string, record_b string"


def texts_of(spark, n, changed=()):
    return spark.createDataFrame([(f"p{i}", f"b{i // 2:03d}", f"a{i}{'!' * (i in changed)}", "x") for i in range(n)], TEXTS)


def logging_scorer(folder, fails=()):
    def load():
        def score(left, right):
            with open(os.path.join(folder, f"{min(left)}-{os.urandom(4).hex()}"), "w") as f:
                f.write("\n".join(left))
            if any(a in fails for a in left):
                raise ValueError("stopped")
            return [len(a) / 10 for a in left]
        return score
    return scoring.BatchScorer("m", load)


def calls(folder):
    return sorted(n.split("-")[0] for n in os.listdir(folder))


def test_a_stopped_run_goes_on(spark, tmp_path):
    layers, folder = Layers(spark, str(tmp_path / "root")), str(tmp_path / "calls")
    os.mkdir(folder)
    texts = texts_of(spark, 20)
    # The first run ends half-way: only some batches reached the log.
    scoring.resume_scores(texts.where("batch_id < 'b005'"), logging_scorer(folder), layers, wave=2).collect()
    assert calls(folder) == ["a0", "a2", "a4", "a6", "a8"]
    got = {r.pair_id: r for r in scoring.resume_scores(texts, logging_scorer(folder), layers, wave=2).collect()}
    assert calls(folder) == sorted(f"a{i}" for i in range(0, 20, 2))  # once per batch over both runs
    assert len(got) == 20 and all(r.p_same == len(f"a{p[1:]}") / 10 and r.error is None for p, r in got.items())
    scoring.resume_scores(texts, logging_scorer(folder), layers).collect()
    assert len(calls(folder)) == 10


def test_failed_changed_and_new_pairs_are_scored_again(spark, tmp_path):
    layers, folder = Layers(spark, str(tmp_path / "root")), str(tmp_path / "calls")
    os.mkdir(folder)
    first = {r.pair_id: r for r in scoring.resume_scores(texts_of(spark, 6), logging_scorer(folder, fails={"a3"}), layers).collect()}
    assert [first[p].p_same for p in ("p2", "p3", "p4")] == [None, None, 0.2] and "stopped" in first["p2"].error
    again = {r.pair_id: r for r in scoring.resume_scores(texts_of(spark, 7, changed={5}), logging_scorer(folder), layers).collect()}
    assert calls(folder) == sorted(["a0", "a2", "a4", "a2", "a5!", "a6"])
    assert {p: r.p_same for p, r in again.items()} == {**{f"p{i}": 0.2 for i in (0, 1, 2, 3, 4, 6)}, "p5": 0.3}
    other = scoring.resume_scores(texts_of(spark, 2), scoring.ColumnScorer("n", lambda a, b: F.lit(0.9)), layers).collect()
    assert sorted((r.checkpoint, r.p_same) for r in other) == [("n", 0.9)] * 2


def test_nothing_to_score_and_odd_batch_ids(spark, tmp_path):
    layers = Layers(spark, str(tmp_path))
    scorer = scoring.ColumnScorer("n", lambda a, b: F.lit(0.9))
    assert scoring.resume_scores(texts_of(spark, 0), scorer, layers).count() == 0
    odd = spark.createDataFrame([("p", "odd", None, ""), ("q", None, "a", "b")], TEXTS)
    assert scoring.resume_scores(odd, scorer, layers).count() == 2
    assert scoring.resume_scores(odd.limit(0), scorer, layers).count() == 0


def test_offenders_match_the_counts(spark):
    rows = [(i, None if i % 50 == 0 else i % 7, "x" if i % 3 else "z") for i in range(300)] + [(1, 1, "x"), (1, 1, "x")]
    df = spark.createDataFrame(rows, "id int, k int, s string")
    parents = spark.createDataFrame([(i,) for i in range(5)], "p int")
    contract = quality.Contract(required=("k",), keys=(("id",),), allowed={"s": ("x",)}, references={"k": (parents, "p")})
    counted = {r.check: r.observed for r in quality.contract_checks("t", df, contract).collect()}
    got = quality.contract_offenders("t", df, contract, limit=20).collect()
    shown = {}
    for r in got:
        shown.setdefault(r.check, []).append(json.loads(r.row))
    whole = {r.check: r.offenders for r in got}
    assert whole["t.k not null"] == counted["t.k not null"] == 6 == len(shown["t.k not null"])
    assert whole["t.s allowed"] == counted["t.s allowed"] == 100 and len(shown["t.s allowed"]) == 20
    assert shown["t(id) unique"] == [{"id": 1, "rows": 3}] and counted["t(id) unique"] == 2
    assert {r["k"] for r in shown["t.k reference"]} == {5, 6} and sum(r["rows"] for r in shown["t.k reference"]) == counted["t.k reference"]
    assert quality.contract_offenders("t", df.limit(0), contract).count() == 0
    with pytest.raises(ValueError, match="999"):
        quality.keep_first(df, 1_000)


def test_first_rows_are_picked_before_the_shuffle(spark):
    check = F.when(F.col("id") < 990, "c").otherwise("d")
    rows = spark.range(1000).select(check.alias("check"), F.col("id").cast("string").alias("row"))
    plan = quality.keep_first(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    got = sorted((r.check, r.offenders, r.row) for r in quality.keep_first(rows, 3).collect())
    assert got == [("c", 990, "0"), ("c", 990, "1"), ("c", 990, "10"), ("d", 10, "990"), ("d", 10, "991"), ("d", 10, "992")]


def test_a_refused_gate_names_its_rows(spark):
    checks = spark.createDataFrame([("c", False, 2), ("d", True, 0)], "check string, passed boolean, observed bigint")
    with pytest.raises(quality.GateFailed, match="c: 2; rows in /here"):
        quality.require(checks, lambda: "/here")
    quality.require(checks.where("passed"), lambda: pytest.fail("nothing failed"))
