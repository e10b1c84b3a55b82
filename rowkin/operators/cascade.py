"""Second stage: only pairs that the rules left in REVIEW are decided again, with a second score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.operators.decide import TARGET_PRECISION, Thresholds, has_both_classes, run_config
from rowkin.operators.upsert import overlay
from rowkin.session import stage


def review_rows(rules: DataFrame, scores: DataFrame) -> DataFrame:
    """The rules' REVIEW pairs with their second score, NULL where there is none."""
    queue = rules.where(F.col("decision") == "REVIEW").drop("p_match", "decision")
    return queue.join(scores.select("pair_id", "p_same"), "pair_id", "left")


def merge_stages(rules: DataFrame, second: DataFrame) -> DataFrame:
    """All pairs: the second stage's result where there is one, else the first stage's."""
    return overlay(rules, second, "pair_id", ("p_match", "decision"))


def run_cascade(rules: DataFrame, scores: DataFrame,
                target: float = TARGET_PRECISION) -> tuple[DataFrame, Thresholds | None]:
    """Refit and retune on the dev part of the queue. Without both classes there the queue stays."""
    queue = stage(review_rows(rules, scores), "queue")
    if not has_both_classes(queue):
        return rules, None
    second, tau = run_config(queue, "p_same", target)
    return merge_stages(rules, second), tau
