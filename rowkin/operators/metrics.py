"""Measures against ground truth: decisions, cascade, second scores, blocking, volumes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.session import stage

SECONDS_PER_HOUR = 3600
SCORED_UNIT = 1000

MEDIAN_ROWS, MEDIAN_STEPS = 1000, 1000  # rows sorted in one task at most; steps per pass


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def true_pair_counts(truth: DataFrame) -> DataFrame:
    """(split, true_pairs): pairs of records of one person, counted without forming them."""
    sizes = truth.groupBy("split", "true_entity_id").agg(F.count("*").alias("n"))
    pairs = F.expr("n * (n - 1) DIV 2")
    return sizes.groupBy("split").agg(F.sum(pairs).alias("true_pairs"))


def blocking_recall(labeled: DataFrame, truth: DataFrame) -> DataFrame:
    """Labelled true pairs among the candidates, out of all true pairs of every split."""
    found = labeled.agg(F.count_if("is_match").alias("found"))
    total = true_pair_counts(truth).agg(F.coalesce(F.sum("true_pairs"), F.lit(0)).alias("true_pairs"))
    total_value = F.lit(total.first()["true_pairs"]).cast("bigint")
    return found.select("found", total_value.alias("true_pairs"), _share(F.col("found"), total_value).alias("recall"))


def oversized_summary(oversized: DataFrame) -> DataFrame:
    """One row: blocks that stayed too large, and the pairs they did not form."""
    return oversized.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
                         F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs_not_formed"))


def config_metrics(decided: DataFrame, true_pairs_test: int) -> DataFrame:
    """One row per ``config`` on the test split; undefined shares are NULL."""
    match, non = F.col("decision") == "MATCH", F.col("decision") == "NON_MATCH"
    total = F.lit(true_pairs_test).cast("bigint")
    counts = decided.where(F.col("split") == "test").groupBy("config").agg(
        F.count("*").alias("pairs_test"),
        F.count_if(match).alias("match"),
        F.count_if(non).alias("non"),
        F.count_if(F.col("decision") == "REVIEW").alias("review"),
        F.count_if(match & F.col("is_match")).alias("hit"),
        F.count_if(non & ~F.col("is_match")).alias("true_non"),
    )
    n = F.col("pairs_test")
    return counts.select(
        "config", "pairs_test",
        _share(F.col("match"), n).alias("pct_match"),
        _share(F.col("non"), n).alias("pct_non_match"),
        _share(F.col("review"), n).alias("pct_review"),
        _share(F.col("hit"), F.col("match")).alias("precision_match"),
        _share(F.col("true_non"), F.col("non")).alias("npv_non_match"),
        _share(F.col("hit"), total).alias("recall_auto"),
        _share(F.col("match") + F.col("non"), n).alias("automation"),
    )


def cascade_metrics(rules: DataFrame, cascade: DataFrame, timing: DataFrame) -> DataFrame:
    """One row: the rules' test queue and what the second stage made of it.

    ``timing`` is one scorer's batch times; its three sums are single numbers.
    """
    in_queue = (F.col("split") == "test") & (F.col("decision") == "REVIEW")
    queue = rules.where(in_queue).select("pair_id", "is_match").join(
        cascade.select("pair_id", F.col("decision").alias("after")), "pair_id", "left")
    after, is_match = F.col("after"), F.col("is_match")
    resolved = after.isNull() | (after != "REVIEW")
    correct = F.coalesce(((after == "MATCH") & is_match) | ((after == "NON_MATCH") & ~is_match), F.lit(False))
    spent = timing.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.col("load_s") + F.col("infer_s")), F.lit(0.0)).alias("seconds"),
    ).first()
    judged, seconds = F.lit(spent["pairs"]).cast("bigint"), F.lit(spent["seconds"])
    counts = queue.agg(
        F.count("*").alias("queue"),
        F.count_if(is_match).alias("queue_true_matches"),
        F.count_if(resolved).alias("resolved"),
        F.count_if(after == "MATCH").alias("resolved_match"),
        F.count_if(after == "NON_MATCH").alias("resolved_non_match"),
        F.count_if(resolved & ~correct).alias("errors"),
        F.count_if(resolved & correct).alias("right"),
    )
    return counts.select(
        "queue", "queue_true_matches", "resolved",
        _share(F.col("resolved"), F.col("queue")).alias("resolved_pct"),
        "resolved_match", "resolved_non_match", "errors",
        _share(F.col("right"), F.col("resolved")).alias("precision_resolved"),
        judged.alias("pairs_judged_all_splits"),
        seconds.alias("score_seconds"),
        _share(seconds, judged).alias("score_s_per_pair"),
    )


def auc_table(scored: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """(*groups, auc): exact areas under the ROC curve of all groups in one pass, ties averaged.

    Rows without a score or a label of 0 or 1 do not count; a group without both classes has NULL.
    Without ``groups`` it is one row, also for an empty table. Equal scores are counted before the sort. What lies
    below a score is the sum of all ranges before its own plus a sum inside the range, so
    no task sees more than one range of scores and no window spans a whole group.
    """
    value, truth = F.col(score).cast("double"), F.col(label).cast("double")
    counted = scored.where(value.isNotNull()).groupBy(*groups, value.alias("_score")).agg(
        F.count_if(truth == 1).alias("_yes"), F.count_if(truth == 0).alias("_no"))
    ranged = stage(counted.repartitionByRange(*groups, "_score").withColumn("_range", F.spark_partition_id()), "scores")
    inside = Window.partitionBy(*groups, "_range").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*groups, "_range").agg(F.sum("_no").alias("_whole"))
    before = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"),
                           F.coalesce(F.sum("_whole").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_range") == F.col("_r"))
    below = F.coalesce(F.sum("_no").over(inside), F.lit(0))
    placed = ranged.withColumn("_below", below).join(before, same)
    # Twice the number of (positive, negative) pairs in the right order; a tie counts half.
    won = F.sum(F.col("_yes").cast("decimal(19,0)") * (2 * (F.col("_before") + F.col("_below")) + F.col("_no")).cast("decimal(19,0)"))
    pairs = F.sum("_yes").cast("double") * F.sum("_no").cast("double")
    return placed.groupBy(*groups).agg((won.cast("double") / F.nullif(2 * pairs, F.lit(0.0))).alias("auc"))


def auc(scored: DataFrame, score: str, label: str) -> float | None:
    """Exact area under the ROC curve, ties averaged; None unless both classes are present."""
    return auc_table(scored, score, label).first()["auc"]


def exact_median(values: DataFrame, column: str, in_one_task: int = MEDIAN_ROWS) -> float | None:
    """The median of a column, without sorting it in one task.

    Rows are counted in equal steps between the extremes, and only the steps that hold the middle
    are looked at again, until few enough rows are left to sort. NULLs, NaN and infinite values do
    not count.
    """
    x = F.col(column)
    rest = values.select(x.cast("double").alias(column)).where(F.abs(x) < float("inf"))
    seen = rest.agg(F.count("*").alias("rows"), F.min(x).alias("low"), F.max(x).alias("high")).first()
    rows, low, high = seen["rows"], seen["low"], seen["high"]
    if not rows:
        return None
    first, last = (rows - 1) // 2, rows // 2
    while rows > in_one_task and low < high:
        step = F.least(F.floor((x - low) / (high - low) * MEDIAN_STEPS), F.lit(MEDIAN_STEPS - 1))
        counts = rest.groupBy(step.alias("step")).agg(
            F.count("*").alias("rows"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("step").collect()
        before, middle = 0, []
        for part in counts:  # at most MEDIAN_STEPS rows
            if before <= last and before + part["rows"] > first:
                middle.append((before, part))
            before += part["rows"]
        if len(middle) == 2:  # the middle lies between two steps: last row of one, first of the next
            return (middle[0][1]["high"] + middle[1][1]["low"]) / 2
        skipped, rows = middle[0][0], middle[0][1]["rows"]
        low, high = middle[0][1]["low"], middle[0][1]["high"]
        first, last = first - skipped, last - skipped
        rest = rest.where(x.between(low, high))
    if low == high:
        return low
    ordered = [r[0] for r in rest.orderBy(column).limit(last + 1).collect()]
    return (ordered[first] + ordered[last]) / 2


def timing_metrics(timing: DataFrame, checkpoint: str, cost_per_hour: float) -> DataFrame:
    """One row for one checkpoint: batches, median batch time, load time, throughput and cost."""
    own = timing.where(F.col("checkpoint") == checkpoint)
    sums = own.groupBy("checkpoint").agg(
        F.count("*").alias("batches"),
        F.avg("load_s").alias("load_s_avg"),
        F.sum("infer_s").alias("infer_s_total"),
        F.sum("pairs").alias("pairs"),
    )
    per_unit = _share(SCORED_UNIT * F.col("infer_s_total"), F.col("pairs"))
    return sums.select(
        "checkpoint", "batches",
        F.lit(exact_median(own, "infer_s")).cast("double").alias("p50_batch_s"),
        "load_s_avg", "infer_s_total",
        F.when(F.col("infer_s_total") > 0, F.col("pairs") / F.col("infer_s_total")).alias("pairs_per_s"),
        per_unit.alias("sec_per_1k"),
        (per_unit / SECONDS_PER_HOUR * cost_per_hour).alias("usd_per_1k"),
    )


def score_metrics(scores: DataFrame, labeled: DataFrame, timing: DataFrame, checkpoint: str,
                  cost_per_hour: float) -> DataFrame:
    """One row for one checkpoint: AUC on test, invalid scores, and the timing measures."""
    own = scores.where(F.col("checkpoint") == checkpoint)
    test = own.join(labeled.where(F.col("split") == "test").select("pair_id", "is_match"), "pair_id")
    labelled = own.join(labeled.select("pair_id"), "pair_id", "left_semi")
    invalid = labelled.agg(F.count_if(F.col("p_same").isNull()).alias("invalid")).first()["invalid"]
    row = timing_metrics(timing, checkpoint, cost_per_hour)
    return row.withColumns({
        "auc_test": F.lit(auc(test, "p_same", "is_match")).cast("double"),
        "invalid": F.lit(invalid).cast("bigint"),
    })


def volume_counts(entities: DataFrame, pairs: DataFrame, master: DataFrame) -> DataFrame:
    """(metric, value) rows."""
    def one(metric: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(value.cast("bigint").alias("value")).select(F.lit(metric).alias("metric"), "value")

    masters = master.agg(F.count("*").alias("masters"), F.count_if("has_pending_review").alias("pending_masters"))
    both = masters.select(F.expr("stack(2, 'masters', masters, 'pending_masters', pending_masters) AS (metric, value)"))
    return one("entities", entities, F.count("*")).unionByName(one("candidates", pairs, F.count("*"))).unionByName(both)
