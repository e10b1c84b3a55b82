"""Match probability by logistic regression, thresholds tuned on dev, and routing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.operators.pairs import AGREEMENTS
from rowkin.session import stage

# Wanted precision of MATCH and NON_MATCH, the threshold grids, and the thresholds
# that stand for "never" when no grid value reaches the wanted precision.
TARGET_PRECISION = 0.98
GRID_START, GRID_STEP, GRID_SIZE, GRID_UNIT = 500, 5, 100, 1000
LOW_GRID_SHIFT = 0.495
NEVER_MATCH, NEVER_NON_MATCH = 1.01, -0.01
NEUTRAL_SCORE = 0.5
MAX_NEWTON_STEPS = 60
NEWTON_CLOSE = 1e-9  # a step this small is the last
SIMILARITIES = ("name_sim", "address_sim")


@dataclass(frozen=True)
class Weights:
    """A fitted (or given) linear model: one weight per design column, and the intercept."""

    weights: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class Thresholds:
    tau_high: float
    tau_low: float


def design_columns(score: str | None = None) -> dict[str, Column]:
    """Agreements as two indicators (equal, different; missing is the base), similarities, score."""
    columns: dict[str, Column] = {}
    for name in AGREEMENTS:
        columns[f"{name}_eq"] = (F.col(name) == 1).cast("double")
        columns[f"{name}_ne"] = (F.col(name) == -1).cast("double")
    for name in SIMILARITIES:
        columns[name] = F.col(name).cast("double")
    if score:
        columns["second_score"] = F.coalesce(F.col(score), F.lit(NEUTRAL_SCORE)).cast("double")
    return columns


def grouped_design(train: DataFrame, score: str | None = None) -> DataFrame:
    """Distinct design rows with their number ``n`` and the matches among them, ``hits``: all that the fit needs to know."""
    design = design_columns(score)
    rows = train.select(F.col("is_match").cast("long").alias("label"), *[c.alias(name) for name, c in design.items()])
    return rows.groupBy(*design).agg(F.count("label").cast("double").alias("n"), F.sum("label").cast("double").alias("hits")).where("n > 0")


def _newton_sums(grouped: DataFrame, names: Sequence[str], at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, second derivatives) over all rows at the given weights: one aggregate, one row to the driver."""
    k, x = len(names), [*[F.col(name) for name in names[:-1]], F.lit(1.0)]
    margin = sum((F.lit(float(w)) * c for w, c in zip(at, x, strict=True)), F.lit(0.0))
    rows = grouped.withColumn("margin", margin).withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin"))))
    n, hits, m, p = F.col("n"), F.col("hits"), F.col("margin"), F.col("p")
    loss = n * (F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))) - hits * m
    first = [F.sum((n * p - hits) * c) for c in x]
    second = [F.sum(n * p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(i, k)]
    sums = [v or 0.0 for v in rows.agg(F.sum(loss), *first, *second).first()]
    curve = np.zeros((k, k))
    curve[np.triu_indices(k)] = sums[k + 1:]
    return sums[0], np.array(sums[1: k + 1]), curve + np.triu(curve, 1).T


def fit(train: DataFrame, score: str | None = None) -> Weights:
    """L2-regularised logistic regression with unit inverse strength and a free intercept.

    Newton steps over the distinct design rows; a step that would raise the loss is halved. Without rows all weights are 0.
    """
    names = [*design_columns(score), "intercept"]
    grouped = stage(grouped_design(train, score), "design")
    penalty = np.array([1.0] * (len(names) - 1) + [0.0])
    weights, step = np.zeros(len(names)), np.zeros(len(names))
    best = np.inf
    for _ in range(MAX_NEWTON_STEPS):
        loss, gradient, curve = _newton_sums(grouped, names, weights - step)
        loss += (penalty * (weights - step) ** 2).sum() / 2
        if loss > best + 1e-9 * (1 + abs(best)):
            step = step / 2
            continue
        weights, best = weights - step, loss
        step = np.linalg.solve(curve + np.diag(penalty + 1e-12), gradient + penalty * weights)
        if np.abs(step).max() < NEWTON_CLOSE:
            break
    final = weights - step
    return Weights(tuple(map(float, final[:-1])), float(final[-1]))


def match_probability(model: Weights, score: str | None = None) -> Column:
    """The logistic function of the weighted design columns, as one generated expression."""
    margin = F.lit(model.intercept)
    for weight, column in zip(model.weights, design_columns(score).values(), strict=True):
        margin = margin + F.lit(weight) * column
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _high(i: Column) -> Column:
    return (i * GRID_STEP + GRID_START).cast("double") / F.lit(float(GRID_UNIT))


def _low(i: Column) -> Column:
    return _high(i) - F.lit(LOW_GRID_SHIFT)


def _grid_points_below(p: Column, guess: Column, reached: object) -> Column:
    """How many grid points ``p`` has reached, from an arithmetic guess that may be off by one."""
    size = F.lit(GRID_SIZE)
    guess = F.least(F.greatest(guess.cast("int"), F.lit(0)), size)
    return (
        F.when((guess > 0) & ~reached(guess - 1), guess - 1)
        .when((guess < size) & reached(guess), guess + 1)
        .otherwise(guess)
    )


def threshold_curve(scored: DataFrame, p: str = "p_match", label: str = "is_match") -> DataFrame:
    """Rows and hits at or beyond each grid value, high side and low side.

    All rows are first counted per grid step (map-side, at most a few hundred groups); the running
    sums then go over the 100 grid rows, never over the data.
    """
    prob = F.col(p)
    step = GRID_STEP / GRID_UNIT
    counted = scored.select(
        _grid_points_below(prob, F.floor((prob - 0.5) / step) + 1, lambda i: prob >= _high(i)).alias("above"),
        _grid_points_below(prob, F.ceil(prob / step) - 1, lambda i: prob > _low(i)).alias("below"),
        F.col(label).cast("long").alias("hit"),
    ).groupBy("above", "below").agg(F.count("*").alias("rows"), F.sum("hit").alias("hits"))

    side = F.explode(F.array(
        F.struct(F.lit("high").alias("name"), (F.col("above") - 1).alias("i")),
        F.struct(F.lit("low").alias("name"), F.col("below").alias("i")),
    ))
    steps = counted.select(side.alias("side"), "rows", "hits").groupBy(F.col("side.i").alias("i")).agg(
        *[
            F.sum(F.when(F.col("side.name") == name, F.col(value)).otherwise(0)).alias(f"{name}_{value}")
            for name in ("high", "low") for value in ("rows", "hits")
        ]
    )
    spark = scored.sparkSession
    grid = spark.range(GRID_SIZE, numPartitions=1).select(F.col("id").cast("int").alias("i"))
    dense = grid.join(steps, "i", "left").na.fill(0)
    upward = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    downward = Window.orderBy("i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    i = F.col("i")
    return dense.select(
        "i",
        _high(i).alias("t_high"),
        F.sum("high_rows").over(downward).alias("rows_high"),
        F.sum("high_hits").over(downward).alias("hits_high"),
        _low(i).alias("t_low"),
        F.sum("low_rows").over(upward).alias("rows_low"),
        F.sum("low_hits").over(upward).alias("hits_low"),
    )


def tuned_thresholds(curve: DataFrame, target: float = TARGET_PRECISION) -> DataFrame:
    """One row: the lowest high and the highest low grid value that reach the wanted precision."""
    precise = (F.col("rows_high") > 0) & (F.col("hits_high") / F.greatest("rows_high", F.lit(1)) >= target)
    pure = (F.col("rows_low") > 0) & (1 - F.col("hits_low") / F.greatest("rows_low", F.lit(1)) >= target)
    return curve.agg(
        F.coalesce(F.min(F.when(precise, F.col("t_high"))), F.lit(NEVER_MATCH)).alias("tau_high"),
        F.round(F.coalesce(F.max(F.when(pure, F.col("t_low"))), F.lit(NEVER_NON_MATCH)), 3).alias("tau_low"),
    )


def tune(scored_dev: DataFrame, target: float = TARGET_PRECISION) -> Thresholds:
    row = tuned_thresholds(threshold_curve(scored_dev), target).first()
    return Thresholds(row["tau_high"], row["tau_low"])


def route(p: Column, conflict: Column, invalid: Column, tau: Thresholds) -> Column:
    """MATCH, NON_MATCH or REVIEW. A hard conflict never matches; an invalid score decides nothing."""
    automatic = F.when(p >= tau.tau_high, F.when(conflict, "REVIEW").otherwise("MATCH"))
    return F.when(invalid, "REVIEW").otherwise(
        automatic.when(p <= tau.tau_low, "NON_MATCH").otherwise("REVIEW")
    )


def decide(labeled: DataFrame, model: Weights, tau: Thresholds | None = None, score: str | None = None,
           target: float = TARGET_PRECISION) -> tuple[DataFrame, Thresholds]:
    """``labeled`` with ``p_match`` and ``decision``: one narrow projection, so nothing is joined
    to find a pair's labels or records again. Thresholds are tuned on dev unless given."""
    scored = labeled.withColumn("p_match", match_probability(model, score))
    if tau is None:
        tau = tune(scored.where(F.col("split") == "dev"), target)
    invalid = F.col(score).isNull() if score else F.lit(False)
    decision = route(F.col("p_match"), F.col("birth_date_conflict"), invalid, tau)
    return scored.withColumn("decision", decision), tau


def decision_rows(decided: DataFrame, score: str | None = None) -> DataFrame:
    """What leaves the decision step: (pair_id, p_same, p_match, decision), nothing else."""
    second = F.col(score) if score else F.lit(None)
    return decided.select("pair_id", second.cast("double").alias("p_same"), "p_match", "decision")


def run_config(labeled: DataFrame, score: str | None = None,
               target: float = TARGET_PRECISION) -> tuple[DataFrame, Thresholds]:
    """Fit on dev, tune on dev, decide every pair. ``labeled`` should be a written table."""
    model = fit(labeled.where(F.col("split") == "dev"), score)
    return decide(labeled, model, None, score, target)


def has_both_classes(labeled: DataFrame) -> bool:
    """True when the dev rows hold matches and non-matches, so that a model can be fitted."""
    row = labeled.where(F.col("split") == "dev").agg(
        F.count_if(F.col("is_match")).alias("yes"), F.count_if(~F.col("is_match")).alias("no")
    ).first()
    return row["yes"] > 0 and row["no"] > 0

